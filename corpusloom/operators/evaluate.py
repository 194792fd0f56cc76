"""Metrics over prediction tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _prf(hit: Column, predicted: Column, gold: Column, name: str, beta: float = 1.0) -> list[Column]:
    p, r = _div(hit, predicted), _div(hit, gold)
    f = _div((1 + beta * beta) * p * r, beta * beta * p + r)
    return [(100 * p).alias(f"{name}_p"), (100 * r).alias(f"{name}_r"), (100 * f).alias(f"{name}_f")]


def spelling_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sentence and character detection and correction of ``rows (keys, src, tgt, prediction)``, in percent.

    Rows whose reference has another length than the source do not count. A prediction of another length counts
    for sentences but not for characters. Rates without a denominator are 0.
    """
    x = rows.where(F.length("src") == F.length("tgt")).select(*keys, "src", "tgt", F.coalesce("prediction", F.lit("")).alias("p"))
    same = F.length("p") == F.length("src")
    s, t, p = (F.split(c, "") for c in ("src", "tgt", "p"))
    marks = F.transform(F.arrays_zip(s.alias("s"), t.alias("t"), p.alias("p")), lambda z: F.struct((z["s"] != z["t"]).alias("g"), (z["s"] != z["p"]).alias("q"), (z["t"] == z["p"]).alias("e")))
    n = lambda f: F.when(same, F.size(F.filter(F.col("m"), f))).otherwise(0)
    x = x.withColumn("m", F.when(same, marks)).select(
        *keys, (F.col("src") != F.col("tgt")).alias("g"), (F.col("src") != F.col("p")).alias("q"), (F.col("tgt") == F.col("p")).alias("e"),
        n(lambda z: z["g"]).alias("cg"), n(lambda z: z["q"]).alias("cq"), n(lambda z: z["g"] & z["q"]).alias("cd"), n(lambda z: z["g"] & z["q"] & z["e"]).alias("cc"),
    )
    a = x.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("g").alias("gold"), F.count_if("q").alias("pred"), F.count_if(F.col("g") & F.col("q")).alias("both"), F.count_if(F.col("g") & F.col("q") & F.col("e")).alias("right"),
        F.count_if(~F.col("g") & F.col("q")).alias("false"), F.count_if("e").alias("exact"), F.count_if(~F.col("g")).alias("clean"), *(F.sum(c).alias(c) for c in ("cg", "cq", "cd", "cc")),
    )
    c = F.col
    return a.select(
        *keys, "n", *_prf(c("both"), c("pred"), c("gold"), "sentence_detection"), *_prf(c("right"), c("pred"), c("gold"), "sentence_correction"), *_prf(c("cd"), c("cq"), c("cg"), "char_detection"), *_prf(c("cc"), c("cq"), c("cg"), "char_correction"),
        (100 * _div(c("both") + c("clean") - c("false"), c("n"))).alias("detection_accuracy"), (100 * _div(c("exact"), c("n"))).alias("correction_accuracy"), (100 * _div(c("false"), c("clean"))).alias("false_positive_rate"),
    )


def _edits(a: str, b: str) -> list[tuple[int, int, str]]:
    """Least edits (begin, end, new text) that turn ``a`` into ``b``, neighbouring ones merged."""
    n, m = len(a), len(b)
    d = np.zeros((n + 1, m + 1), np.int32)
    d[:, 0], d[0] = np.arange(n + 1), np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    out, i, j = [], n, m
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            if a[i - 1] != b[j - 1]:
                out.append((i - 1, i, b[j - 1]))
            i, j = i - 1, j - 1
        elif i and d[i, j] == d[i - 1, j] + 1:
            out.append((i - 1, i, ""))
            i -= 1
        else:
            out.append((i, i, b[j - 1]))
            j -= 1
    merged: list[tuple[int, int, str]] = []
    for begin, end, new in reversed(out):
        if merged and merged[-1][1] == begin:
            merged[-1] = (merged[-1][0], end, merged[-1][2] + new)
        else:
            merged.append((begin, end, new))
    return merged


def edit_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Character-edit precision, recall and F0.5 of ``rows (keys, src, references, prediction)``, and exact matches.

    Of several references the one of best F0.5 counts. Edits are least edit scripts, not a linguistic alignment.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            out = []
            for src, refs, pred in zip(x.src, x.references, x.prediction, strict=True):
                p = set(_edits(src or "", pred or ""))
                best = (0, len(p), 0, -1.0)
                for r in refs if refs is not None else ():
                    g = set(_edits(src or "", r or ""))
                    hit = len(p & g)
                    prec, rec = hit / len(p) if p else 1.0, hit / len(g) if g else 1.0
                    f = 1.25 * prec * rec / (0.25 * prec + rec) if hit or not (p or g) else 0.0
                    if f > best[3]:
                        best = (hit, len(p), len(g), f)
                out.append((*best[:3], pred in set(refs) if refs is not None else False))
            yield pd.concat([x[keys].reset_index(drop=True), pd.DataFrame(out, columns=["hit", "pred", "gold", "exact"])], axis=1)

    shape = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys) + ", hit bigint, pred bigint, gold bigint, exact boolean"
    a = rows.select(*keys, "src", "references", "prediction").mapInPandas(run, shape).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("hit").alias("hit"), F.sum("pred").alias("pred"), F.sum("gold").alias("gold"), F.count_if("exact").alias("exact"))
    return a.select(*keys, "n", *_prf(F.col("hit"), F.col("pred"), F.col("gold"), "edit", 0.5), (100 * _div(F.col("exact"), F.col("n"))).alias("exact"))


def classification(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy in percent of ``rows (keys, gold, prediction)`` after trimming; a null prediction is wrong."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), (100 * F.avg(F.coalesce(F.trim("gold") == F.trim("prediction"), F.lit(False)).cast("int"))).alias("accuracy"))


def set_f1(rows: DataFrame, keys: list[str], mark: str = "[、,，;；\\s]+") -> DataFrame:
    """Micro precision, recall and F1 of sets written as lists in ``gold`` and ``prediction``."""
    items = lambda c: F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), mark), lambda x: x != ""))
    x = rows.select(*keys, items(F.col("gold")).alias("g"), items(F.col("prediction")).alias("p"))
    a = x.groupBy(*keys).agg(F.sum(F.size(F.array_intersect("g", "p"))).alias("hit"), F.sum(F.size("p")).alias("pred"), F.sum(F.size("g")).alias("gold"))
    return a.select(*keys, *_prf(F.col("hit"), F.col("pred"), F.col("gold"), "set"))


def level_match(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Share in percent of predictions that match the gold title in its first, first two and all levels."""
    g, p = T.book_parts(F.col("gold")), T.book_parts(F.coalesce("prediction", F.lit("")))
    x = rows.select(*keys, g.alias("g"), p.alias("p"))
    hit = lambda n: (100 * F.avg((F.slice("g", 1, n) == F.slice("p", 1, n)).cast("int")))
    return x.groupBy(*keys).agg(F.count("*").alias("n"), hit(1).alias("level1"), hit(2).alias("level2"), (100 * F.avg((F.col("g") == F.col("p")).cast("int"))).alias("whole"))


def punctuation_f1(rows: DataFrame, keys: list[str]) -> DataFrame:
    """F1 of (mark, characters before it) pairs; a prediction that changes other characters has no hits."""
    marks = lambda c: F.filter(F.transform(F.split(c, ""), lambda x, i: F.when(x.rlike(r"\p{P}"), F.concat(x, F.length(T.unpunctuated(F.substring(c, F.lit(1), i))).cast("string")))), lambda x: x.isNotNull())
    p = F.coalesce("prediction", F.lit(""))
    same = T.unpunctuated(F.col("gold")) == T.unpunctuated(p)
    x = rows.select(*keys, marks(F.col("gold")).alias("g"), marks(p).alias("p"), same.alias("same"))
    hit = F.when(F.col("same"), F.size(F.array_intersect("g", "p"))).otherwise(0)
    a = x.groupBy(*keys).agg(F.sum(hit).alias("hit"), F.sum(F.size(F.array_distinct("p"))).alias("pred"), F.sum(F.size(F.array_distinct("g"))).alias("gold"))
    return a.select(*keys, *_prf(F.col("hit"), F.col("pred"), F.col("gold"), "punctuation"))


def corpus_bleu(rows: DataFrame, keys: list[str], order: int = 4) -> DataFrame:
    """Character BLEU of ``rows (keys, id, gold, prediction)`` over each key: clipped n-gram counts, geometric mean, brevity penalty."""
    chars = lambda c: F.split(T.compact(F.coalesce(c, F.lit(""))), "")
    x = rows.select(*keys, "id", chars(F.col("gold")).alias("g"), chars(F.col("prediction")).alias("p"))

    def of_order(c: str, n: int) -> Column:
        return F.transform(T.windows(F.col(c), n), lambda w: F.struct(F.lit(n).alias("n"), w.alias("w")))

    grams = lambda c: F.flatten(F.array(*(of_order(c, n) for n in range(1, order + 1))))
    count = lambda c, name: x.select(*keys, "id", F.explode(grams(c)).alias("z")).groupBy(*keys, "id", "z.n", "z.w").agg(F.count("*").alias(name))
    both = count("p", "cp").join(count("g", "cg"), [*keys, "id", "n", "w"], "left")
    per = both.groupBy(*keys, "n").agg(F.sum(F.least("cp", F.coalesce("cg", F.lit(0)))).alias("hit"), F.sum("cp").alias("all"))
    prec = per.groupBy(*keys).agg(F.sum(F.log(F.col("hit") / F.col("all"))).alias("logs"), F.min("hit").alias("least"), F.count("*").alias("orders"))
    size = x.groupBy(*keys).agg(F.sum(F.size("g")).alias("ng"), F.sum(F.size("p")).alias("np"))
    brevity = F.when(F.col("np") >= F.col("ng"), F.lit(1.0)).otherwise(F.exp(1 - F.col("ng") / F.col("np")))
    score = F.when((F.col("least") > 0) & (F.col("orders") == order), 100 * brevity * F.exp(F.col("logs") / order)).otherwise(0.0)
    return size.join(prec, keys, "left").select(*keys, F.coalesce(score, F.lit(0.0)).alias("bleu"))


def answer_f1(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean exact match and mean sequence F1 of ``rows (keys, id, reference, prediction)``, the best reference per id."""
    norm = lambda c: T.unpunctuated(T.nfkc_casefold(F.coalesce(c, F.lit(""))))
    x = rows.select(*keys, "id", (norm(F.col("reference")) == norm(F.col("prediction"))).cast("int").alias("em"), T.sequence_f1("prediction", "reference").alias("f1"))
    return x.groupBy(*keys, "id").agg(F.max("em").alias("em"), F.max("f1").alias("f1")).groupBy(*keys).agg(F.count("*").alias("n"), (100 * F.avg("em")).alias("em"), (100 * F.avg("f1")).alias("f1"))


def scoring_windows(docs: DataFrame, size: str, length: int, stride: int) -> DataFrame:
    """(doc_id, begin, end, scored_from): windows in which every target after the first is scored exactly once."""
    x = docs.where(F.col(size) > 1).select("doc_id", F.col(size).alias("n"))
    steps = F.when(F.col("n") <= length, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((F.col("n") - length) / stride).cast("int")))
    x = x.select("doc_id", "n", F.explode(steps).alias("i"))
    begin = F.col("i") * stride
    end = F.least(begin + length, F.col("n"))
    return x.select("doc_id", begin.cast("bigint").alias("begin"), end.cast("bigint").alias("end"), F.when(F.col("i") == 0, F.lit(1)).otherwise(begin - stride + length).cast("bigint").alias("scored_from"))


def health(rows: DataFrame) -> DataFrame:
    """Stop, cut, loop and empty rates of ``rows (task, finish_reason, prediction)`` by task and over all (task null)."""
    p = F.coalesce("prediction", F.lit(""))
    x = rows.select("task", F.coalesce("finish_reason", F.lit("")).alias("f"), (F.trim(p) == "").alias("empty"), T.ends_in_loop(p).alias("loop"))
    rate = lambda c: F.avg(c.cast("int"))
    return x.rollup("task").agg(F.count("*").alias("n"), rate(F.col("f") == "stop").alias("stop"), rate(F.col("f") == "length").alias("cut"), rate(F.col("loop")).alias("loop"), rate(F.col("empty")).alias("empty"), F.grouping("task").alias("all"))


def accept(rates: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Adds ``passed``: no rate is above its limit."""
    ok = F.lit(True)
    for c, most in limits.items():
        ok = ok & (F.col(c) <= most)
    return rates.withColumn("passed", ok)


def paired_bootstrap(rows: DataFrame, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(delta, low, high): difference of two ratios of sums over paired rows and its 95 % interval.

    ``rows``: a_sum, a_count, b_sum, b_count, id. Each row is drawn a Poisson number of times per draw, so draws are
    sums over partitions and rows never meet in one task.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((draws + 1, 4))
        for x in parts:
            v = x[["a_sum", "a_count", "b_sum", "b_count"]].to_numpy(float)
            total[draws] += v.sum(0)
            for i, row in zip(x.id, v, strict=True):
                r = np.random.default_rng([seed, *str(i).encode()])
                total[:draws] += r.poisson(1.0, draws)[:, None] * row
        yield pd.DataFrame(np.column_stack([np.arange(draws + 1), total]), columns=["draw", "a_sum", "a_count", "b_sum", "b_count"])

    d = rows.select("id", "a_sum", "a_count", "b_sum", "b_count").mapInPandas(run, "draw double, a_sum double, a_count double, b_sum double, b_count double").groupBy("draw").agg(*(F.sum(c).alias(c) for c in ("a_sum", "a_count", "b_sum", "b_count")))
    d = d.select("draw", (F.col("b_sum") / F.nullif("b_count", F.lit(0.0)) - F.col("a_sum") / F.nullif("a_count", F.lit(0.0))).alias("x"))
    return d.agg(F.max(F.when(F.col("draw") == draws, F.col("x"))).alias("delta"), F.percentile(F.when(F.col("draw") < draws, F.col("x")), 0.025).alias("low"), F.percentile(F.when(F.col("draw") < draws, F.col("x")), 0.975).alias("high"))


def aligned_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, problem): rows that are missing on one side or come twice, for checks before a positional join."""
    a = left.groupBy(key).agg(F.count("*").alias("l"))
    b = right.groupBy(key).agg(F.count("*").alias("r"))
    problem = F.when(F.col("l").isNull(), "missing_left").when(F.col("r").isNull(), "missing_right").when((F.col("l") > 1) | (F.col("r") > 1), "repeated")
    return a.join(b, key, "full").select(key, problem.alias("problem")).where("problem is not null")


def macro(values: list[float]) -> float:
    """Mean of the finite values, 0 if none."""
    ok = [v for v in values if math.isfinite(v)]
    return sum(ok) / len(ok) if ok else 0.0


def homophone_shares(rows: DataFrame, readings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, edits, homophones): single-character corrections from src to tgt, and those between characters of one reading.

    ``readings``: char, reading (several rows for several readings). Rows of unequal length do not count.
    """
    x = rows.where(F.length("src") == F.length("tgt")).select(*keys, F.explode(F.arrays_zip(F.split("src", "").alias("a"), F.split("tgt", "").alias("b"))).alias("z")).where("z.a <> z.b").groupBy(*keys, "z.a", "z.b").agg(F.count("*").alias("n"))
    r = readings.groupBy("char").agg(F.collect_set("reading").alias("r"))
    x = x.join(r.select(F.col("char").alias("a"), F.col("r").alias("ra")), "a", "left").join(r.select(F.col("char").alias("b"), F.col("r").alias("rb")), "b", "left")
    same = F.coalesce(F.arrays_overlap("ra", "rb"), F.lit(False))
    return x.groupBy(*keys).agg(F.sum("n").alias("edits"), F.sum(F.when(same, F.col("n")).otherwise(0)).alias("homophones"))
