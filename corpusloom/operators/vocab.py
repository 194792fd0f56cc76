"""Character sets, vocabularies and token-aligned features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPECIALS = ("<pad>", "<none>", "<unk>")
#: Unicode blocks of Han characters in a vocabulary.
HAN = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x323B0), (0x2EBF0, 0x2EE60))


def range_characters(spark: SparkSession, ranges: tuple[tuple[int, int], ...] = HAN) -> DataFrame:
    """(char): every code point of the ranges, made from its UTF-32 bytes."""
    out = None
    for a, b in ranges:
        x = spark.range(a, b).select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("char"))
        out = x if out is None else out.unionByName(x)
    return out


def character_set(spark: SparkSession, listed: DataFrame, ranges: tuple[tuple[int, int], ...] = HAN) -> tuple[DataFrame, DataFrame]:
    """(set (char, origin), report (status, n)) of the ranges and of ``listed (value)``.

    The first character of a listed value counts after a byte order mark; blank values, comments and headers are
    skipped, characters outside all ranges are invalid, repeated or known ones duplicates.
    """
    base = range_characters(spark, ranges)
    inside = F.lit(False)
    v = F.regexp_replace("value", r"\A\x{FEFF}", "")
    raw = listed.select(F.trim(v).alias("v")).where("v <> '' and not startswith(v, '#') and lower(v) <> 'char'").select(F.substring("v", 1, 1).alias("char"))
    for a, b in ranges:
        inside = inside | F.col("char").rlike(rf"[\x{{{a:X}}}-\x{{{b - 1:X}}}]")
    x = raw.groupBy("char").agg(F.count("*").alias("n"), F.first(inside).alias("inside"))
    report = x.agg(F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("invalid"), F.sum(F.when(F.col("inside"), F.col("n") - 1).otherwise(0)).alias("repeated"), F.count_if("inside").alias("listed"))
    return base.select("char", F.lit("range").alias("origin")), report


def feature_vocabulary(values: DataFrame) -> DataFrame:
    """(value, id) of ``values (value)``: the special values first, then the distinct ones in order.

    Feature values are a small closed set (sounds, strokes, shapes); the numbering runs in one task over distinct values.
    """
    n = len(SPECIALS)
    own = values.where("value is not null").select("value").distinct().where(~F.col("value").isin(*SPECIALS))
    numbered = own.select("value", (F.row_number().over(Window.orderBy("value")) + (n - 1)).cast("bigint").alias("id"))
    return values.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SPECIALS)], "value string, id bigint").unionByName(numbered)


def candidate_union(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(char, value, origins) of several ``(name, table (char, value))``: distinct values with the sorted names of their sources."""
    out = None
    for name, df in sources:
        x = df.select("char", "value", F.lit(name).alias("origin"))
        out = x if out is None else out.unionByName(x)
    return out.where("char is not null and value is not null").groupBy("char", "value").agg(F.array_sort(F.collect_set("origin")).alias("origins"))


def feature_rows(chars: DataFrame, features: DataFrame, vocabulary: DataFrame, width: int) -> DataFrame:
    """(char, ids, mask, missing): ids of a character's feature values in order, padded with <none> to ``width``; mask marks real ones.

    Values beyond ``width`` are kept out and counted in ``missing``, as are values outside the vocabulary (<unk>).
    """
    x = chars.join(features, "char", "left").join(vocabulary, "value", "left")
    value = F.when(F.col("value").isNotNull(), F.struct("value", F.coalesce("id", F.lit(2).cast("bigint")).alias("id")))
    own = x.groupBy("char").agg(F.array_sort(F.collect_set(value)).alias("v"))
    ids = F.transform(F.slice("v", 1, width), lambda z: z["id"])
    padded = F.concat(ids, F.array_repeat(F.lit(1).cast("bigint"), F.greatest(width - F.size(ids), F.lit(0)).cast("int")))
    return own.select("char", padded.alias("ids"), F.transform(padded, lambda i: i > 2).alias("mask"), (F.greatest(F.size("v") - width, F.lit(0)) + F.size(F.filter(ids, lambda i: i == 2))).alias("missing"))


def property_table(lines: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """(char, one column per wanted property) of ``lines (value)`` as ``U+XXXX <tab> property <tab> value``; comments are skipped."""
    p = F.split("value", "\t")
    x = lines.where("value is not null and not startswith(value, '#')").select(p[0].alias("cp"), F.get(p, F.lit(1)).alias("property"), F.get(p, F.lit(2)).alias("v")).where(F.col("property").isin(*wanted))
    char = F.decode(F.unhex(F.lpad(F.substring("cp", 3, 8), 8, "0")), "UTF-32")
    return x.groupBy(char.alias("char")).pivot("property", list(wanted)).agg(F.first("v"))


def prune_merges(tokens: DataFrame, merges: list[tuple[str, str]], removed: set[str], protected: set[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(tokens (token, id) renumbered, merges) of a merge vocabulary without ``removed`` tokens.

    Parts from which a protected token is merged stay. Merges whose parts or result are gone are dropped. The
    merge list is a driver-side list of the vocabulary's size.
    """
    made: dict[str, tuple[str, str]] = {}
    for a, b in merges:
        made.setdefault(a + b, (a, b))
    todo, keep = list(protected), set()
    while todo:
        t = todo.pop()
        if t not in keep:
            keep.add(t)
            todo += made.get(t, ())
    gone = removed - keep
    left = [(a, b) for a, b in merges if not {a, b, a + b} & gone]
    old = tokens.where(~F.col("token").isin(*sorted(gone))) if gone else tokens
    return old.select("token", (F.row_number().over(Window.orderBy("id")) - 1).cast("bigint").alias("id")), left


def violations(table: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, n): rows that break each rule, given as SQL conditions that must hold; a null condition is a violation."""
    x = table.select(*(F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in rules.items()))
    return x.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules))).alias("v")).select("v.rule", "v.n")


def feature_pairs(index: DataFrame) -> DataFrame:
    """(char, feature) of a token index (char, ids, mask, field): active positions as ``field:id``, special ids left out."""
    z = F.filter(F.arrays_zip(F.col("ids").alias("i"), F.col("mask").alias("m")), lambda x: x["m"] & (x["i"] > 1))
    return index.select("char", "field", F.explode(z).alias("z")).select("char", F.concat_ws(":", "field", F.col("z.i").cast("string")).alias("feature")).distinct()
