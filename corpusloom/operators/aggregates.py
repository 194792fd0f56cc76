"""Corpus statistics: calibration, mixture metrics and checks, frequencies, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def ratio(num: Column, den: Column) -> Column:
    """Sum of ``num`` over sum of ``den``, null where that is 0."""
    return F.sum(num) / F.nullif(F.sum(den), F.lit(0))


def calibration(rows: DataFrame) -> DataFrame:
    """(source, bucket, docs, tokens, chars, doc_rate, tokens_per_doc) over exploded ``eligible`` buckets.

    A row of several buckets counts in each; ``doc_rate`` is its share of the source's rows, at most 1.
    """
    per = rows.groupBy("source").agg(F.count("*").alias("all_docs"))
    x = rows.select("source", "tokens", "char_count", F.explode("eligible").alias("bucket")).groupBy("source", "bucket").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.sum("char_count").alias("chars"))
    return x.join(per, "source").select("source", "bucket", "docs", "tokens", "chars", (F.col("docs") / F.greatest(F.lit(1), "all_docs")).alias("doc_rate"), (F.col("tokens") / F.greatest(F.lit(1), "docs")).alias("tokens_per_doc"))


def mixture_metrics(rows: DataFrame) -> DataFrame:
    """(bucket, source, domain, level, docs, tokens, long_tokens, classical_tokens) by grouping sets: in all, by bucket, by bucket and source, by bucket and domain."""
    rows.createOrReplaceTempView("corpusloom_mixture_rows")
    return rows.sparkSession.sql(
        """SELECT bucket, source, domain, grouping_id(bucket, source, domain) AS level, count(*) AS docs, sum(tokens) AS tokens,
                  sum(CASE WHEN char_count >= 8192 THEN tokens ELSE 0 END) AS long_tokens, sum(CASE WHEN classical THEN tokens ELSE 0 END) AS classical_tokens
           FROM corpusloom_mixture_rows GROUP BY GROUPING SETS ((), (bucket), (bucket, source), (bucket, domain))"""
    )


def mixture_checks(metrics: DataFrame, targets: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(bucket, source, target_fraction, actual_fraction, passed): shares of a bucket's tokens against ``targets (bucket, source, target_fraction)``."""
    whole = metrics.where("level = 3").select("bucket", F.col("tokens").alias("whole"))
    part = metrics.where("level = 1").select("bucket", "source", "tokens")
    x = targets.join(part, ["bucket", "source"], "left").join(whole, "bucket", "left")
    actual = F.coalesce("tokens", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("whole", F.lit(0)))
    return x.select("bucket", "source", "target_fraction", actual.alias("actual_fraction"), (F.abs(actual - F.col("target_fraction")) <= tolerance).alias("passed"))


def character_frequencies(docs: DataFrame, wanted: Column) -> DataFrame:
    """(char, tf, df, source_df) of the characters of ``docs (doc_id, source, text)`` that ``wanted`` (over ``char``) keeps.

    Characters are counted within a text first, so the shuffle carries one row per text and character.
    """
    own = docs.where("text is not null").select("doc_id", "source", F.explode(F.split("text", "")).alias("char")).where(wanted)
    per = own.groupBy("doc_id", "source", "char").agg(F.count("*").alias("n"))
    by_source = per.groupBy("char", "source").agg(F.sum("n").alias("tf"), F.countDistinct("doc_id").alias("df"))
    return by_source.groupBy("char").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"), F.count("source").alias("source_df"))


def distribution(rows: DataFrame, keys: list[str], value: str = "tokens") -> DataFrame:
    """(keys, docs, tokens): rows and sums by the given keys."""
    return rows.groupBy(*keys).agg(F.count("*").alias("docs"), F.sum(value).alias("tokens"))


def task_report(rows: DataFrame, value: str, group: str = "task") -> DataFrame:
    """Rows, distinct books and docs, mean, nearest-rank 95th and 99th percentile and maximum of ``value`` by task."""
    return rows.groupBy(group).agg(
        F.count("*").alias("rows"), F.countDistinct("book").alias("books"), F.countDistinct("doc").alias("docs"), F.avg(value).alias("mean"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.expr(f"percentile_disc(0.99) WITHIN GROUP (ORDER BY {value})").alias("p99"), F.max(value).alias("most"),
    )


def histogram(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n): value counts of several columns in one pass; nulls are a value."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def acceptance(selected: DataFrame, least_groups: int, least_books: int, most_share: float) -> DataFrame:
    """(task, rows, groups, books, max_book_share, passed) of a selected set."""
    per = selected.groupBy("task", "book").agg(F.count("*").alias("n"))
    top = per.where("book is not null").groupBy("task").agg(F.max("n").alias("top"))
    x = selected.groupBy("task").agg(F.count("*").alias("rows"), F.countDistinct("doc").alias("groups"), F.countDistinct("book").alias("books")).join(top, "task", "left")
    share = F.coalesce("top", F.lit(0)) / F.col("rows")
    return x.select("task", "rows", "groups", "books", share.alias("max_book_share"), ((F.col("groups") >= least_groups) & (F.col("books") >= least_books) & (share <= most_share)).alias("passed"))


def shares(rows: DataFrame, key: str) -> DataFrame:
    """(value, n, share) of a column's values over all rows."""
    n = rows.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n"))
    return n.select("value", "n", (F.col("n") / F.lit(max(1, rows.count()))).alias("share"))


def field_frequencies(rows: DataFrame, json: str) -> DataFrame:
    """(field, n): how many rows' JSON objects have each field; rows that are not objects count under ``<invalid>``."""
    keys = F.expr(f"json_object_keys({json})")
    return rows.select(F.explode(F.coalesce(keys, F.array(F.lit("<invalid>")))).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def perplexity(rows: DataFrame, key: str = "domain") -> DataFrame:
    """Perplexity, bits per character and byte, tokens per character by key from ``nll, token_count, char_count, byte_count`` sums; null where nothing was counted."""
    nll = F.sum("nll")
    nats = lambda c: nll / F.nullif(F.sum(c), F.lit(0)) / F.log(F.lit(2.0))
    return rows.groupBy(key).agg(F.count("*").alias("documents"), F.sum("token_count").alias("tokens"), F.exp(nll / F.nullif(F.sum("token_count"), F.lit(0))).alias("ppl"), nats("char_count").alias("bpc"), nats("byte_count").alias("bpb"), ratio(F.col("token_count"), F.col("char_count")).alias("tokens_per_char"))


def macro_mean(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """(outer, macro): mean over the inner groups of their means."""
    return rows.groupBy(outer, inner).agg(F.avg(value).alias("m")).groupBy(outer).agg(F.avg("m").alias("macro"))


def numeric_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Count, least, mean, median, nearest-rank 95th percentile and greatest of a column by key; nulls do not count."""
    return rows.groupBy(key).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.max(value).alias("most"))


def input_inspection(docs: DataFrame, key: str = "domain") -> DataFrame:
    """(key, documents, empty, chars, bytes) of ``docs (text)``; a null text counts as empty."""
    t = F.coalesce("text", F.lit(""))
    return docs.groupBy(key).agg(F.count("*").alias("documents"), F.count_if(t == "").alias("empty"), F.sum(F.length(t)).alias("chars"), F.sum(F.octet_length(t)).alias("bytes"))


