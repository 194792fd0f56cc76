"""Readers: raw files as rows with their place of origin, and rejects beside them.

Line formats go through Spark's text reader, so splitting and decompression stay in the JVM. Archives and
zstandard streams are read as whole files by Arrow-batched Python, one file at a time.
"""

from __future__ import annotations

import glob as _glob
import io
import json
import os
import re
import tarfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = {"jsonl": (".jsonl", ".jsonl.gz"), "parquet": (".parquet",), "text": (".txt",), "tar_jsonl": (".tar", ".tar.gz", ".tgz", ".tar.xz"), "zstd_jsonl": (".jsonl.zst", ".zst"), "csv": (".csv",), "tsv": (".tsv", ".para"), "json": (".json",)}
LINES = "path string, member string, row_index bigint, value string"


def expand(pattern: str, kind: str) -> list[str]:
    """Files of a path with environment variables and wildcards, or below a directory by the kind's suffixes; sorted, each once."""
    p = os.path.expandvars(pattern)
    if "$" in p:
        raise ValueError(f"unknown variable in {pattern}")
    hits = _glob.glob(p, recursive=True) if re.search(r"[*?\[]", p) else [p]
    out: set[str] = set()
    for h in hits:
        if os.path.isdir(h):
            out |= {str(x) for x in Path(h).rglob("*") if x.is_file() and str(x).endswith(SUFFIXES[kind])}
        elif os.path.isfile(h):
            out.add(h)
    if not out:
        raise FileNotFoundError(pattern)
    return sorted(out)


def _origin(df: DataFrame) -> DataFrame:
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")
    return df.select(path.alias("path"), F.lit(None).cast("string").alias("member"), "value")


def text_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, member, row_index, value) of the lines of text files, plain or gzip; row_index orders the lines of a file."""
    x = _origin(spark.read.text(paths))
    return x.withColumn("row_index", F.monotonically_increasing_id()).select("path", "member", "row_index", "value")


def _members(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for path, data in zip(part.path, part.content, strict=True):
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tar:
                for m in tar:
                    if m.isfile() and m.name.endswith((".jsonl", ".json")):
                        lines = tar.extractfile(m).read().decode("utf-8", "replace").split("\n")
                        yield pd.DataFrame({"path": path, "member": m.name, "row_index": range(len(lines)), "value": lines})


def _zstd(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    for part in parts:
        for path in part.path:
            with open(path, "rb") as f, zstandard.ZstdDecompressor().stream_reader(f) as r:
                rows, at = [], 0
                for line in io.TextIOWrapper(r, "utf-8", errors="replace"):
                    rows.append(line.rstrip("\n"))
                    if len(rows) == 4096:
                        yield pd.DataFrame({"path": path, "member": None, "row_index": range(at, at + len(rows)), "value": rows})
                        at, rows = at + len(rows), []
                if rows:
                    yield pd.DataFrame({"path": path, "member": None, "row_index": range(at, at + len(rows)), "value": rows})


def archive_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of the .jsonl and .json members of tar archives (also gz, xz)."""
    x = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "content")
    return x.mapInPandas(_members, LINES)


def zstd_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of zstandard files, streamed; a file is one task, as the format cannot be split."""
    x = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return x.mapInPandas(_zstd, LINES)


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines: blank lines are skipped, lines that are no JSON object rejected with a reason."""
    full = lines.where(F.trim("value") != "")
    v = F.try_parse_json("value")
    kind = F.when(v.isNull(), "malformed").when(~F.schema_of_variant(v).startswith("OBJECT"), "not_an_object")
    x = full.withColumn("reject_reason", kind)
    return x.where("reject_reason is null").drop("reject_reason"), x.where("reject_reason is not null")


def jsonl(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    return parse_lines(text_lines(spark, expand(pattern, "jsonl")))


def whole_text(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, id, text): one row per text file, its id the file's stem."""
    x = _origin(spark.read.text(expand(pattern, "text"), wholetext=True))
    return x.select("path", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?\z", 1).alias("id"), F.col("value").alias("text"))


def csv_rows(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of CSV files with a header; a byte order mark before it is dropped."""
    df = spark.read.csv(expand(pattern, "csv"), header=True, multiLine=True, escape='"')
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def tsv_pairs(spark: SparkSession, pattern: str, kind: str) -> DataFrame:
    """(id, source, targets) of correction files: ``csc`` lines are label, source, target...; ``cgec`` lines id, source, target...

    Lines of fewer than three fields have null targets.
    """
    p = F.split("value", "\t")
    x = text_lines(spark, expand(pattern, "tsv")).where(F.trim("value") != "")
    ident = F.concat_ws(":", "path", "row_index") if kind == "csc" else p[0]
    return x.select(ident.alias("id"), F.get(p, F.lit(1)).alias("source"), F.when(F.size(p) >= 3, F.slice(p, 3, F.size(p))).alias("targets"))


def repaired_pairs(lines: DataFrame) -> DataFrame:
    """(source, target) of tab-separated pairs: blank fields collapse, a repeated id before each half is dropped, the first target counts."""
    f = F.filter(F.split("value", "\t"), lambda x: F.trim(x) != "")
    x = lines.select(f.alias("f")).where(F.size("f") >= 2)
    twice = (F.size("f") == 4) & (F.col("f")[0] == F.get("f", F.lit(2)))
    return x.select(F.when(twice, F.get("f", F.lit(1))).otherwise(F.col("f")[0]).alias("source"), F.when(twice, F.get("f", F.lit(3))).otherwise(F.get("f", F.lit(1))).alias("target"))


def nested_records(spark: SparkSession, pattern: str, fields: tuple[str, ...]) -> DataFrame:
    """(path, id, record) of nested JSON files: every object that has one of the text fields; map keys become ids."""

    def walk(x, key):
        if isinstance(x, dict):
            if any(f in x for f in fields):
                yield str(x.get("id", key)), json.dumps(x, ensure_ascii=False, sort_keys=True)
            else:
                for k, v in x.items():
                    yield from walk(v, k)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from walk(v, f"{key}.{i}" if key else str(i))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, value in zip(part.path, part.value, strict=True):
                try:
                    rows = list(walk(json.loads(value), ""))
                except ValueError:
                    rows = []
                yield pd.DataFrame({"path": path, "id": [r[0] for r in rows], "record": [r[1] for r in rows]})

    return _origin(spark.read.text(expand(pattern, "json"), wholetext=True)).select("path", "value").mapInPandas(run, "path string, id string, record string")


def m2_edits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sentence, source, target, edits) of M2 files, the first alignment of each sentence only."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, value in zip(part.path, part.value, strict=True):
                rows = []
                for n, block in enumerate(b for b in value.split("\n\n") if b.strip()):
                    source, target, edits, first = "", None, [], True
                    for line in block.split("\n"):
                        mark, _, rest = line.partition(" ")
                        if mark == "S":
                            source = rest
                        elif mark.startswith("T"):
                            first = target is None
                            target = rest if first else target
                        elif mark == "A" and first:
                            edits.append(rest)
                    rows.append((path, n, source, target, edits))
                yield pd.DataFrame(rows, columns=["path", "sentence", "source", "target", "edits"])

    return _origin(spark.read.text(paths, wholetext=True)).select("path", "value").mapInPandas(run, "path string, sentence bigint, source string, target string, edits array<string>")


def new_characters(spark: SparkSession, path: str) -> DataFrame:
    """(char): the single characters among keys and values of a JSON object or list; none is an error."""
    with open(path, encoding="utf-8") as f:
        x = json.load(f)
    found = [*x.keys(), *x.values()] if isinstance(x, dict) else x
    found = [s["char"] if isinstance(s, dict) else s for s in found]
    chars = sorted({s for s in map(str, found) if len(s) == 1})
    if not chars:
        raise ValueError(f"no characters in {path}")
    return spark.createDataFrame([(c,) for c in chars], "char string")


def planned(spark: SparkSession, files: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns of the planned parquet ``files (path, source)``; a row of another source than planned is an error."""
    plan = [tuple(r) for r in files.select("path", "source").collect()]  # the plan is a driver-side table
    df = spark.read.parquet(*[p for p, _ in plan]).select(*columns, F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "").alias("__path"))
    x = df.join(F.broadcast(files.select(F.col("path").alias("__path"), F.col("source").alias("__source"))), "__path")
    check = F.assert_true(F.col("source") == F.col("__source"), F.lit("row of an unplanned source"))
    return x.where(check.isNull()).drop("__path", "__source")


def read(spark: SparkSession, kind: str, pattern: str, limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows, rejects) by reader kind; an unknown kind is an error."""
    if kind == "jsonl":
        rows, bad = jsonl(spark, pattern)
    elif kind == "tar_jsonl":
        rows, bad = parse_lines(archive_lines(spark, expand(pattern, kind)))
    elif kind == "zstd_jsonl":
        rows, bad = parse_lines(zstd_lines(spark, expand(pattern, kind)))
    elif kind == "parquet":
        rows, bad = spark.read.parquet(*expand(pattern, kind)), None
    elif kind == "text":
        rows, bad = whole_text(spark, pattern), None
    elif kind == "csv":
        rows, bad = csv_rows(spark, pattern), None
    else:
        raise ValueError(f"unknown reader {kind}")
    return (rows.limit(limit) if limit else rows), bad


