"""Writers: partitioned parquet, message and training exports, reports and versioned run directories."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: list[str] | None = None, rows_per_file: int = 0) -> None:
    """Zstandard parquet, by partition columns and at most so many rows a file; the commit is atomic."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*by) if by else w).parquet(path)


def messages(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """``df (text)`` as JSON lines of one assistant message each; null and empty texts are left out."""
    m = F.array(F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")))
    df.where("text <> ''").select(m.alias("messages")).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(path)


def training_set(df: DataFrame, path: str) -> None:
    """``df (split, row_number, messages, ...)`` as one parquet by split and as JSON lines of messages; ``row_number`` ties the two."""
    parquet(df, f"{path}/rows", by=["split"])
    df.select("split", "row_number", "messages").repartition("split").sortWithinPartitions("row_number").write.mode("overwrite").partitionBy("split").json(f"{path}/messages")


def report(path: str, data: dict) -> None:
    """A JSON report with sorted keys, moved into place when complete."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    tmp = p.with_name(f".{p.name}.{os.getpid()}")
    tmp.write_text(json.dumps(data, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    os.replace(tmp, p)


def run_directory(root: str) -> str:
    """A new directory v1, v2, ... below ``root``; two callers never get the same."""
    Path(root).mkdir(parents=True, exist_ok=True)
    n = 1 + max((int(p.name[1:]) for p in Path(root).glob("v*") if p.name[1:].isdigit()), default=0)
    while True:
        try:
            (Path(root) / f"v{n}").mkdir()
            return str(Path(root) / f"v{n}")
        except FileExistsError:
            n += 1


def single_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """A small table as one CSV or TSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
