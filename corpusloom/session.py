"""Session helpers: table access and lineage cutting through shared storage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions


def ship(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, wherever they run; once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(target))
    sc._corpusloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame, least_bytes: int = 2 << 20) -> DataFrame:
    """A table whose few unsplittable files would leave most cores idle, dealt out evenly; others as they are.

    Large tables have more splits than cores and are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if row_bytes(df) < least_bytes or df._jdf.queryExecution().toRdd().getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session's spark.checkpoint.dir names it.

    Where the setting is absent, a session on one machine (tests) gets a temporary folder; on a cluster, where no
    other machine would see such a folder, it is an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(set_dir)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return set_dir


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver ends."""
    sc = spark.sparkContext
    own = f"{shared_dir(spark).rstrip('/')}/{sc.applicationId}"
    if getattr(sc, "_corpusloom_dir", None) != own:
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._corpusloom_dir = own
    return own


def materialize(df: DataFrame, name: str = "t", replaces: DataFrame | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back, which cuts its lineage.

    Unlike a cached or locally checkpointed frame the copy survives the loss of executors, and as
    parquet it keeps column pruning and statistics for the steps that read it. A loop passes the copy of
    its last round as ``replaces``; that is deleted once the new one is written.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if replaces is not None:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(replaces._corpusloom_path)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    return out


def row_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan in bytes; of a written table it is the file size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: A written table up to this many rows and compressed bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16 << 20


def small(df: DataFrame) -> DataFrame:
    """A table written once, so that its size is measured and not estimated, and broadcast if it is small."""
    written = materialize(df, "index")
    return functions.broadcast(written) if row_bytes(written) <= BROADCAST_BYTES and written.count() <= BROADCAST_ROWS else written


def _versions(spark: SparkSession, path: str) -> tuple[list[int], object, object]:
    """(complete versions below a path, its file system, the JVM's Path)."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = make(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(make(f"{path}/{n}/_READY"))), fs, make


def save_version(tables: dict[str, DataFrame], path: str) -> int:
    """Write tables as the next version below ``path``, on any file system; it counts only once all of it is written."""
    spark = next(iter(tables.values())).sparkSession
    known, fs, make = _versions(spark, path)
    n = (known[-1] if known else 0) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/v{n:06}/{name}")
    fs.create(make(f"{path}/v{n:06}/_READY"), True).close()
    return n


def load_version(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame] | None:
    """The tables of the last complete version below ``path``; None where there is none."""
    known, _, _ = _versions(spark, path)
    return {name: spark.read.parquet(f"{path}/v{known[-1]:06}/{name}") for name in names} if known else None
