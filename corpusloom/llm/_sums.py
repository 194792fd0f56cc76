"""Fixed-size arrays summed over all partitions: in steps of bounded fan-in, so that no task holds an array of every partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import row_bytes

PIECE = 1 << 16
#: Arrays of a piece that one task adds up.
FAN = 64
#: Bits of a hash filter: 32 per value, from 2**20 to 2**27 (16 MB) at most.
FILTER_BITS = (20, 27)


def padded(n: int) -> int:
    """The least whole number of pieces that holds ``n`` entries, in entries."""
    return -(-n // PIECE) * PIECE


def _pack(piece: np.ndarray) -> bytes:
    """A piece as bytes, its entries other than 0 only where those are few."""
    at = np.flatnonzero(piece)
    if len(at) * (2 + piece.itemsize) < piece.nbytes:
        return b"s" + len(at).to_bytes(4, "little") + at.astype("<u2").tobytes() + piece[at].tobytes()
    return b"d" + piece.tobytes()


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    if data[:1] == b"d":
        return np.frombuffer(data, dtype, offset=1)
    n = int.from_bytes(data[1:5], "little")
    out = np.zeros(PIECE, dtype)
    out[np.frombuffer(data, "<u2", n, 5)] = np.frombuffer(data, dtype, n, 5 + 2 * n)
    return out


def emit(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One partition's array (whole pieces) as rows (piece, data); pieces of zeros are left out."""
    pieces = total.reshape(-1, PIECE)
    some = [i for i in range(len(pieces)) if pieces[i].any()]
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_pack(pieces[i]) for i in some], pa.binary())], ["piece", "data"])


def _partitions(df: DataFrame) -> int:
    """About how many partitions a plan has, without running any of it."""
    spark = df.sparkSession
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), len(df.inputFiles()), row_bytes(df) // split)


def summed(df: DataFrame, run: Callable, dtype: str, entries: int, op=np.add) -> np.ndarray:
    """``op`` (a sum or an OR) over the arrays of ``entries`` numbers that ``run`` emits, one per partition of ``df``.

    Every step adds up at most FAN arrays of a piece in a task, and there are as many steps as the number of
    partitions asks for; what reaches the driver is one array. An empty table gives zeros.
    """

    def reduce(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PIECE, dtype)
        for x in part["data"]:
            total = op(total, _unpack(x, dtype))
        return pd.DataFrame({"piece": [part["piece"].iloc[0]], "data": [_pack(total.astype(dtype))], "at": [part["at"].iloc[0]]})

    x, n = df.mapInArrow(run, "piece int, data binary").withColumn("at", F.spark_partition_id()), _partitions(df)
    while True:
        x = x.withColumn("at", F.expr(f"int(at div {FAN})") if n > FAN else F.lit(0)).groupBy("piece", "at").applyInPandas(reduce, "piece int, data binary, at int")
        if n <= FAN:
            break
        n = -(-n // FAN)
    out = np.zeros((padded(entries) // PIECE, PIECE), dtype)
    for piece, data, _ in x.collect():
        out[piece] = op(out[piece], _unpack(data, dtype))
    return out.ravel()[:entries]


def summed_vector(df: DataFrame, run: Callable, entries: int) -> np.ndarray:
    """The sum of the double vectors, at most PIECE long, that ``run`` yields, one per partition."""

    def pad(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(padded(entries))
        total[:entries] = run(parts)
        yield from emit(total)

    return summed(df, pad, "<f8", entries)


def hash_filter(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """(bitmap, shift) of a bigint column: a bit is set where hash >> shift occurs; at most 16 MB."""
    n = hashes.count()
    bits = int(np.clip(np.ceil(np.log2(max(1, n) * 32)), *FILTER_BITS))
    size = padded(1 << (bits - 3))

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint8)
        for batch in parts:
            at = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            np.bitwise_or.at(total, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield from emit(total)

    return summed(hashes, mark, "u1", size, np.bitwise_or), 64 - bits


def holds(bitmap: np.ndarray, shift: int, h: np.ndarray) -> np.ndarray:
    """Mask of the hashes that the filter may hold."""
    at = (h.view(np.uint64) >> np.uint64(shift)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
