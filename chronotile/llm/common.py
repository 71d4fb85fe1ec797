"""Small helpers shared by the operators of this subpackage: preparation, Arrow slices, vectorised hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from chronotile.session import ensure_checkpoint_dir, ship_package

SLICE_BYTES = 2 << 20  # text bytes worked on at once inside a task; a longer text forms a slice of its own


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers and the shared checkpoint folder known."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (Spark compares names without case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, *results: str) -> list[str]:
    """Columns of ``df`` that do not have the name of a result."""
    taken = {r.lower() for r in results}
    return [c for c in df.columns if c.lower() not in taken]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. offsets has one entry more than there are rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[at:at + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def byte_lengths(column: pa.Array) -> np.ndarray:
    return np.diff(utf8(column)[1])


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds at most ``limit`` text bytes, or one row."""
    for batch in batches:
        size = byte_lengths(batch.column(text)) + 64
        start, total = 0, 0
        for i, b in enumerate(size):
            if i > start and total + b > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += b
        if start < batch.num_rows:
            yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser, on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each segment values[first[i]:first[i+1]], whatever lies beside it."""
    out, some = np.zeros(len(first) - 1), np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, first[some])
    return out


def unit_interval(x: np.ndarray) -> np.ndarray:
    """uint64 hashes as doubles in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def ascii_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words between ASCII white space, number of words before each text); offsets as from ``utf8``."""
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    keep = ~gap
    begins = keep.copy()
    begins[1:] &= gap[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = keep[edges]
    before = np.concatenate([[0], np.cumsum(begins)])
    starts = np.append(np.flatnonzero(begins[keep]), int(keep.sum())).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.tobytes()), pa.py_buffer(raw[keep].tobytes()))
    return words, before[offsets]
