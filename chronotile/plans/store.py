"""Stored tables of the map layer (S9): Parquet laid out for viewports, points and ids.

Changes carry the Z-order key of their tile (``zkey``) and are range-partitioned and sorted by it, so a viewport is a few
key ranges whose comparisons reach the Parquet scan and skip files and row groups by their statistics. Bloom filters on the
event id, and on image names, let a lookup skip the row groups that cannot hold it. Each write takes a new path (Spark cannot
overwrite a path it is reading), and within a session a table is written once for each state of its input files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotile.functions.zorder import z_key
from chronotile.session import ensure_checkpoint_dir

Z = "zkey"
SORT = [Z, "to_date", "event_id"]


#: Rows of a file: what a task sorts does not grow with the table.
FILE_ROWS = 100_000


def write_changes(changes: DataFrame, path: str, files: int | None = None, group_bytes: int | None = None, rows: int = 0,
                  widen: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """``rows``, if known, gives the number of files where there are many; ``widen`` adds columns of the row itself once it lies in its
    place, so that they are neither moved nor sorted."""
    n = files or max(1, int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // FILE_ROWS))
    placed = changes.withColumn(Z, z_key("tile_col", "tile_row")).repartitionByRange(n, *SORT).sortWithinPartitions(*SORT)
    placed = widen(placed.drop(Z)).withColumn(Z, z_key("tile_col", "tile_row")) if widen else placed
    out = placed.write.mode("overwrite")
    if group_bytes:
        out = out.option("parquet.block.size", group_bytes)
    out.option("parquet.bloom.filter.enabled#event_id", "true").parquet(path)


def write_named(images: DataFrame, path: str) -> None:
    """Images or masks by name or id; sorted within files, so that their bloom filters and statistics are narrow."""
    key = "image" if "image" in images.columns else "event_id"
    images.sortWithinPartitions(key).write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """The pairs table (S6), as its tasks hold it: every step reads it whole."""
    pairs.write.mode("overwrite").parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, write: Callable[[DataFrame, str], None]) -> DataFrame:
    """Write a table to a new path of the shared checkpoint folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    write(df, path)
    return read_changes(df.sparkSession, path)


def bucketed(rows: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """Write a table in buckets of ``key`` (one file each, sorted) and read it back: joins on the key take it as it lies, without an
    exchange or a sort of its side. For keys that hardly repeat, such as image names: a hot key would be one file."""
    spark = rows.sparkSession
    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = f"chronotile_{name}_{uuid.uuid4().hex}"
    out = rows.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
    out.option("path", fresh_path(spark, name)).saveAsTable(table)
    return spark.table(table)


_WRITTEN: dict[tuple, str] = {}


def _state(inputs: list[DataFrame]) -> tuple:
    """Files of the inputs with their size and time: a row for each file."""
    m = F.col("_metadata")
    seen = []
    for i in inputs:
        files = i.select(m.file_path.alias("p"), m.file_size.alias("s"), m.file_modification_time.alias("t")).groupBy("p", "s", "t").count()
        seen.append(files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("p", "s", "t", "count"))).first())
    return tuple(map(tuple, seen))


def served(inputs: list[DataFrame], name: str, build: Callable[[], DataFrame], write: Callable[[DataFrame, str], None]) -> DataFrame:
    """The stored table ``name`` over the given input tables: built and written at first use, read afterwards, built anew when a
    file of the inputs has changed."""
    spark = inputs[0].sparkSession
    key = (spark.sparkContext.applicationId, name, _state(inputs))
    if key not in _WRITTEN:
        path = fresh_path(spark, name)
        write(build(), path)
        _WRITTEN[key] = path
    return read_changes(spark, _WRITTEN[key])


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
