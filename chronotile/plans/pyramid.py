"""Tile pyramid (A5, P34): counts of changes by zoom, block and change type, each level from the one below.

Level 16 counts tiles, and a block of zoom z has the sum of its four blocks of zoom z + 1, so the levels above cost a
fraction of the first. Counts are partial results: the pyramid of new events is added by one sum (``merged``). A grid over a
viewport takes the blocks wholly inside from their own level, and the tiles of the blocks on the edge from level 16, which
gives exactly the count of the changes inside. Levels are Parquet partitions sorted by Z-order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotile.functions.zorder import in_ranges, z_key, z_ranges
from chronotile.plans.queries import Range, block_corners, type_predicate
from chronotile.plans.store import Z

TOP = 16
KEYS = ["zoom", "gc", "gr", "change_type_tr"]


def pyramid(changes: DataFrame, top: int = TOP) -> DataFrame:
    """(zoom, gc, gr, change_type_tr, n) for zooms 0 to ``top``; changes without a type column have the type ''."""
    kind = F.coalesce(F.col("change_type_tr"), F.lit("")) if "change_type_tr" in changes.columns else F.lit("")
    base = changes.select(F.lit(top).alias("zoom"), F.col("tile_col").cast("long").alias("gc"), F.col("tile_row").cast("long").alias("gr"), kind.alias("change_type_tr"))
    below = base.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    out = below
    for zoom in range(top - 1, -1, -1):
        up = below.select(F.lit(zoom).alias("zoom"), *[F.shiftright(c, 1).alias(c) for c in ("gc", "gr")], "change_type_tr", "n")
        below = up.groupBy(*KEYS).agg(F.sum("n").alias("n")).checkpoint(eager=True)
        out = out.unionByName(below)
    return out


def merged(*parts: DataFrame) -> DataFrame:
    """One pyramid from those of disjoint sets of changes."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def write_pyramid(levels: DataFrame, path: str) -> None:
    out = levels.withColumn(Z, z_key("gc", "gr"))
    (out.repartitionByRange("zoom", Z).sortWithinPartitions("zoom", Z).write.mode("overwrite").partitionBy("zoom").parquet(path))


def _level(levels: DataFrame, zoom: int, r: Range) -> DataFrame:
    """Blocks of a zoom inside a range of blocks."""
    out = levels.where((F.col("zoom") == zoom) & F.col("gc").between(r[0], r[1]) & F.col("gr").between(r[2], r[3]))
    return out.where(in_ranges(F.col(Z), z_ranges(*r))) if Z in levels.columns else out


def grid_from_pyramid(levels: DataFrame, r: Range, zoom: int, types=None, top: int = TOP) -> DataFrame:
    """Counts per block of ``zoom`` over the tiles of a viewport, as ``queries.grid`` gives them from the changes."""
    if not 0 <= zoom <= top:
        raise ValueError(f"zoom {zoom} is not between 0 and {top}")
    shift = top - zoom
    cell = 1 << shift
    min_col, max_col, min_row, max_row = (max(0, x) for x in r)
    some = levels.where(type_predicate(levels, types))
    inner = (-(-min_col // cell), (max_col + 1) // cell - 1, -(-min_row // cell), (max_row + 1) // cell - 1)  # blocks wholly inside
    outer = (min_col >> shift, max_col >> shift, min_row >> shift, max_row >> shift)
    parts = _level(some, zoom, inner).select("gc", "gr", "n")
    if inner != outer:
        tiles = _level(some, top, (min_col, max_col, min_row, max_row)).select(*[F.shiftright(c, shift).alias(c) for c in ("gc", "gr")], "n")
        parts = parts.unionByName(tiles.where(~(F.col("gc").between(inner[0], inner[1]) & F.col("gr").between(inner[2], inner[3]))))
    return block_corners(parts.groupBy("gc", "gr").agg(F.sum("n").alias("n")), cell, top)
