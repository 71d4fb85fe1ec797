"""Hotspots: density clustering (DBSCAN) of changes on their tile centroids, projected to km.

x = lon * 111.32 * cos(mean lat), y = lat * 111.32; eps is inclusive, a point counts itself, and rows on one tile
count separately (weight = rows on the tile). Clusters are numbered 1.. by their first core row in
(tile_col, tile_row) order; a border tile takes the smallest number among its core neighbours; noise is 0.

Distributed form (no list of near pairs, no single task holding a group):
1. collapse rows to tiles with a weight (exact: rows of one tile share coordinates);
2. grid of cells with side just under eps/sqrt(2); all tiles of a cell are within eps of each other, and neighbours
   lie only in the 5x5 block of cells around a tile. A cell's tiles travel as one array, which holds at most
   (side / tile)^2 distinct tiles whatever the row skew;
3. a cell whose weight reaches min_samples has only core tiles; only tiles of lighter cells count their neighbours,
   cell by cell (equi-join on the cell key, one row per tile and cell);
4. core tiles of one cell are always within eps, so clusters are connected components of the graph of cells; two cells
   are linked if any two of their core tiles are within eps (one row per pair of cells, decided at the first hit);
5. cluster numbers come from the prefix-numbering helper over the smallest core tile of each component;
6. border tiles look for the smallest cluster number among the cells with a core tile within eps.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotile.functions import geo
from chronotile.operators.components import connected_components
from chronotile.operators.numbering import with_row_number
from chronotile.params import Params

_SHIFT = 2**30


def _cell_id(cx, cy):
    return (cx + F.lit(_SHIFT)) * F.lit(2**31) + (cy + F.lit(_SHIFT))


def tile_points(changes: DataFrame, p: Params) -> DataFrame:
    """One row per tile: tile_col, tile_row, w, lon, lat, x, y, cx, cy (checkpointed: reused by every pass)."""
    tiles = changes.groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("w"))
    tiles = tiles.select(
        "tile_col", "tile_row", "w",
        geo.tile_centroid_lon("tile_col", p.zoom).alias("lon"),
        geo.tile_centroid_lat("tile_row", p.zoom).alias("lat"),
    )
    mean_lat = tiles.select((F.sum(F.col("w") * F.col("lat")) / F.sum("w"))).scalar()
    side = p.hotspot_eps_km / math.sqrt(2.0) * (1.0 - 1e-9)
    pts = tiles.select(
        "tile_col", "tile_row", "w", "lon", "lat",
        (F.col("lon") * geo.km_scale(mean_lat)).alias("x"),
        (F.col("lat") * F.lit(geo.KM_PER_DEGREE)).alias("y"),
    )
    pts = pts.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    return pts.checkpoint(eager=True)


def neighbour_pairs(pts: DataFrame, p: Params) -> DataFrame:
    """All ordered tile pairs (a, b) within eps, including a == b: a_col, a_row, b_col, b_row, b_w, d2. The radius query
    itself; the clustering does not use it."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-2, 3) for dy in range(-2, 3)])
    a = pts.select(
        F.col("tile_col").alias("a_col"), F.col("tile_row").alias("a_row"), F.col("x").alias("ax"), F.col("y").alias("ay"),
        F.explode(offsets).alias("o"), "cx", "cy",
    ).select("a_col", "a_row", "ax", "ay", (F.col("cx") + F.col("o.dx")).alias("ncx"), (F.col("cy") + F.col("o.dy")).alias("ncy"))
    b = pts.select(
        F.col("tile_col").alias("b_col"), F.col("tile_row").alias("b_row"), F.col("w").alias("b_w"),
        F.col("x").alias("bx"), F.col("y").alias("by"), F.col("cx").alias("ncx"), F.col("cy").alias("ncy"),
    )
    j = a.join(b, ["ncx", "ncy"])
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    return j.select("a_col", "a_row", "b_col", "b_row", "b_w", d2.alias("d2")).where(
        F.col("d2") <= F.lit(p.hotspot_eps_km * p.hotspot_eps_km)
    )


def _around(df: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each row once per cell around its own: adds ncx, ncy."""
    cells = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    return df.withColumn("o", F.explode(cells)).withColumn("ncx", F.col("cx") + F.col("o.dx")).withColumn(
        "ncy", F.col("cy") + F.col("o.dy")).drop("o")


def _members(pts: DataFrame) -> DataFrame:
    """One row per cell (ncx, ncy): its tiles as an array of (x, y, w), bounded by geometry."""
    return pts.groupBy(F.col("cx").alias("ncx"), F.col("cy").alias("ncy")).agg(F.collect_list(F.struct("x", "y", "w")).alias("members"))


def _near(ax, ay, b, p: Params):
    dx, dy = ax - b["x"], ay - b["y"]
    return dx * dx + dy * dy <= F.lit(p.hotspot_eps_km * p.hotspot_eps_km)


_BLOCK = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]
_HALF = [(dx, dy) for dx, dy in _BLOCK if (dx, dy) > (0, 0)]  # each pair of cells once


def neighbour_counts(of: DataFrame, pts: DataFrame, p: Params) -> DataFrame:
    """tile_col, tile_row, n: weight of the tiles within eps of each tile of ``of`` (columns of ``pts``), itself included."""
    a = _around(of.select("tile_col", "tile_row", "x", "y", "cx", "cy"), _BLOCK).join(_members(pts), ["ncx", "ncy"])
    here = F.aggregate("members", F.lit(0).cast("long"), lambda s, b: s + F.when(_near(F.col("x"), F.col("y"), b, p), b["w"]).otherwise(0))
    return a.groupBy("tile_col", "tile_row").agg(F.sum(here).alias("n"))


def core_tiles(pts: DataFrame, p: Params) -> DataFrame:
    """tile_col, tile_row, w, cx, cy, lon, lat, n (weighted neighbours incl. itself), is_core, for every tile."""
    n = neighbour_counts(pts, pts, p)
    return pts.select("tile_col", "tile_row", "w", "cx", "cy", "lon", "lat").join(n, ["tile_col", "tile_row"]).withColumn(
        "is_core", F.col("n") >= F.lit(p.hotspot_min_samples)
    )


def core_flags(pts: DataFrame, p: Params) -> DataFrame:
    """``pts`` with is_core; only tiles of cells lighter than min_samples count neighbours."""
    weight = pts.groupBy("cx", "cy").agg((F.sum("w") >= F.lit(p.hotspot_min_samples)).alias("heavy"))
    flagged = pts.join(weight, ["cx", "cy"])
    n = neighbour_counts(flagged.where(~F.col("heavy")), pts, p)
    return flagged.join(n, ["tile_col", "tile_row"], "left").withColumn(
        "is_core", F.col("heavy") | (F.coalesce("n", F.lit(0)) >= F.lit(p.hotspot_min_samples))).drop("heavy", "n")


def core_cell_links(core: DataFrame, p: Params) -> DataFrame:
    """u, v: pairs of cells that hold two core tiles within eps of each other."""
    cells = _members(core)
    own = cells.select(F.col("ncx").alias("cx"), F.col("ncy").alias("cy"), F.col("members").alias("mine"))
    pairs = _around(own, _HALF).join(cells, ["ncx", "ncy"])
    linked = F.exists("mine", lambda a: F.exists("members", lambda b: _near(a["x"], a["y"], b, p)))
    return pairs.where(linked).select(_cell_id(F.col("cx"), F.col("cy")).alias("u"), _cell_id(F.col("ncx"), F.col("ncy")).alias("v"))


def tile_clusters(changes: DataFrame, p: Params) -> DataFrame:
    """Per tile: tile_col, tile_row, w, lon, lat, is_core, hotspot_id (0 = noise)."""
    pts = core_flags(tile_points(changes, p), p).withColumn("cell", _cell_id(F.col("cx"), F.col("cy"))).checkpoint(eager=True)
    core = pts.where("is_core")
    comp = connected_components(core_cell_links(core, p), core.select(F.col("cell").alias("node")))
    of_cell = core.groupBy("cell", "cx", "cy").agg(F.min(F.struct("tile_col", "tile_row")).alias("first")).join(
        comp.select(F.col("node").alias("cell"), "component"), "cell").checkpoint(eager=True)
    first = of_cell.groupBy("component").agg(F.min("first").alias("first"))
    numbered = with_row_number(
        first.select("component", F.col("first.tile_col").alias("fc"), F.col("first.tile_row").alias("fr")),
        ["fc", "fr"], "hotspot_id",
    )
    ids = of_cell.join(numbered.select("component", "hotspot_id"), "component").select("cell", "cx", "cy", "hotspot_id").checkpoint(eager=True)
    # border tiles: smallest cluster number among the cells with a core neighbour
    beside = _members(core).join(ids.select(F.col("cx").alias("ncx"), F.col("cy").alias("ncy"), "hotspot_id"), ["ncx", "ncy"])
    border = (
        _around(pts.where(~F.col("is_core")).select("tile_col", "tile_row", "x", "y", "cx", "cy"), _BLOCK).join(beside, ["ncx", "ncy"])
        .where(F.exists("members", lambda b: _near(F.col("x"), F.col("y"), b, p)))
        .groupBy("tile_col", "tile_row").agg(F.min("hotspot_id").alias("border_id"))
    )
    out = pts.join(ids.select("cell", "hotspot_id"), "cell", "left").join(border, ["tile_col", "tile_row"], "left")
    hid = F.when(F.col("is_core"), F.col("hotspot_id")).otherwise(F.coalesce(F.col("border_id"), F.lit(0)))
    return out.select("tile_col", "tile_row", "w", "lon", "lat", "is_core", hid.cast("long").alias("hotspot_id"))


def hotspots(changes: DataFrame, p: Params) -> DataFrame:
    """Changes with hotspot_id and the weighted centroid of their cluster (null for noise).

    The input is read twice (tile weights, then the join back), so it is checkpointed once first."""
    changes = changes.checkpoint(eager=True)
    tc = tile_clusters(changes, p).checkpoint(eager=True)
    cent = tc.where(F.col("hotspot_id") > 0).groupBy("hotspot_id").agg(
        (F.sum(F.col("w") * F.col("lon")) / F.sum("w")).alias("hotspot_centroid_lon"),
        (F.sum(F.col("w") * F.col("lat")) / F.sum("w")).alias("hotspot_centroid_lat"),
    )
    per_tile = tc.select("tile_col", "tile_row", "hotspot_id").join(cent, "hotspot_id", "left")
    base = changes.drop("hotspot_id", "hotspot_centroid_lon", "hotspot_centroid_lat")
    return base.join(per_tile, ["tile_col", "tile_row"], "left").select(
        *base.columns, F.coalesce("hotspot_id", F.lit(0)).alias("hotspot_id"), "hotspot_centroid_lon", "hotspot_centroid_lat"
    )
