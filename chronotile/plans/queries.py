"""Map query layer (A1-A5, F3-F10, T3-T5, P25, P26, P34, P35, X11) as DataFrame functions.

Parameters are literals in Column expressions (``between``, ``isin``), never SQL text, so Catalyst pushes the
tile-range predicate into the Parquet scan (``PushedFilters``) and prunes row groups when files are sorted by tile.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotile.functions import geo
from chronotile.functions.images import basename
from chronotile.functions.zorder import in_ranges, z_ranges

# The property keys of a map feature, in output order.
FEATURE_KEYS = [
    "event_id", "tile_col", "tile_row", "centroid_lon", "centroid_lat", "from_date", "to_date",
    "from_release_id", "to_release_id", "change_type_tr", "change_type_en", "land_cover_from", "land_cover_to",
    "importance", "episode_id", "episode_index", "episode_count", "hotspot_id", "dino_similarity", "ssim_score",
    "change_ratio", "largest_run", "before_image", "after_image", "mask_image", "ai_is_real", "ai_change_type",
    "ai_cause_tr", "ai_confidence",
]

Range = tuple[int, int, int, int]  # (min_col, max_col, min_row, max_row)


def type_predicate(df: DataFrame, types: Sequence[str] | None) -> Column:
    """True when no types are given; false when the type column is missing; else ``IN``."""
    if not types:
        return F.lit(True)
    if "change_type_tr" not in df.columns:
        return F.lit(False)
    return F.col("change_type_tr").isin(list(types))


def date_predicate(from_date: str | None, to_date: str | None, typed: bool = False) -> Column:
    """Inclusive range on ``to_date``. Default compares text (as stored, so 'YYYY-12-31' excludes that day's
    'YYYY-12-31T..' rows); ``typed=True`` compares calendar days."""
    c = F.col("to_date")
    pred = F.lit(True)
    if typed:
        d = F.to_date(F.try_to_timestamp(c))
        if from_date:
            pred = pred & (d >= F.to_date(F.lit(from_date)))
        if to_date:
            pred = pred & (d <= F.to_date(F.lit(to_date)))
        return pred
    if from_date:
        pred = pred & (c >= F.lit(from_date))
    if to_date:
        pred = pred & (c <= F.lit(to_date))
    return pred


def split_types(text: str | None) -> list[str]:
    return [t for t in (text or "").split(",") if t]


def in_viewport(changes: DataFrame, r: Range, types=None, from_date=None, to_date=None, typed_dates=False) -> DataFrame:
    min_col, max_col, min_row, max_row = r
    if "zkey" in changes.columns:  # the stored table: ranges of its order select files and row groups
        changes = changes.where(in_ranges(F.col("zkey"), z_ranges(*r)))
    return changes.where(
        F.col("tile_col").between(min_col, max_col)
        & F.col("tile_row").between(min_row, max_row)
        & type_predicate(changes, types)
        & date_predicate(from_date, to_date, typed_dates)
    )


def viewport_count(changes: DataFrame, r: Range, **kw) -> DataFrame:
    return in_viewport(changes, r, **kw).agg(F.count(F.lit(1)).alias("n"))


def viewports_frame(spark, ranges: Sequence[tuple]) -> DataFrame:
    """A table of viewports (viewport_id, min_col, max_col, min_row, max_row)."""
    return spark.createDataFrame(list(ranges), "viewport_id int, min_col int, max_col int, min_row int, max_row int")


def in_viewports(changes: DataFrame, viewports: DataFrame) -> DataFrame:
    """Changes tagged with every viewport containing them: an equi-join on square blocks of tiles.

    The side of a viewport's blocks is the power of two above its longer span, so it meets at most four blocks; a
    change is looked up once per side that occurs (at most one per bit of a tile number)."""
    span = F.greatest(F.col("max_col") - F.col("min_col"), F.col("max_row") - F.col("min_row")).cast("long")
    v = viewports.where("max_col >= min_col AND max_row >= min_row").withColumn("v_side", F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(span))))
    sides = sorted(r[0] for r in v.select("v_side").distinct().collect())  # at most one per bit

    def block(c: str) -> Column:
        return F.floor(F.col(c) / F.col("v_side")).cast("long")

    v = v.withColumn("v_col", F.explode(F.sequence(block("min_col"), block("max_col"))))
    v = v.withColumn("v_row", F.explode(F.sequence(block("min_row"), block("max_row"))))
    rows = changes.withColumn("v_side", F.explode(F.array(*[F.lit(s).cast("long") for s in sides]).cast("array<long>")))
    rows = rows.withColumn("v_col", block("tile_col")).withColumn("v_row", block("tile_row"))
    hit = F.col("tile_col").between(F.col("min_col"), F.col("max_col")) & F.col("tile_row").between(F.col("min_row"), F.col("max_row"))
    return rows.join(v, ["v_side", "v_col", "v_row"]).where(hit).drop("v_side", "v_col", "v_row", "min_col", "max_col", "min_row", "max_row")


def limit_for(limit: int | None, p) -> int:
    """``0``/None -> default; a limit below 0 or above the hard limit is refused."""
    n = int(limit or p.max_features)
    if not 0 <= n <= p.hard_limit:
        raise ValueError(f"limit {n} is not between 0 and {p.hard_limit}")
    return n


def order_key(df: DataFrame) -> list[Column]:
    if "importance" in df.columns:
        return [F.col("importance").desc_nulls_last(), F.col("event_id").asc()]
    return [F.col("event_id").asc()]


def feature_geometry(df: DataFrame, zoom: int = 16) -> Column:
    """Geometry text preference: non-empty mask polygon, else tile polygon text, else computed from the tile."""
    parts = []
    if "geometry_mask" in df.columns:
        parts.append(F.nullif(F.col("geometry_mask"), F.lit("")))
    if "geometry" in df.columns:
        parts.append(F.nullif(F.col("geometry"), F.lit("")))
    parts.append(geo.tile_polygon_json("tile_col", "tile_row", zoom))
    return F.coalesce(*parts)


GEOMETRY_SCHEMA = "struct<type:string, coordinates:string>"


def feature(df: DataFrame, zoom: int = 16) -> Column:
    """GeoJSON Feature struct: geometry parsed from text (coordinates kept as JSON text), properties present."""
    props = [F.col(k) for k in FEATURE_KEYS if k in df.columns]
    g = F.from_json(feature_geometry(df, zoom), GEOMETRY_SCHEMA)
    return F.struct(F.lit("Feature").alias("type"), g.alias("geometry"), F.struct(*props).alias("properties"))


def viewport_features(changes: DataFrame, r: Range, types=None, from_date=None, to_date=None, limit=None,
                      p=None, typed_dates=False) -> DataFrame:
    """Top-N features by importance (ties by event id) in a viewport: TakeOrderedAndProject, no global sort."""
    from chronotile.params import DEFAULT

    p = p or DEFAULT
    sel = in_viewport(changes, r, types, from_date, to_date, typed_dates)
    return sel.orderBy(*order_key(sel)).limit(limit_for(limit, p))


def scan_viewports(changes: DataFrame, ranges: Sequence[Range], most: int = 64) -> DataFrame:
    """The rows of a stored table that any of a few viewports can need, by key ranges; more than ``most`` viewports, or a table
    without key, are read whole."""
    if "zkey" not in changes.columns or len(ranges) > most:
        return changes
    return changes.where(in_ranges(F.col("zkey"), [x for r in ranges for x in z_ranges(*r, most=4)]))


def viewports_top_features(changes: DataFrame, viewports: DataFrame, limit=None, p=None) -> DataFrame:
    """Top-N per viewport for a batch of viewports, in two steps: the N first rows of each share of a viewport (by a hash
    of the event id), then the N first of those, so that no task holds a whole viewport."""
    from chronotile.params import DEFAULT

    p = p or DEFAULT
    tagged = in_viewports(changes, viewports)
    n = limit_for(limit, p)
    shares = max(1, int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tagged = tagged.withColumn("_share", F.pmod(F.xxhash64("event_id"), F.lit(shares)))
    for keys in (["viewport_id", "_share"], ["viewport_id"]):
        w = Window.partitionBy(*keys).orderBy(*order_key(tagged))
        tagged = tagged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return tagged.drop("_share")


def grid(changes: DataFrame, r: Range, cell: int, types=None, from_date=None, to_date=None, zoom: int = 16) -> DataFrame:
    """Counts per ``cell x cell`` block of tiles (integer division) with the block polygon corners."""
    sel = in_viewport(changes, r, types, from_date, to_date)
    g = sel.groupBy(
        F.floor(F.col("tile_col") / cell).cast("long").alias("gc"), F.floor(F.col("tile_row") / cell).cast("long").alias("gr")
    ).agg(F.count(F.lit(1)).alias("n"))
    return block_corners(g, cell, zoom)


def block_corners(g: DataFrame, cell: int, zoom: int = 16) -> DataFrame:
    """Blocks (gc, gr, n) with the corners of their polygon."""
    col0, row0 = F.col("gc") * cell, F.col("gr") * cell
    col1, row1 = col0 + cell - 1, row0 + cell - 1
    return g.select(
        "gc", "gr", "n",
        geo.col_to_lon(col0, zoom).alias("west"),
        geo.row_to_lat(row1 + 1, zoom).alias("south"),
        geo.col_to_lon(col1 + 1, zoom).alias("east"),
        geo.row_to_lat(row0, zoom).alias("north"),
    )


def grid_density(grid_df: DataFrame) -> DataFrame:
    """Density class of each block relative to the busiest block: high (>0.5), mid (>0.2), low."""
    mx = grid_df.select(F.max("n")).scalar()
    share = F.col("n").cast("double") / mx
    return grid_df.select(
        "*",
        share.alias("share"),
        F.when(share > 0.5, F.lit("high")).when(share > 0.2, F.lit("mid")).otherwise(F.lit("low")).alias("density"),
    )


def overview(changes: DataFrame) -> DataFrame:
    """Totals: rows, distinct tiles, min/max ``to_date``, min ``from_date`` (one row)."""
    return changes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(F.col("tile_col"), F.col("tile_row")).alias("tiles"),
        F.min("to_date").alias("min_to"),
        F.max("to_date").alias("max_to"),
        F.min("from_date").alias("min_from"),
    )


def counts_by_type(changes: DataFrame, drop_empty: bool = True) -> DataFrame:
    """Count per change type, most frequent first (ties by type); the overview drops the empty type."""
    g = changes.groupBy(F.col("change_type_tr").alias("type")).agg(F.count(F.lit(1)).alias("count"))
    if drop_empty:
        g = g.where(F.col("type") != "")
    return g.orderBy(F.col("count").desc(), F.col("type").asc())


def counts_by_year(changes: DataFrame, drop_empty: bool = False) -> DataFrame:
    """Count per first four characters of ``to_date``, ascending; the overview keeps the empty year."""
    g = changes.groupBy(F.substring("to_date", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("count"))
    if drop_empty:
        g = g.where(F.col("year") != "")
    return g.orderBy(F.col("year").asc_nulls_last())


def year_playback(changes: DataFrame) -> DataFrame:
    """Year playback in batch: for every non-empty year Y, the rows with ``to_date <= 'Y-12-31'`` (text order,
    cumulative). Rows are first pre-aggregated by ``to_date`` (bounded by the number of distinct dates), and
    only that small table meets the years table."""
    by_date = changes.groupBy("to_date").agg(F.count(F.lit(1)).alias("c"))
    years = by_date.select(F.substring("to_date", 1, 4).alias("year")).where(F.col("year") != "").distinct()
    j = years.join(by_date, F.col("to_date") <= F.concat(F.col("year"), F.lit("-12-31")), "inner")
    return j.groupBy("year").agg(F.sum("c").alias("cumulative"))


def event_by_id(changes: DataFrame, event_id: int) -> DataFrame:
    return changes.where(F.col("event_id") == F.lit(event_id))


def image_for_event(changes: DataFrame, images: DataFrame, event_id: int, side: str = "after", masks: DataFrame | None = None) -> DataFrame:
    """(event_id, side, image, data) of one event: ``before``, ``mask``, or any other side for after; no row when the event, its
    image or its mask is missing. The name, one value, goes into the scan as a literal, where bloom filters use it."""
    if side == "mask":
        if masks is None:
            raise ValueError("masks are needed for a mask")
        found = masks.where(F.col("event_id") == F.lit(event_id))
        name = F.concat(F.lit("masks/"), F.col("event_id").cast("string"), F.lit(".png"))
        return found.select("event_id", F.lit("mask").alias("side"), name.alias("image"), F.col("rgba").alias("data"))
    side = side if side == "before" else "after"
    row = event_by_id(changes, event_id).select(basename(f"{side}_image").alias("image")).first()
    named = images.where(F.col("image") == F.lit(row["image"])) if row and row["image"] else images.limit(0)
    return named.select(F.lit(event_id).cast("long").alias("event_id"), F.lit(side).alias("side"), "image", "data")


def tile_events(changes: DataFrame, col: int, row: int) -> DataFrame:
    return in_viewport(changes, (col, col, row, row)).orderBy(
        F.col("to_date").asc_nulls_last(), F.col("event_id")
    )


def ai_confirmed(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("ai_is_real") == F.lit(True))


def choose_layer(zoom: int, count: int, p=None) -> str:
    """"grid" when a block is larger than a tile or the rows are more than a map shows, else "features"."""
    from chronotile.params import DEFAULT

    return "grid" if zoom < 16 or count > (p or DEFAULT).max_features else "features"


def map_layer(changes: DataFrame, r: Range, zoom: int, layer: str | None = None, p=None, types=None, from_date=None,
              to_date=None, count: int | None = None) -> DataFrame:
    """The map's layer ("grid" or "features") in one schema (layer, feature JSON): the one asked for, else what ``choose_layer``
    says of the zoom and the count (of ``viewport_count``; not counted if a block is larger than a tile)."""
    from chronotile.params import DEFAULT

    p = p or DEFAULT
    cell = max(1, 2 ** max(0, 16 - zoom))
    if layer is None and cell == 1 and count is None:
        count = viewport_count(changes, r, types=types, from_date=from_date, to_date=to_date).first()["n"]
    layer = layer or choose_layer(zoom, count or 0, p)
    if layer == "grid":
        g = grid(changes, r, cell, types, from_date, to_date)
        ring = geo.ring(F.col("west"), F.col("south"), F.col("east"), F.col("north"))
        feat = F.to_json(F.struct(F.lit("Feature").alias("type"), geo.polygon_struct(F.array(ring)).alias("geometry"),
                                  F.struct(F.col("n").alias("count")).alias("properties")))
        return g.select(F.lit("grid").alias("layer"), feat.alias("feature"))
    if layer != "features":
        raise ValueError(f"unknown layer: {layer}")
    f = viewport_features(changes, r, types, from_date, to_date, p=p)
    return f.select(F.lit("features").alias("layer"), F.to_json(feature(f)).alias("feature"))


def feature_collection_json(features_json: list[str]) -> str:
    """Driver-side edge helper for a bounded top-N result (at most the hard limit)."""
    return json.dumps({"type": "FeatureCollection", "features": [json.loads(x) for x in features_json]})
