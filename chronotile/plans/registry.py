"""Registered queries: one Spark callable (spark, sf_dir) -> DataFrame per key, and its DuckDB oracle SQL.

Every query reads the driver tables through ``stages`` and runs over whole tables; filters that appear are the
feature under test (a viewport, a point lookup), never a way to make the check cheaper.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotile.functions import geo
from chronotile.params import FIXTURE
from chronotile.plans import oracle as O
from chronotile.plans import queries as Q
from chronotile.plans import stages as S
from chronotile.plans.pyramid import grid_from_pyramid
from chronotile.plans.store import stored, write_pairs
from chronotile.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


R = S.rounded

# Query parameters shared by the Spark side and the oracle.
TYPES = ["Su baskını", "Doğallaşma", "Tarıma açılma", "Yeşillendirme", "Greening-unknown"]
DATE_FROM, DATE_TO = "1993-01-01", "1997-12-31"
WORLD = (0, 2**16 - 1, 0, 2**16 - 1)
POINT_EVENT = 6
POINT_TILE = (38859, 25116)


def _types_sql() -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in TYPES)


# ---------------------------------------------------------------- map queries

@register("viewport_features", O.build("""
SELECT viewport_id, rank, event_id, tile_col, tile_row, round(importance, 9) AS importance, change_type_tr,
  episode_id, round(centroid_lon, 9) AS centroid_lon, round(centroid_lat, 9) AS centroid_lat
FROM (
  SELECT v.viewport_id, e.*, row_number() OVER (PARTITION BY v.viewport_id ORDER BY e.importance DESC, e.event_id) AS rank
  FROM enriched e JOIN viewports v
    ON e.tile_col BETWEEN v.min_col AND v.max_col AND e.tile_row BETWEEN v.min_row AND v.max_row)
WHERE rank <= 4000""", "enriched", "viewports"))
def q_viewport_features(spark, sf):
    ch = Q.scan_viewports(S.served_changes(spark, sf), [v[1:] for v in fx.viewports()])
    top = Q.viewports_top_features(ch, Q.viewports_frame(spark, fx.viewports()), limit=None, p=FIXTURE)
    return R(top.select("viewport_id", "rank", "event_id", "tile_col", "tile_row", "importance", "change_type_tr",
                        "episode_id", "centroid_lon", "centroid_lat"))


@register("viewport_count", O.build(f"""
SELECT v.viewport_id, count(*) AS n
FROM enriched e JOIN viewports v
  ON e.tile_col BETWEEN v.min_col AND v.max_col AND e.tile_row BETWEEN v.min_row AND v.max_row
WHERE e.change_type_tr IN ({_types_sql()}) AND e.to_date >= '{DATE_FROM}' AND e.to_date <= '{DATE_TO}'
GROUP BY v.viewport_id""", "enriched", "viewports"))
def q_viewport_count(spark, sf):
    ch = Q.scan_viewports(S.served_changes(spark, sf), [v[1:] for v in fx.viewports()])
    sel = ch.where(Q.type_predicate(ch, TYPES) & Q.date_predicate(DATE_FROM, DATE_TO))
    tagged = Q.in_viewports(sel, Q.viewports_frame(spark, fx.viewports()))
    return tagged.groupBy("viewport_id").agg(F.count(F.lit(1)).alias("n"))


@register("overview", O.build("""
SELECT count(*) AS total, count(DISTINCT (tile_col, tile_row)) AS tiles, min(to_date) AS min_to,
  max(to_date) AS max_to, min(from_date) AS min_from FROM enriched""", "enriched"))
def q_overview(spark, sf):
    return Q.overview(S.changes(spark, sf))


@register("counts_by_type", O.build("""
SELECT change_type_tr AS type, count(*) AS count FROM enriched WHERE change_type_tr <> '' GROUP BY 1""", "enriched"))
def q_counts_by_type(spark, sf):
    return Q.counts_by_type(S.classified(spark, sf))


@register("counts_by_year", O.build("""
SELECT substr(to_date, 1, 4) AS year, count(*) AS count FROM enriched GROUP BY 1""", "enriched"))
def q_counts_by_year(spark, sf):
    return Q.counts_by_year(S.changes(spark, sf))


@register("year_playback", O.build("""
SELECT y.year, count(*) AS cumulative
FROM (SELECT DISTINCT substr(to_date, 1, 4) AS year FROM enriched WHERE to_date <> '') y
JOIN enriched e ON e.to_date <= y.year || '-12-31'
GROUP BY y.year""", "enriched"))
def q_year_playback(spark, sf):
    return Q.year_playback(S.changes(spark, sf))


def _grid_sql(cell: int, density: bool = False) -> str:
    base = f"""
SELECT gc, gr, n,
  round({O.col_to_lon(f'gc * {cell}')}, 9) AS west, round({O.row_to_lat(f'gr * {cell} + {cell}')}, 9) AS south,
  round({O.col_to_lon(f'gc * {cell} + {cell}')}, 9) AS east, round({O.row_to_lat(f'gr * {cell}')}, 9) AS north
FROM (SELECT CAST(tile_col // {cell} AS BIGINT) AS gc, CAST(tile_row // {cell} AS BIGINT) AS gr, count(*) AS n
      FROM enriched GROUP BY 1, 2)"""
    if not density:
        return O.build(base, "enriched")
    return O.build(f"""
SELECT g.*, round(n::DOUBLE / (SELECT max(n) FROM ({base})), 9) AS share,
  CASE WHEN n::DOUBLE / (SELECT max(n) FROM ({base})) > 0.5 THEN 'high'
       WHEN n::DOUBLE / (SELECT max(n) FROM ({base})) > 0.2 THEN 'mid' ELSE 'low' END AS density
FROM ({base}) g""", "enriched")


@register("grid", _grid_sql(16))
def q_grid(spark, sf):
    return R(grid_from_pyramid(S.served_pyramid(spark, sf), WORLD, 12))


EDGE = (37411, 39022, 24303, 25219)  # no block of any zoom ends at its sides


def _zooms_sql() -> str:
    one = f"""SELECT {{z}} AS zoom, CAST(tile_col // {{cell}} AS BIGINT) AS gc, CAST(tile_row // {{cell}} AS BIGINT) AS gr, count(*) AS n
  FROM changes WHERE tile_col BETWEEN {EDGE[0]} AND {EDGE[1]} AND tile_row BETWEEN {EDGE[2]} AND {EDGE[3]} GROUP BY 2, 3"""
    return O.build(" UNION ALL ".join(one.format(z=z, cell=2 ** (16 - z)) for z in range(17)), "changes")


@register("grid_zooms", _zooms_sql())
def q_grid_zooms(spark, sf):
    """A viewport that cuts blocks, at every zoom, from the pyramid."""
    levels = S.served_pyramid(spark, sf)
    out = [grid_from_pyramid(levels, EDGE, z).select(F.lit(z).alias("zoom"), "gc", "gr", "n") for z in range(17)]
    return reduce(lambda a, b: a.unionByName(b), out)


@register("grid_density", _grid_sql(64, density=True))
def q_grid_density(spark, sf):
    return R(Q.grid_density(grid_from_pyramid(S.served_pyramid(spark, sf), WORLD, 10)))


@register("event_by_id", O.build(f"""
SELECT event_id, tile_col, tile_row, to_date, change_type_tr, round(importance, 9) AS importance, episode_id
FROM enriched WHERE event_id = {POINT_EVENT}""", "enriched"))
def q_event_by_id(spark, sf):
    e = Q.event_by_id(S.served_changes(spark, sf), POINT_EVENT)
    return R(e.select("event_id", "tile_col", "tile_row", "to_date", "change_type_tr", "importance", "episode_id"))


@register("tile_events", O.build(f"""
SELECT event_id, to_date, from_date, episode_id, episode_index, episode_count
FROM enriched WHERE tile_col = {POINT_TILE[0]} AND tile_row = {POINT_TILE[1]}""", "enriched"))
def q_tile_events(spark, sf):
    t = Q.tile_events(S.served_changes(spark, sf), *POINT_TILE)
    return t.select("event_id", "to_date", "from_date", "episode_id", "episode_index", "episode_count")


@register("type_list_count", O.build(f"""
SELECT count(*) AS n FROM classified WHERE change_type_tr IN ({_types_sql()})""", "classified"))
def q_type_list_count(spark, sf):
    return Q.viewport_count(S.classified(spark, sf), WORLD, types=Q.split_types(",,".join(TYPES) + ","))


@register("zoom_cells", O.build("""
SELECT id AS event_id, CAST(id % 20 AS INT) AS zoom, CAST(greatest(1, pow(2, greatest(0, 16 - id % 20))) AS INT) AS cell FROM events""", "events"))
def q_zoom_cells(spark, sf):
    zoom = (F.col("id") % 20).cast("int")
    return S.events(spark, sf).select(F.col("id").alias("event_id"), zoom.alias("zoom"), geo.cell_for_zoom(zoom).alias("cell"))


@register("served_viewport", O.build(f"""
SELECT event_id, tile_col, tile_row, to_date, change_type_tr, round(importance, 9) AS importance, episode_id
FROM enriched WHERE tile_col BETWEEN {fx.viewports()[0][1]} AND {fx.viewports()[0][2]}
  AND tile_row BETWEEN {fx.viewports()[0][3]} AND {fx.viewports()[0][4]}
ORDER BY enriched.importance DESC, event_id LIMIT 4000""", "enriched"))
def q_served_viewport(spark, sf):
    """One viewport asked of the stored table, where the tile range reaches the Parquet scan."""
    top = Q.viewport_features(S.served_changes(spark, sf), fx.viewports()[0][1:], p=FIXTURE)
    return R(top.select("event_id", "tile_col", "tile_row", "to_date", "change_type_tr", "importance", "episode_id"))


@register("pairs_store", O.build("SELECT * FROM pairs", "pairs"))
def q_pairs_store(spark, sf):
    return stored(S.pairs(spark, sf), "pairs", write_pairs)


# the step queries register themselves into the same dictionaries
from chronotile.plans import registry_steps  # noqa: E402,F401
