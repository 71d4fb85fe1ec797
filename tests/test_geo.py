import math

from pyspark.sql import functions as F

from chronotile.functions import geo

ZOOM = 16
LONS = [-180.0, -30.0, 0.0, 34.0, 179.9]
LATS = [-85.0, 0.0, 39.0, 42.0, 85.0]


def test_lon_col_round_trip(spark):
    df = spark.createDataFrame([(x,) for x in LONS], "lon double")
    rows = df.select("lon", geo.lon_to_col("lon", ZOOM).alias("c")).select(
        "lon", geo.col_to_lon("c", ZOOM).alias("back"), geo.col_to_lon(F.col("c") + 1, ZOOM).alias("nxt")).collect()
    for r in rows:
        assert r.back <= r.lon < r.nxt


def test_lat_row_round_trip(spark):
    df = spark.createDataFrame([(x,) for x in LATS], "lat double")
    rows = df.select("lat", geo.lat_to_row("lat", ZOOM).alias("r")).select(
        "lat", geo.tile_bounds(F.lit(0), "r", ZOOM).alias("b")).collect()
    for r in rows:
        assert r.b.south <= r.lat + 1e-9 and r.lat <= r.b.north + 1e-9


def test_bounds_order_and_ring(spark):
    b = spark.range(1).select(geo.tile_bounds(F.lit(37500), F.lit(25100), ZOOM).alias("b"),
                              geo.tile_ring(F.lit(37500), F.lit(25100), ZOOM).alias("ring")).first()
    assert b.b.west < b.b.east and b.b.south < b.b.north
    assert b.ring[0] == b.ring[-1] and len(b.ring) == 5
    assert b.ring[0] == [b.b.west, b.b.south] and b.ring[2] == [b.b.east, b.b.north]


def test_viewport_covers_centre():
    b_w, b_s, b_e, b_n = 32.0, 39.0, 33.0, 40.0
    min_col, max_col, min_row, max_row = geo.viewport_range(b_w, b_s, b_e, b_n, ZOOM)
    n = 2**ZOOM
    col = int(math.floor((32.5 + 180.0) / 360.0 * n))
    assert min_col <= col <= max_col and min_row <= max_row


def test_haversine_symmetry(spark):
    df = spark.createDataFrame([(32.85, 39.93, 29.0, 41.0)], "a double, b double, c double, d double")
    r = df.select(geo.haversine_km("a", "b", "c", "d").alias("x"), geo.haversine_km("c", "d", "a", "b").alias("y")).first()
    assert abs(r.x - r.y) < 1e-9 and 0 < r.x < 20000


def test_viewport_ranges_frame_matches_driver(spark):
    df = spark.createDataFrame([(32.0, 39.0, 33.0, 40.0)], "west double, south double, east double, north double")
    r = geo.viewport_ranges(df).first()
    assert (r.min_col, r.max_col, r.min_row, r.max_row) == geo.viewport_range(32.0, 39.0, 33.0, 40.0)
