"""Stored map tables: key ranges, what the scans read, lookups by id, and the pyramid against direct counts."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from chronotile.functions.zorder import in_ranges, z_key, z_number, z_ranges
from chronotile.plans import queries as Q
from chronotile.plans import stages as S
from chronotile.plans.pyramid import grid_from_pyramid, merged, pyramid, write_pyramid
from chronotile.plans.store import read_changes, served, stored, write_changes, write_named


def folder(name):
    return os.path.join(tempfile.mkdtemp(prefix="chronotile-store-"), name)


def rows_read(df):
    """(rows that the Parquet scans gave to the plan, result)."""
    plan = df._jdf.queryExecution()
    got = df.collect()
    node = plan.executedPlan()
    if "AdaptiveSparkPlan" in node.nodeName():
        node = node.executedPlan()
    total, todo = 0, [node]
    while todo:
        n = todo.pop()
        if n.nodeName().startswith("Scan parquet"):
            total += n.metrics().apply("numOutputRows").value()
        kids = n.children()
        todo += [kids.apply(i) for i in range(kids.size())] + ([n.plan()] if "QueryStage" in n.nodeName() else [])
    return total, got


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(2)
    kinds = ["a", "b", "", None]
    rows = [(i, rng.randrange(37000, 39100), rng.randrange(24000, 25500), f"20{rng.randrange(10, 24)}-01-01", kinds[rng.randrange(4)], rng.random()) for i in range(6000)]
    rows += [(9000 + i, 38000, 25000, "2020-01-01", "a", 0.5) for i in range(3000)]  # a third in one tile
    return spark.createDataFrame(rows, "event_id long, tile_col int, tile_row int, to_date string, change_type_tr string, importance double").checkpoint()


@pytest.fixture(scope="module")
def table(spark, events):
    path = folder("changes")
    write_changes(events, path, files=6, group_bytes=2048)
    return read_changes(spark, path)


def test_z_key_equals_interleaved_bits(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(1 << 24), rng.randrange(1 << 24)) for _ in range(200)] + [(0, 0), ((1 << 24) - 1,) * 2]
    got = spark.createDataFrame(rows, "c int, r int").select("c", "r", z_key("c", "r").alias("z")).collect()
    assert all(x.z == z_number(x.c, x.r) for x in got)


def test_ranges_cover_the_rectangle():
    rng = random.Random(3)
    for _ in range(200):
        a, b = sorted(rng.randrange(64) for _ in range(2))
        c, d = sorted(rng.randrange(64) for _ in range(2))
        for most in (1, 4, 16):
            ranges = z_ranges(a, b, c, d, most, bits=6)
            assert 1 <= len(ranges) <= most and all(x <= y for x, y in ranges) and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))
            assert all(any(x <= z_number(i, j) <= y for x, y in ranges) for i in range(a, b + 1) for j in range(c, d + 1))
    assert z_ranges(0, 63, 0, 63, bits=6) == [(0, 4095)] and z_ranges(5, 4, 0, 9) == [] and z_ranges(-9, -1, 0, 9) == []
    assert z_ranges(-5, 1, -5, 1, bits=6) == [(0, 3)] and len(z_ranges(37540, 37660, 24340, 24460)) <= 16


def test_viewport_reads_a_part(spark, events, table):
    r = (37540, 37660, 24340, 24460)
    read, got = rows_read(Q.viewport_features(table, r))
    assert sorted(x.event_id for x in got) == sorted(x.event_id for x in Q.viewport_features(events, r).collect()) and got
    assert 0 < read < 0.1 * 9000
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = Q.viewport_features(table, r)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(zkey," in pushed and "GreaterThanOrEqual(tile_col,37540)" in pushed
    assert Q.tile_events(table, 38000, 25000).count() >= 3000
    read, got = rows_read(Q.in_viewport(table, (38000, 38000, 25000, 25000)))
    assert len(got) >= 3000 and 3000 <= read < 4500
    assert Q.viewport_count(table, (5, 4, 0, 9)).first()["n"] == 0


def test_several_viewports(spark, events, table):
    views = [(0, 37500, 37600, 24300, 24400), (1, 37550, 37650, 24350, 24450), (2, 5, 9, 5, 9)]
    frame = Q.viewports_frame(spark, views)
    scan = Q.scan_viewports(table, [v[1:] for v in views])
    want = sorted((r.viewport_id, r.rank, r.event_id) for r in Q.viewports_top_features(events, frame, limit=7).collect())
    assert sorted((r.viewport_id, r.rank, r.event_id) for r in Q.viewports_top_features(scan, frame, limit=7).collect()) == want and want
    assert 0 < rows_read(scan)[0] < 0.3 * 9000
    assert Q.scan_viewports(table, [(0, 1, 0, 1)] * 65) is table


def test_point_lookups_skip_row_groups(spark, events, table):
    read, got = rows_read(Q.event_by_id(table, 4321))
    assert [r.event_id for r in got] == [4321] and 0 < read < 0.1 * 9000
    assert rows_read(Q.event_by_id(table, 123456))[1] == []


def test_image_for_event(spark):
    ch = stored(spark.createDataFrame([(1, 5, 5, "2020", "x/a.png", "x/b.png"), (2, 5, 6, "2020", "", "gone.png")],
                                      "event_id long, tile_col int, tile_row int, to_date string, before_image string, after_image string"), "c", write_changes)
    images = stored(spark.createDataFrame([("a.png", b"A"), ("b.png", b"B")], "image string, data binary"), "i", write_named)
    masks = stored(spark.createDataFrame([(1, b"M")], "event_id long, rgba binary"), "m", write_named)
    got = {(e, side): [tuple(r) for r in Q.image_for_event(ch, images, e, side, masks).collect()] for e in (1, 2, 3) for side in ("before", "after", "else", "mask")}
    assert got[1, "before"] == [(1, "before", "a.png", b"A")] and got[1, "after"] == got[1, "else"] == [(1, "after", "b.png", b"B")]
    assert got[1, "mask"] == [(1, "mask", "masks/1.png", b"M")] and not any(v for (e, _), v in got.items() if e > 1)
    with pytest.raises(ValueError):
        Q.image_for_event(ch, images, 1, "mask")


def test_pyramid_grids_equal_direct_counts(spark, events):
    path = folder("pyramid")
    write_pyramid(pyramid(events), path)
    levels = spark.read.parquet(path)
    for r in ((0, 65535, 0, 65535), (37411, 39022, 24303, 25219), (38000, 38000, 25000, 25000), (37504, 37567, 24320, 24383), (-5, 9, -5, 9)):
        for zoom in (16, 13, 9, 4, 0):
            for types in (None, ["a"]):
                got = grid_from_pyramid(levels, r, zoom, types)
                assert sorted(map(tuple, got.collect())) == sorted(map(tuple, Q.grid(events, r, 2 ** (16 - zoom), types).collect()))
    one = grid_from_pyramid(levels, (0, 65535, 0, 65535), 8)
    assert "zoom=8" in one._jdf.queryExecution().executedPlan().toString() or "zoom#" in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        grid_from_pyramid(levels, (0, 1, 0, 1), 17)


def test_pyramids_of_parts_merge(spark, events):
    parts = [pyramid(events.where("event_id % 3 = 0")), pyramid(events.where("event_id % 3 <> 0")), pyramid(events.limit(0))]
    cols = ["zoom", "gc", "gr", "change_type_tr", "n"]
    assert sorted(map(tuple, merged(*parts).select(cols).collect())) == sorted(map(tuple, pyramid(events).select(cols).collect()))


def test_layers(spark, events, table):
    r, p = (37540, 37660, 24340, 24460), S.FIXTURE
    assert Q.choose_layer(15, 0) == "grid" and Q.choose_layer(16, 4001) == "grid" and Q.choose_layer(16, 4000) == "features"
    n = Q.viewport_count(events, r).first()["n"]
    for few, layer in ((n, "features"), (n - 1, "grid")):
        got = Q.map_layer(table, r, 16, p=p.with_(max_features=few)).collect()
        assert {x.layer for x in got} == {layer} and all(x.feature.startswith('{"type":"Feature"') for x in got)


def test_served_is_built_once_for_each_state_of_its_inputs(spark):
    path, built = folder("in"), []

    def build():
        built.append(1)
        return spark.read.parquet(path).withColumn("m", F.col("id") * 2)

    def write(df, to):
        df.write.parquet(to)

    spark.range(3).write.parquet(path)
    for _ in range(2):
        assert served([spark.read.parquet(path)], "t", build, write).count() == 3
    spark.range(5).write.mode("append").parquet(path)
    assert served([spark.read.parquet(path)], "t", build, write).count() == 8 and len(built) == 2
    assert in_ranges(F.lit(3), []) is not None
