from chronotile.plans import queries as Q


def test_tagging_matches_brute_force(spark):
    tiles = [(i, (i * 7919) % 300 - 20, (i * 104729) % 300) for i in range(400)] + [(400, 65535, 65535), (401, 0, 0)]
    views = [(1, 0, 65535, 0, 65535), (2, 10, 10, 0, 299), (3, 100, 163, 64, 127), (4, 63, 64, 127, 128), (5, 9, 3, 0, 10),
             (6, -20, 5, 0, 40), (7, 100, 163, 64, 127), (8, 0, 0, 0, 0)]
    ch = spark.createDataFrame(tiles, "event_id long, tile_col int, tile_row int")
    got = sorted(map(tuple, Q.in_viewports(ch, Q.viewports_frame(spark, views)).select("viewport_id", "event_id").collect()))
    want = sorted((v, e) for e, c, r in tiles for v, c0, c1, r0, r1 in views if c0 <= c <= c1 and r0 <= r <= r1)
    assert got == want
    assert Q.in_viewports(ch, Q.viewports_frame(spark, [])).count() == 0
    plan = Q.in_viewports(ch, Q.viewports_frame(spark, views))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
