from datetime import datetime

from pyspark.sql import functions as F

from chronotile.operators.episodes import episodes
from chronotile.operators.numbering import prefix_scan, with_row_number


def _parse(s):
    try:
        return datetime.fromisoformat(s) if s else None
    except ValueError:
        return None


def brute_episodes(rows):
    """Plain restatement: sort by tile, to_date text, id; link to the previous row only."""
    rows = sorted(rows, key=lambda r: (r[1], r[2], r[4], r[0]))
    out, eid, prev = {}, 0, None
    counts = {}
    for r in rows:
        f = _parse(r[3])
        if prev is not None and (prev[1], prev[2]) == (r[1], r[2]) and f is not None and _parse(prev[4]) is not None \
                and f <= _parse(prev[4]):
            e = out[prev[0]][0]
        else:
            eid += 1
            e = eid
        idx = counts.get(e, 0)
        counts[e] = idx + 1
        out[r[0]] = [e, idx]
        prev = r
    return {k: (v[0], v[1], counts[v[0]]) for k, v in out.items()}


EDGE = [
    # id, col, row, from, to
    (1, 1, 1, "2020-01-01T00:00:00", "2020-06-01T00:00:00"),
    (2, 1, 1, "2020-06-01T00:00:00", "2020-09-01T00:00:00"),   # touching: joins
    (3, 1, 1, "2021-01-01T00:00:00", "2021-06-01T00:00:00"),   # gap: breaks
    (4, 2, 1, "2020-01-01T00:00:00", "2020-12-01T00:00:00"),
    (5, 2, 1, "2020-02-01T00:00:00", "2020-03-01T00:00:00"),   # overlaps the first
    (6, 2, 1, "2020-11-01T00:00:00", "2020-12-15T00:00:00"),   # overlaps only the first: breaks
    (7, 3, 1, "", "2020-01-01T00:00:00"),
    (8, 3, 1, "", "2020-02-01T00:00:00"),                      # empty from: breaks
    (9, 3, 2, "2020-01-01T00:00:00", ""),
    (10, 3, 2, "2020-01-01T00:00:00", "2020-05-01T00:00:00"),  # previous to is empty: breaks
    (11, 4, 4, "2020-01-01T00:00:00", "2020-05-01T00:00:00"),
    (12, 4, 4, "2020-01-01T00:00:00", "2020-05-01T00:00:00"),  # tie on to_date: ordered by id, joins
]


def test_episodes_edges_match_brute_force(spark):
    df = spark.createDataFrame(EDGE, "event_id long, tile_col int, tile_row int, from_date string, to_date string")
    got = {r.event_id: (r.episode_id, r.episode_index, r.episode_count) for r in episodes(df).collect()}
    assert got == brute_episodes(EDGE)


def test_episodes_many_partitions(spark):
    rows = [(i, i % 3, 0, f"2020-{(i % 12) + 1:02d}-01T00:00:00", f"2020-{(i % 12) + 1:02d}-20T00:00:00") for i in range(1, 300)]
    df = spark.createDataFrame(rows, "event_id long, tile_col int, tile_row int, from_date string, to_date string").repartition(7)
    got = {r.event_id: (r.episode_id, r.episode_index, r.episode_count) for r in episodes(df).collect()}
    assert got == brute_episodes(rows)


def test_row_number_and_prefix_scan(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("v"))
    out = prefix_scan(df, ["k"], sums={"s": F.col("v")}, maxes={"m": F.when(F.col("v") == 0, F.col("k"))}, num_partitions=5)
    rows = sorted(out.collect(), key=lambda r: r.k)
    run, mx = 0, None
    for r in rows:
        run += r.v
        mx = r.k if r.v == 0 else mx
        assert r.s == run and r.m == mx
    n = with_row_number(df, ["k"], "rn", num_partitions=4).collect()
    assert sorted((r.k, r.rn) for r in n) == [(i, i + 1) for i in range(1000)]


def test_episodes_keep_repeated_and_null_ids(spark):
    rows = [(1, 5, 5, "2020-01-01T00:00:00", "2020-02-01T00:00:00"), (1, 5, 5, "2020-01-15T00:00:00", "2020-03-01T00:00:00"),
            (None, 6, 5, "2020-01-01T00:00:00", "2020-02-01T00:00:00"), (2, 6, 6, "", "")]
    df = spark.createDataFrame(rows, "event_id long, tile_col int, tile_row int, from_date string, to_date string")
    got = episodes(df).collect()
    assert sorted((r.event_id is None, r.event_id) for r in got) == sorted((r[0] is None, r[0]) for r in rows)
    assert sorted(r.episode_count for r in got) == [1, 1, 2, 2]


def test_episodes_small_batches_and_hot_tile(spark):
    """One tile holding most rows, split over range partitions and small Arrow batches (carry across borders)."""
    rows = [(i, 7 if i % 5 else i % 3, 1, f"2020-{(i % 12) + 1:02d}-01T00:00:00",
             "" if i % 37 == 0 else f"2020-{(i * 7 % 12) + 1:02d}-{(i % 27) + 1:02d}T00:00:00") for i in range(1, 400)]
    df = spark.createDataFrame(rows, "event_id long, tile_col int, tile_row int, from_date string, to_date string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.event_id: (r.episode_id, r.episode_index, r.episode_count) for r in episodes(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute_episodes(rows)
