"""The pruned exact batch search against brute force, and how much it compares."""

import numpy as np
import pytest

from chronotile.operators.vectors import compared_share, similar_batch

SCHEMA = "event_id long, vector array<float>"


def brute(ids, x, k):
    d = np.zeros((len(x), len(x)))
    for j in range(x.shape[1]):
        d += (x[:, j][:, None] - x[:, j][None, :]) ** 2
    out = []
    for i, e in enumerate(ids):
        top = sorted(zip(d[i].tolist(), ids))[:k]
        out += [(e, r + 1, o, round(v, 9)) for r, (v, o) in enumerate([(v, o) for v, o in top if o != e])]
    return sorted(out)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], SCHEMA)


def clusters(rng, n, groups, dim):
    centre = rng.normal(size=(groups, dim)) * 20
    return (centre[rng.integers(0, groups, n)] + rng.normal(size=(n, dim))).astype(np.float32)


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies", "line"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    x = {"clusters": clusters(rng, 400, 12, 6), "noise": rng.normal(size=(300, 8)).astype(np.float32),
         "copies": rng.integers(0, 3, (300, 2)).astype(np.float32), "line": np.arange(200, dtype=np.float32)[:, None] // 2}[kind]
    ids = rng.permutation(len(x)) * 3
    got = similar_batch(frame(spark, ids, x), 5, block=16, pivots=20)
    assert sorted((r.query_event_id, r.rank, r.event_id, round(r.distance, 9)) for r in got.collect()) == brute(ids.tolist(), x.astype(float), 5)


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(8)
    v = frame(spark, range(3000), clusters(rng, 3000, 60, 6)).checkpoint()
    r = compared_share(v, 5, block=50).first()
    assert r.vectors == 3000 and r.pairs < 0.15 * 3000 * 3000 and r.share == r.pairs / 9e6


def test_one_cell_larger_than_a_block_and_fewer_vectors_than_k(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 3)).astype(np.float32)
    got = similar_batch(frame(spark, range(120), x), 4, block=16, pivots=1)
    assert sorted((r.query_event_id, r.rank, r.event_id, round(r.distance, 9)) for r in got.collect()) == brute(list(range(120)), x.astype(float), 4)
    few = similar_batch(frame(spark, [1, 2, 3], x[:3]), 9)
    assert sorted((r.query_event_id, r.rank, r.event_id, round(r.distance, 9)) for r in few.collect()) == brute([1, 2, 3], x[:3].astype(float), 9)
    rows = spark.createDataFrame([(1, None), (2, [0.0]), (3, [1.0])], SCHEMA)
    assert [(r.query_event_id, r.event_id) for r in similar_batch(rows, 3).orderBy("query_event_id").collect()] == [(2, 3), (3, 2)]
    assert similar_batch(rows.limit(0), 3).count() == 0


def test_cells_opened_by_a_batch_do_not_carry_its_vectors(spark):
    """Rows out of the opening pass are blocks by cells, not queries by cells, and a query that opens all cells meets them all."""
    from chronotile.operators.vectors import _distinct, _opened

    rng = np.random.default_rng(10)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    _, opened, piv = _opened(_distinct(frame(spark, range(600), x))[1], 5, 32, 20)
    blocks = sum(s for *_, s in piv.cells)
    assert "vec" not in opened.columns and opened.select("cell", "sub", "opened").distinct().count() <= blocks * len(piv.cells)
    assert opened.where("opened = cell").agg({"n": "sum"}).first()[0] == 600


def test_product_picks_what_exact_sums_pick():
    from chronotile.operators.vectors import _squared, _within

    rng = np.random.default_rng(11)
    for q, c in ((rng.normal(size=(50, 6)), rng.normal(size=(70, 6))), (rng.integers(0, 3, (40, 3)) * 1.0 + 1e4, rng.integers(0, 3, (60, 3)) * 1.0 + 1e4),
                 (np.array([[np.inf, 1.0], [0.0, 0.0]]), np.array([[1.0, 1.0], [0.0, 2.0]]))):
        d = _squared(q, c)
        for worst in (np.full(len(q), np.inf), np.sort(d, axis=1)[:, 1]):
            got = set(zip(*(x.tolist() for x in _within(q, c, worst, 2))))
            bound = np.minimum(worst, np.sort(d, axis=1)[:, 1])
            want = {(i, j, d[i, j]) for i, j in zip(*(x.tolist() for x in np.nonzero(d <= bound[:, None])))}
            assert want <= got and all(d[i, j] == v and v <= worst[i] for i, j, v in got)
