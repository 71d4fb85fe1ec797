"""Probe training against a plain restatement, on vectors with structure."""

import math
import random

import pytest

from chronotile.operators import probe as PB
from chronotile.operators.landcover import score_images
from chronotile.params import FIXTURE

P = FIXTURE.with_(probe_steps=6, probe_rate=2.0)
NAMES = {1: "Forest", 4: "River", 7: "Highway"}
SCHEMA = "vec_id long, label int, label_name string, embedding array<float>, score double"


def rows(n=240):
    r = random.Random(3)
    out = []
    for i in range(n):
        label = r.choice(list(NAMES))
        centre = [1.0 if j == label % 5 else 0.0 for j in range(5)]
        out.append((i, label, NAMES[label], [round(c + r.gauss(0, 0.2), 4) for c in centre], 0.0))
    return out


def plain(data, steps, rate):
    labels = sorted({d[1] for d in data})
    x = [[*map(float, d[3]), 1.0] for d in data]
    w = [[0.0] * len(x[0]) for _ in labels]
    for _ in range(steps):
        grad = [[0.0] * len(x[0]) for _ in labels]
        for d, v in zip(data, x):
            z = [sum(a * b for a, b in zip(v, row)) for row in w]
            e = [math.exp(t - max(z)) for t in z]
            for c, label in enumerate(labels):
                miss = e[c] / sum(e) - (d[1] == label)
                for j, a in enumerate(v):
                    grad[c][j] += miss * a / len(data)
        w = [[a - rate * g for a, g in zip(r, gr)] for r, gr in zip(w, grad)]
    return dict(zip(labels, w))


def test_weights_equal_a_plain_restatement(spark):
    data = rows()
    got = PB.train_probe(spark.createDataFrame(data, SCHEMA), P).collect()
    want = plain(data, P.probe_steps, P.probe_rate)
    assert {r.label for r in got} == set(want) and {r.label_name for r in got} == set(NAMES.values())
    for r in got:
        assert [*r.weights, r.bias] == pytest.approx(want[r.label], abs=1e-5)


def test_partitioning_does_not_matter(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    a = PB.train_probe(df.repartition(1), P).collect()
    assert a == PB.train_probe(df.repartition(7, "embedding"), P).collect()


def test_accuracy_of_both_parts(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    model = PB.train_probe(df.where(~PB.held_out("vec_id")), P)
    a = PB.probe_accuracy(df, model, PB.held_out("vec_id")).first()
    assert a.train_rows + a.test_rows == 240 and 30 < a.test_rows < 90
    assert a.train_accuracy > 0.9 and a.test_accuracy > 0.9


def test_trained_probe_scores_images(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    model = PB.train_probe(df, P.with_(probe_steps=60))
    images = df.selectExpr("cast(vec_id as string) AS image", "embedding", "label_name")
    found = score_images(images, model, P.with_(confidence_floor=0.0)).join(images, "image")
    assert found.where("land_cover = label_name").count() > 220


def test_odd_rows(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    odd = [(900, None, None, [1.0] * 5, 0.0), (901, 1, "Forest", None, 0.0), (902, 1, "Forest", [], 0.0)]
    assert PB.train_probe(df.union(spark.createDataFrame(odd, SCHEMA)), P).collect() == PB.train_probe(df, P).collect()
    none = PB.train_probe(df.where("false"), P)
    assert none.count() == 0
    assert PB.probe_accuracy(df, none, PB.held_out("vec_id")).first().test_accuracy is None
    assert PB.predict(spark.createDataFrame(odd, SCHEMA), PB.train_probe(df, P)).where("predicted is null").count() == 2
    for bad in ([1.0] * 4, [float("nan")] * 5, [1e6] * 5, [None] * 5):
        with pytest.raises(Exception, match="lengths|component"):
            PB.train_probe(df.union(spark.createDataFrame([(903, 1, "Forest", bad, 0.0)], SCHEMA)), P).collect()
