"""The median by selection against sorted values."""

import math
import random
import statistics

import pytest

from chronotile.operators import selection
from chronotile.operators.embed import similarity_stats

R = random.Random(5)
CASES = {
    "odd": [3.0, 1.0, 2.0],
    "even": [4.0, 1.0, 3.0, 2.0],
    "one": [7.5],
    "equal": [2.0] * 9,
    "halves": [1.0] * 4 + [2.0] * 4,
    "hot": [0.5] * 70 + [R.random() for _ in range(60)],
    "spread": [R.choice((-1, 1)) * 10 ** R.uniform(-300, 300) for _ in range(101)],
    "close": [1.0 + k * 2**-52 for k in range(20)],
    "denormal": [5e-324, 1e-323, 0.0, 1.5e-323],
    "ends": [-1.7e308, 1.7e308, -1.6e308, 1.6e308, 1.0],
    "infinite": [math.inf, -math.inf, 1.0, 2.0, 3.0],
    "all infinite": [math.inf, math.inf, -math.inf],
}


@pytest.mark.parametrize("name", CASES)
def test_median(spark, monkeypatch, name):
    monkeypatch.setattr(selection, "BUCKETS", 16)  # several passes on few rows
    values = CASES[name]
    df = spark.createDataFrame([(v,) for v in values + [None]], "x double")
    assert selection.exact_median(df, "x") == statistics.median(values)


def test_median_of_random_values(spark):
    values = [R.gauss(0, 1) for _ in range(20_000)]
    assert selection.exact_median(spark.createDataFrame([(v,) for v in values], "x double"), "x") == statistics.median(values)


def test_nan_is_the_greatest_and_empty_gives_none(spark):
    df = spark.createDataFrame([(float("nan"),), (float("nan"),), (1.0,), (2.0,), (3.0,)], "x double")
    assert selection.exact_median(df, "x") == 3.0
    assert math.isnan(selection.exact_median(df.where("isnan(x)"), "x"))
    assert selection.exact_median(df.where("false"), "x") is None


def test_no_exchange_of_values(spark):
    df = spark.range(1000).selectExpr("cast(id as double) AS v")
    plan = df.groupBy(selection._bucket(df.v, 0.0, 999.0)).count()._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "partial_count" in plan


def test_stats_of_an_empty_table(spark):
    row = similarity_stats(spark.createDataFrame([(None,)], "dino_similarity double"), 0.5).first()
    assert (row.n, row.mean_similarity, row.median_similarity, row.share_below) == (0, None, None, None)
