import math

from chronotile.operators.importance import importance
from chronotile.operators.noise import noise_filter
from chronotile.params import DEFAULT


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "event_id long, dino_similarity double, largest_run int, change_ratio double")


def test_noise_filter_default_threshold(spark):
    rows = [(1, 0.70, 8, 0.4), (2, 0.95, 8, 0.4), (3, 0.80, 8, 0.4), (4, 0.92, 8, 0.4), (5, None, 8, 0.4),
            (6, float("nan"), 8, 0.4), (7, 0.10, 1, 0.4), (8, 0.10, 2, 0.4)]
    out = {r.event_id: r for r in noise_filter(_pairs(spark, rows), DEFAULT).collect()}
    assert sorted(out) == [1, 3, 5, 8]
    assert out[5].candidate_reason == "no_embedding" and out[1].candidate_reason == "dino"
    assert all(r.is_candidate for r in out.values())


def test_noise_filter_ratio_only_when_positive(spark):
    rows = [(1, 0.5, 8, 0.3), (2, 0.5, 8, 0.5), (3, 0.5, 8, 0.7)]
    out = sorted(r.event_id for r in noise_filter(_pairs(spark, rows), DEFAULT.with_(min_change_ratio=0.5)).collect())
    assert out == [2, 3]


def test_importance_edges(spark):
    rows = [(1, 1.5, 0.2, "Su baskını", "2020-01-01T00:00:00"), (2, -0.5, None, "", "2022-01-01T00:00:00"),
            (3, None, 0.5, "", ""), (4, 0.5, 2.0, "", "bad")]
    df = spark.createDataFrame(rows, "event_id long, change_ratio double, dino_similarity double, change_type_tr string, to_date string")
    out = {r.event_id: r.importance for r in importance(df, DEFAULT).collect()}
    assert math.isclose(out[1], 0.3 * 1.0 + 0.3 * 0.8 + 0.2 * 1.0 + 0.0)
    assert math.isclose(out[2], 0.3 * 0.0 + 0.3 * 0.0 + 0.0 + 0.2 * 1.0)
    assert math.isclose(out[3], 0.0 + 0.3 * 0.5)
    assert math.isclose(out[4], 0.3 * 0.5 + 0.0)


def test_importance_single_date_span_floor(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, "", "2020-01-01T00:00:00")],
                               "event_id long, change_ratio double, dino_similarity double, change_type_tr string, to_date string")
    assert importance(df, DEFAULT).first().importance == 0.0
