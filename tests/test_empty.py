"""Zero-row input to the enrich steps returns an empty DataFrame with the schema (the reference raises)."""

from chronotile.operators.episodes import episodes
from chronotile.operators.hotspots import hotspots
from chronotile.operators.importance import importance
from chronotile.params import FIXTURE
from chronotile.plans import export as EX
from chronotile.plans import stages as S


def test_enrich_on_zero_rows(spark, sf_small):
    empty = S.classified(spark, sf_small).limit(0)
    out = hotspots(importance(episodes(S.with_tile_geometry(empty)), FIXTURE), FIXTURE)
    assert out.count() == 0
    for c in ("episode_id", "episode_index", "episode_count", "importance", "hotspot_id", "hotspot_centroid_lon"):
        assert c in out.columns
    s = EX.summary(out).first()
    assert s.total_changes == 0 and s.date_from == "" and s.hotspots == 0


def test_similar_changes_self_handling(spark):
    from chronotile.operators.vectors import similar_changes

    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [3.0, 0.0])]
    v = spark.createDataFrame(rows, "event_id long, vector array<float>")
    assert [r.event_id for r in similar_changes(v, 3, 3).orderBy("rank").collect()] == [1, 2]
    assert [r.event_id for r in similar_changes(v, 3, 3, exclude_self_first=True).orderBy("rank").collect()] == [1, 2, 4]
    assert similar_changes(v, 99, 3).count() == 0
