"""The pipeline over a folder of user tables."""

import math
import os
import tempfile
from dataclasses import replace

import pytest

from chronotile.params import DEFAULT
from chronotile.plans.metrics import REPORT, StepMetrics
from chronotile.plans.pipeline import Tables, read_tables, run_tables
from chronotile.sources.ranged import write_ranges

SIMILARITY = [0.70, 0.95, 0.80]


@pytest.fixture(scope="module", params=["parquet", "ranges"])
def folder(spark, request):
    """Three events: tile (37500 + i, 25100), before 2020, after 2021, images whose vectors have the given cosine."""
    at = tempfile.mkdtemp(prefix="chronotile-user-")
    ev = [(i + 1, 37500 + i, 25100, f"WB 2020-0{i + 1}", f"2020-0{i + 1}-01", f"WB 2021-0{i + 1}", f"2021-0{i + 1}-01", 0.6 - 0.1 * i, 0.4, 8) for i in range(3)]
    ev = spark.createDataFrame(ev, "id long, tile_col int, tile_row int, from_release_id string, from_date string, to_release_id string, to_date string, "
                                   "ssim_score double, change_ratio double, largest_run int")
    if request.param == "ranges":
        write_ranges(ev, f"{at}/events", "id", 2)
    else:
        ev.write.parquet(f"{at}/events.parquet")
    names, snaps, vectors, rasters = [], [], [], []
    for i, s in enumerate(SIMILARITY):
        for k, year in enumerate(("2020", "2021")):
            snaps.append((f"WB {year}-0{i + 1}", 37500 + i, 25100, "png"))
            names.append(f"{37500 + i}_25100_WB_{year}-0{i + 1}.png")
            vectors.append((names[-1], [1.0, 0.0] if k == 0 else [s, math.sqrt(1 - s * s)]))
            rasters.append((names[-1], 64, 64, 3, bytes([100, 100, 100 + i] if k == 0 else [60, 200, 40 + i]) * 4096))
    spark.createDataFrame(snaps, "release_id string, tile_col int, tile_row int, ext string").write.parquet(f"{at}/snapshots.parquet")
    spark.createDataFrame(vectors, "image string, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame(rasters, "image string, height int, width int, channels int, data binary").write.parquet(f"{at}/rasters.parquet")
    spark.createDataFrame([(0, "Forest", [9.0, 0.0]), (1, "Residential", [0.0, 9.0])], "label int, label_name string, weights array<double>").write.parquet(f"{at}/probe")
    answers = [(1, '{"is_real": true, "change_type": "construction", "confidence": 0.9}'), (3, '{"is_real": false}')]
    spark.createDataFrame(answers, "event_id long, text string").write.parquet(f"{at}/answers.parquet")
    return at


def test_all_steps(spark, folder):
    out = {r.event_id: r for r in run_tables(read_tables(spark, folder), DEFAULT).collect()}
    assert sorted(out) == [1, 3]  # 0.95 is above the threshold: noise
    assert [round(out[i].dino_similarity, 6) for i in (1, 3)] == [0.7, 0.8]
    assert {r.land_cover_from for r in out.values()} == {"Forest"} and out[1].before_image == "images/37500_25100_WB_2020-01.png"
    assert all(r.geometry_mask.startswith('{"type":"Polygon"') and r.mask_image == f"masks/{i}.png" for i, r in out.items())
    assert (out[1].ai_is_real, out[3].ai_is_real) == (True, False) and sorted(r.episode_id for r in out.values()) == [1, 2]
    kept = run_tables(read_tables(spark, folder), DEFAULT.with_(drop_ai_false=True)).collect()
    assert [r.event_id for r in kept] == [1]


def test_skipped_steps_need_no_tables(spark, folder):
    t = read_tables(spark, folder)
    bare = Tables(t.events, t.snapshots, t.embeddings)
    out = run_tables(bare, DEFAULT, skip=("classify", "mask", "enrich"))
    assert out.count() == 2 and "importance" not in out.columns
    for skip in (("classify",), ("mask",)):
        with pytest.raises(ValueError, match="no table"):
            run_tables(bare, DEFAULT, skip=skip)
    with pytest.raises(ValueError, match="unknown"):
        run_tables(t, DEFAULT, skip=("narrate",))
    none = run_tables(Tables(t.events.limit(0), t.snapshots, t.embeddings, t.probe, t.rasters, t.answers), DEFAULT)
    assert none.count() == 0 and {"hotspot_id", "geometry_mask", "ai_is_real"} <= set(none.columns)


def test_metrics_of_one_run(spark, folder, tmp_path):
    t, seen = read_tables(spark, folder), StepMetrics()
    run_tables(t, DEFAULT, metrics=seen).write.parquet(str(tmp_path / "out"))
    report = seen.report(spark)
    assert list(report.first()) == [3, 2, 2, 2, 2, 2, 0, 1.0] and report.columns == [*REPORT, "labelled_share"]
    seen = StepMetrics()
    run_tables(Tables(t.events, t.snapshots, t.embeddings), DEFAULT, skip=("classify", "mask", "enrich"), metrics=seen).write.parquet(str(tmp_path / "bare"))
    assert list(seen.report(spark).first()) == [3, 2, 0, 0, 0, 0, 0, 0.0]
    none, seen = Tables(t.events.limit(0), t.snapshots, t.embeddings, t.probe, t.rasters), StepMetrics()
    run_tables(none, DEFAULT, metrics=seen).write.parquet(str(tmp_path / "none"))
    assert list(seen.report(spark).first()) == [0] * 7 + [0.0]


def test_missing_tables_and_columns(spark, folder):
    with pytest.raises(ValueError, match="snapshots"):
        read_tables(spark, os.path.join(folder, "events.parquet"))
    at = tempfile.mkdtemp(prefix="chronotile-user-")
    spark.range(3).write.parquet(f"{at}/events")
    for name in ("snapshots", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{at}/{name}")
    with pytest.raises(ValueError, match="required columns"):
        read_tables(spark, at)


def test_missing_ids_are_selected_by_range(spark):
    at = tempfile.mkdtemp(prefix="chronotile-user-")
    snaps = spark.createDataFrame([("a", 9, 25100, "png")], "release_id string, tile_col int, tile_row int, ext string")
    vectors = spark.createDataFrame([("9_25100_a.png", [1.0, 0.0])], "image string, embedding array<float>")
    ev = spark.range(-3, 4000).selectExpr("if(id % 500 = 3, null, id) id", "cast(id as int) tile_col", "25100 tile_row", "'a' from_release_id",
                                          "'b' to_release_id", "5 largest_run")
    write_ranges(ev.repartition(2), f"{at}/events", "id", 2)
    for name, rows in (("snapshots", snaps), ("embeddings", vectors)):
        rows.write.parquet(f"{at}/{name}")
    steps, ids = ("classify", "mask", "enrich"), lambda x: sorted(map(tuple, run_tables(x, DEFAULT, skip=steps).select("event_id", "tile_col").collect()))
    got = read_tables(spark, at)
    low = got.low_events[1]
    assert low.count() == 3 + 1 + 8 and low.rdd.getNumPartitions() < 8 < got.events.rdd.getNumPartitions()
    assert ids(got) == ids(Tables(ev, snaps, vectors)) and len(ids(got)) == 4003
    some = replace(got, events=got.events.where("id is null or id > 2"))
    assert ids(some) == ids(Tables(ev.where("id is null or id > 2"), snaps, vectors))
