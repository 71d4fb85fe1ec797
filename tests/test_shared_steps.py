"""Steps that many queries share run once over their input and move no column that can be made later."""

import os
import tempfile

from pyspark.sql import functions as F

from chronotile.operators.episodes import episodes
from chronotile.operators.importance import importance
from chronotile.params import FIXTURE
from chronotile.plans import stages as S
from chronotile.plans.export import summary_maps
from chronotile.plans.store import FILE_ROWS, write_changes
from chronotile.sources import fixtures as fx
from chronotile.sources.versioned import VersionedTable


def counted(spark, rows):
    """The rows, and a counter of how often one of them is made."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return rows.mapInArrow(run, rows.schema), seen


def some(spark, n=40):
    return spark.range(n).select(
        F.col("id").alias("event_id"), (F.col("id") % 3).cast("int").alias("tile_col"), F.lit(7).alias("tile_row"),
        F.concat(F.lit("199"), (F.col("id") % 4).cast("string"), F.lit("-05-06T00:00:00")).alias("from_date"),
        F.when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit("199"), (F.col("id") % 4 + 3).cast("string"), F.lit("-05-06T00:00:00"))).alias("to_date"),
        F.lit(0.25).alias("dino_similarity"), F.lit(0.5).alias("change_ratio"), F.when(F.col("id") % 2 == 0, "a").otherwise("").alias("change_type_tr"))


def test_summary_maps_read_their_input_once(spark):
    rows, seen = counted(spark, some(spark))
    r = summary_maps(rows).first()
    assert r.change_types == {"a": 20, "": 20} and r.by_year == {"1993": 8, "1994": 8, "1995": 8, "1996": 8}
    assert seen.value == 40


def test_snapshots_by_month_are_those_of_the_events(spark, sf_small):
    whole = fx.tile_snapshots(spark, sf_small)
    of_events = fx.tile_snapshots(spark, sf_small, fx.change_events(spark, sf_small))
    assert whole.columns == of_events.columns and whole.count() == of_events.count() and whole.exceptAll(of_events).isEmpty()


def test_stored_rows_give_the_same_episodes_and_importance(spark):
    rows, seen = counted(spark, some(spark))
    stored = rows.checkpoint(eager=True)
    out = importance(episodes(stored, stored=True), FIXTURE, dates=stored).collect()
    assert seen.value == 40
    assert sorted(map(tuple, out)) == sorted(map(tuple, importance(episodes(some(spark)), FIXTURE).collect()))


def test_files_grow_in_number_with_the_rows(spark):
    path = tempfile.mkdtemp(prefix="chronotile-files-") + "/t"
    write_changes(some(spark, 400), path, rows=20 * FILE_ROWS, widen=lambda df: df.withColumn("wide", F.lit("x")))
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 20
    back = spark.read.parquet(path)
    assert back.count() == 400 and back.columns[-2:] == ["wide", "zkey"]


def test_geometry_is_made_after_the_joins(spark, sf_small):
    m = S.masked(spark, sf_small, FIXTURE.with_(cell_size=1, diff_threshold=60, min_area=4))
    assert "geometry" not in m.rows.columns and "geometry" not in m.changes.columns
    names = m.whole.columns
    assert names[names.index("geometry"):names.index("geometry") + 4] == ["geometry", "centroid_lon", "centroid_lat", "episode_id"]


def test_one_row_for_a_key_needs_no_text_of_the_row(spark):
    table = VersionedTable(spark, tempfile.mkdtemp(prefix="chronotile-one-") + "/t", ["k"])
    rows = spark.createDataFrame([(1, [0.5]), (1, [1.5]), (2, None)], "k int, v array<float>")
    one = table._one_each(rows)
    assert "to_json" not in one._jdf.queryExecution().toString()
    assert sorted(r.k for r in one.collect()) == [1, 2] and one.collect() == table._one_each(rows.orderBy(F.desc("v"))).collect()
