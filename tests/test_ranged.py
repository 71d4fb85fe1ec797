"""Event files by key range: what is written comes back, and ranges decide what is read."""

import json
import os
import pickle
import tempfile

import pytest
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chronotile.operators.pairs import normalize_events
from chronotile.sources.events import scan_change_events
from chronotile.sources.ranged import MANIFEST, PARTITIONS, PARTS, RangeReader, RangeWriter, read_ranges, write_ranges


@pytest.fixture()
def path():
    return os.path.join(tempfile.mkdtemp(prefix="chronotile-ranges-"), "t")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(-5, 5000).selectExpr("if(id % 1000 = 7, null, id) id", "cast(id % 7 as int) c", "if(id % 11 = 0, null, concat('x', id % 3)) s",
                                            "cast(id as double) / 3 d", "cast(cast(id as string) as binary) b")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("sql,where", [
    ("id >= 1500 and id < 2100 and s = 'x1'", [("id", ">=", 1500), ("id", "<", 2100), ("s", "==", "x1")]), ("id is null", [("id", "null")]),
    ("id in (3, 4)", [("id", "in", [3, 4, None])]), ("id = 12345678", [("id", "==", 12345678)]), ("c = 3", [("c", "==", 3)]),
    ("id is not null and s is null", [("id", "not null"), ("s", "null")]), ("id > 4990", [("id", ">", 4990)]), ("id <= -1", [("id", "<=", -1)]), ("true", [])])
def test_conditions(spark, rows, path, sql, where):
    write_ranges(rows.repartition(3), path, width=1000)
    got = read_ranges(spark, path, where)
    assert same(got, rows.where(sql))
    assert same(got.where("id < 4000 or d is null"), rows.where(sql).where("id < 4000 or d is null")) and same(got, rows.where(sql))


def test_ranges_are_seen_and_decide_the_partitions(spark, rows, path):
    write_ranges(rows.repartition(4), path, width=1000)
    got = read_ranges(spark, path, range_column="first")
    assert got.where("first is distinct from floor(id / 1000) * 1000").count() == 0 and got.select("first").distinct().count() == 7
    assert got.rdd.getNumPartitions() == 7
    assert read_ranges(spark, path, [("id", ">=", 1500), ("id", "<=", 2100)]).rdd.getNumPartitions() == 2
    assert read_ranges(spark, path, [("id", "==", 2100)]).rdd.getNumPartitions() == 1
    assert read_ranges(spark, path, rows_per_partition=300).rdd.getNumPartitions() == 4 * 5 + 2
    with pytest.raises(Exception, match="has a column"):
        read_ranges(spark, path, range_column="c")
    for where in ([("d", "==", 1.0)], [("id", "~", 1)], [("no", "==", 1)]):
        with pytest.raises(Exception, match="no condition"):
            read_ranges(spark, path, where).count()


def test_columns_and_appends(spark, rows, path):
    write_ranges(rows.where("id < 100"), path, width=64)
    write_ranges(rows.where("id >= 100 or id is null"), path, width=64, mode="append")
    assert same(read_ranges(spark, path, columns=["s", "id"], where=[("c", ">=", 0)]), rows.where("c >= 0").select("s", "id"))
    with pytest.raises(Exception, match="appended"):
        write_ranges(rows, path, width=65, mode="append")
    assert same(read_ranges(spark, path), rows)


def test_a_failed_write_changes_nothing_and_a_new_one_replaces_all(spark, rows, path):
    write_ranges(rows, path, width=1000)
    broken = rows.selectExpr("if(id = 4000, cast(raise_error('stop') as long), id) id", "c", "s", "d", "b")
    with pytest.raises(Exception, match="stop"):
        write_ranges(broken, path, width=1000)
    assert same(read_ranges(spark, path), rows)
    write_ranges(rows.where("id = 3"), path, width=1000)
    assert read_ranges(spark, path).count() == 1
    with open(os.path.join(path, MANIFEST), encoding="utf-8") as f:
        assert [x["rows"] for x in json.load(f)["files"]] == [1]


def test_empty_table_and_unfit_key(spark, rows, path):
    write_ranges(rows.limit(0), path)
    back = read_ranges(spark, path)
    assert back.count() == 0 and back.schema.simpleString() == rows.schema.simpleString()
    with pytest.raises(Exception, match="whole-number"):
        write_ranges(rows, path, key="s")


def test_events_with_missing_columns_and_null_ids(spark, path):
    rows = [(7, 1, 2, "WB 2020/01", "WB 2021/01", "2020-01-02 03:04", 0.5), (None, 1, 2, "WB 2020/01", "WB 2021/01", "", None),
            (0, 1, 3, "WB 2020/01", "WB 2021/01", "bad", 0.1), (-4, 1, 3, "WB 2020/01", "WB 2021/01", "2020-01-02T03:04:05.5Z", 0.1)]
    ev = spark.createDataFrame(rows, "id long, tile_col int, tile_row int, from_release_id string, to_release_id string, to_date string, ssim_score double")
    write_ranges(ev, path, width=4)
    got = normalize_events(scan_change_events(read_ranges(spark, path)))
    assert sorted((r.event_id, r.to_date, r.ssim_score, r.largest_run) for r in got.collect()) == [
        (-4, "2020-01-02T03:04:05.500000+00:00", 0.1, 0), (0, "", 0.0, 0), (2, "bad", 0.1, 0), (7, "2020-01-02T03:04:00", 0.5, 0)]


def many(spark):
    return spark.range(-50, 20000).selectExpr("if(id % 1000 = 7, null, id) id", "cast(id % 7 as int) c", "id * 2 twice")


def test_many_ranges_share_files_and_partitions(spark, path):
    rows = many(spark)
    write_ranges(rows.repartition(3), path, width=8)  # 2,507 ranges, of which every task has most
    with open(os.path.join(path, MANIFEST), encoding="utf-8") as f:
        found = json.load(f)["files"]
    assert len(found) == 3 and sum(x["rows"] for x in found) == 20050 and sum(len(x["parts"]) for x in found) <= 3 * 2 * PARTS
    got = read_ranges(spark, path, range_column="first")
    assert got.rdd.getNumPartitions() <= 2 * PARTITIONS
    assert same(got, rows.selectExpr("*", "floor(id / 8) * 8 first"))
    assert same(read_ranges(spark, path, columns=["twice"], range_column="first"), rows.selectExpr("twice", "floor(id / 8) * 8 first"))
    for sql, where in (("id between 700 and 5000 and c = 3", [("id", ">=", 700), ("id", "<=", 5000), ("c", "==", 3)]), ("id is null", [("id", "null")]),
                       ("id in (-50, 8, 19999)", [("id", "in", [-50, 8, 19999])]), ("id < -3", [("id", "<", -3)])):
        assert same(read_ranges(spark, path, where), rows.where(sql))
    assert read_ranges(spark, path, [("id", "in", [8, 9])]).rdd.getNumPartitions() <= 3
    assert read_ranges(spark, path, rows_per_partition=100).rdd.getNumPartitions() >= 200
    write_ranges(rows.where("id < 100"), path, width=8, mode="append")
    assert same(read_ranges(spark, path), rows.union(rows.where("id < 100")))


def test_a_task_is_not_sent_the_manifest(spark, path):
    sizes = []
    for n in (1, 30):
        write_ranges(spark.range(n * 1000).repartition(n), path, width=8)
        sizes.append(len(pickle.dumps(RangeReader(path, T.StructType([T.StructField("id", T.LongType())]), {}))))
    assert sizes[0] == sizes[1]


def test_rows_without_order_and_files_of_one_range(spark, path):
    rows = many(spark).repartition(2)
    ready = RangeWriter(path, rows.schema, True, {"width": 4000})
    batches = rows.where("id is null or id < 9000").toArrow().cast(to_arrow_schema(rows.schema)).to_batches(max_chunksize=100)
    ready.commit([ready.write(iter(batches))])  # not from write_ranges: a range that comes again begins a new file
    assert same(read_ranges(spark, path), rows.where("id is null or id < 9000"))
    write_ranges(rows.where("id between 4 and 7"), path, width=4)
    at = os.path.join(path, MANIFEST)
    with open(at, encoding="utf-8") as f:
        found = json.load(f)
    for x in found["files"]:  # as tables were listed before: a file of one range without parts
        (x["start"], x["min"], x["max"], x["rows"]), = x.pop("parts")
    with open(at, "w", encoding="utf-8") as f:
        json.dump(found, f)
    write_ranges(rows.where("id > 19990"), path, width=4, mode="append")
    assert same(read_ranges(spark, path, [("id", "<", 19995)], range_column="first"),
                rows.where("id between 4 and 7 or id between 19991 and 19994").selectExpr("*", "floor(id / 4) * 4 first"))
