"""The keyed table of versions: upserts, failures, repeated batches, readers of older versions, streams."""

import uuid

import pytest
from pyspark.sql import functions as F

from chronotile.sources.versioned import Conflict, VersionedTable

SCHEMA = "image string, model string, embedding array<float>, dim int"


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "vectors"), ["image", "model"])


def rows(spark, *keys, value=1.0):
    return spark.createDataFrame([(i, m, [value], 1) for i, m in keys], SCHEMA)


def held(df):
    return sorted(((r.image, r.model, r.embedding[0]) for r in df.collect()), key=str)


def test_append_keeps_the_first_and_upsert_the_last(spark, table):
    assert table.read() is None and table.versions() == []
    table.append_new(rows(spark, ("a", "m"), ("b", "m")))
    table.append_new(rows(spark, ("b", "m"), ("b", "n"), value=2.0))
    assert held(table.read()) == [("a", "m", 1.0), ("b", "m", 1.0), ("b", "n", 2.0)]
    table.upsert(rows(spark, ("a", "m"), ("c", "m"), value=3.0))
    assert held(table.read()) == [("a", "m", 3.0), ("b", "m", 1.0), ("b", "n", 2.0), ("c", "m", 3.0)]
    assert table.versions() == [1, 2, 3]


def test_reader_of_an_old_version_is_not_disturbed(spark, table):
    table.append_new(rows(spark, ("a", "m")))
    old = table.read()
    table.replace(rows(spark, ("z", "m"), value=9.0))
    table.upsert(rows(spark, ("z", "m"), value=8.0))
    assert held(old) == held(table.read(1)) == [("a", "m", 1.0)]
    assert held(table.read()) == [("z", "m", 8.0)]
    with pytest.raises(ValueError, match="no version"):
        table.read(7)


def test_repeated_and_null_keys(spark, table):
    batch = rows(spark, ("a", "m"), (None, "m"), (None, "m")).union(rows(spark, ("a", "m"), value=5.0))
    table.append_new(batch)
    first = held(table.read())
    assert len(first) == 2
    table.append_new(batch.repartition(5))
    assert held(table.read()) == first


def test_failed_write_leaves_the_table_and_can_be_repeated(spark, table):
    table.append_new(rows(spark, ("a", "m")))
    bad = rows(spark, ("b", "m")).withColumn("dim", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        table.append_new(bad, ("job", 0))
    assert table.versions() == [1] and held(table.read()) == [("a", "m", 1.0)]
    for _ in range(2):
        table.append_new(rows(spark, ("b", "m")), ("job", 0))
    assert table.versions() == [1, 2] and len(held(table.read())) == 2


def test_replace_by_nothing_raises(spark, table):
    table.append_new(rows(spark, ("a", "m")))
    with pytest.raises(ValueError, match="nothing"):
        table.replace(rows(spark, ("b", "m")).where("false"))
    assert held(table.read()) == [("a", "m", 1.0)]


def test_two_writers_of_one_version(spark, table):
    base = table.commit_of()
    table.append_new(rows(spark, ("a", "m")))
    part = table._part(rows(spark, ("b", "m")))
    with pytest.raises(Conflict):
        table._commit(base, [part], None)
    assert held(table.read()) == [("a", "m", 1.0)]


def test_stream_of_files_writes_each_key_once(spark, table, tmp_path):
    source = str(tmp_path / "in")
    for keys in ([("a", "m"), ("b", "m")], [("b", "m"), ("c", "m")]):
        rows(spark, *keys).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # a checkpoint of its own each time, so that all batches come again
        q = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source).writeStream.trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / f"ck-{uuid.uuid4().hex}")).foreachBatch(table.sink("vectors")).start())
        q.awaitTermination()
    assert [k[:2] for k in held(table.read())] == [("a", "m"), ("b", "m"), ("c", "m")]
    assert table.versions() == [1, 2]


def test_more_columns_later(spark, table):
    table.append_new(rows(spark, ("a", "m")))
    table.append_new(rows(spark, ("b", "m")).withColumn("note", F.lit("x")))
    assert {(r.image, r.note) for r in table.read().collect()} == {("a", None), ("b", "x")}
