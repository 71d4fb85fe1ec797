"""Joins with the stored image table: no exchange on its side, same rows as without buckets."""

import re

import pytest
from pyspark.sql import functions as F

from chronotile.operators.embed import pair_similarity
from chronotile.operators.landcover import classify_changes
from chronotile.operators.vectors import vector_table
from chronotile.plans.store import bucketed


@pytest.fixture(scope="module")
def tables(spark):
    images = spark.range(300).select(F.concat(F.lit("i"), "id", F.lit(".png")).alias("image"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding"),
                                     F.lit("Forest").alias("land_cover"), F.lit(0.9).alias("land_cover_conf"))
    side = lambda k: F.when(F.col("id") % 11 == k, F.lit("")).otherwise(F.concat(F.lit("images/i"), (F.col("id") * k) % 310, F.lit(".png")))
    return images, spark.range(500).select(F.col("id").alias("event_id"), side(3).alias("before_image"), side(7).alias("after_image"))


def exchanges_over_scans(df):
    """For each bucketed scan of the plan, whether an exchange stands between it and the next join."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(re.match(r"[ :+|\-]*", line).group())
    out = []
    for at, line in enumerate(plan):
        if "Bucketed: true" not in line:
            continue
        d, crossed = depth(line), False
        for above in reversed(plan[:at]):
            if depth(above) < d:
                d = depth(above)
                crossed |= "Exchange" in above
                if "Join" in above:
                    break
        out.append(crossed)
    return out


def test_no_exchange_on_the_stored_side(spark, tables):
    images, pairs = tables
    stored = bucketed(images, "t", "image", 8)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for step, scans in ((pair_similarity(pairs, stored), 2), (classify_changes(pairs, stored), 2), (vector_table(pairs, stored), 1)):
            assert exchanges_over_scans(step) == [False] * scans
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_same_rows_as_without_buckets(spark, tables):
    images, pairs = tables
    stored = bucketed(images, "t", "image", 5)
    for step in (pair_similarity, classify_changes, vector_table):
        a, b = step(pairs, images), step(pairs, stored)
        assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_empty_table_and_null_key(spark, tables):
    images, pairs = tables
    assert bucketed(images.where("false"), "t", "image").count() == 0
    assert bucketed(images.withColumn("image", F.lit(None).cast("string")).limit(2), "t", "image").count() == 2
