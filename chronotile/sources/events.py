"""Change-event and snapshot sources.

Production reads Parquet (or any Spark source) with declared columns; unknown optional columns are picked only when
present and the rest are filled by ``normalize_events``. Validation and counts are plain aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotile.operators.pairs import iso_text
from chronotile.schema import EVENT_OPTIONAL, EVENT_REQUIRED, SNAPSHOT_KEY

DATE_COLUMNS = ("from_date", "to_date", "detected_at")


def scan_change_events(events: DataFrame) -> DataFrame:
    """Project the core and the known optional columns that exist; date text is parsed and re-printed in ISO form
    (text that does not parse is kept). Order by id is applied only where a position matters (``normalize_events``)."""
    known = [c for c in [*EVENT_REQUIRED, *EVENT_OPTIONAL] if c in events.columns]
    return events.select(*[iso_text(F.col(c)).alias(c) if c in DATE_COLUMNS else F.col(c) for c in known])


def read_change_events(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return scan_change_events(spark.read.format(fmt).options(**options).load(path))


def source_counts(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("change_count")).select(
        "change_count", snapshots.select(F.count(F.lit(1))).scalar().alias("snapshot_count"))


def validate_source(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row of checks: required columns present, rows, null / duplicate event ids, null / duplicate snapshot keys.
    Raises when a required column is missing (the table cannot be read at all)."""
    missing = [c for c in EVENT_REQUIRED if c not in events.columns]
    if missing:
        raise ValueError(f"change events lack required columns: {missing}")
    ev = events.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("id").isNull()).alias("null_ids"),
        (F.count(F.col("id")) - F.count_distinct("id")).alias("duplicate_ids"),
    )
    key_null = F.col("release_id").isNull() | F.col("tile_col").isNull() | F.col("tile_row").isNull()
    sn_null = snapshots.select(F.count_if(key_null)).scalar()
    dup = snapshots.groupBy(*SNAPSHOT_KEY).count().where(F.col("count") > 1).select(F.count(F.lit(1))).scalar()
    return ev.select("rows", "null_ids", "duplicate_ids", sn_null.alias("snapshot_null_keys"), dup.alias("snapshot_duplicate_keys"))


def snapshot_formats(snapshots: DataFrame) -> DataFrame:
    """The stored content type of every snapshot (the reference looks it up in the wrong table and gets None)."""
    return snapshots.select(*SNAPSHOT_KEY, "content_type")
