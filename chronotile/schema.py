"""Declared schemas and the ``conform`` helper for columns an input may lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Change-event columns: name -> (type, default when missing or falsy).
EVENT_OPTIONAL = {
    "from_date": (T.StringType(), ""),
    "to_date": (T.StringType(), ""),
    "detected_at": (T.StringType(), ""),
    "ssim_score": (T.DoubleType(), 0.0),
    "change_ratio": (T.DoubleType(), 0.0),
    "largest_run": (T.IntegerType(), 0),
    "land_windows": (T.IntegerType(), 0),
    "water_windows": (T.IntegerType(), 0),
    "ssim_min": (T.DoubleType(), 0.0),
    "ssim_p05": (T.DoubleType(), 0.0),
    "embedding_similarity": (T.DoubleType(), 0.0),
    "embedding_computed": (T.IntegerType(), 0),
    "from_land_cover": (T.StringType(), ""),
    "to_land_cover": (T.StringType(), ""),
}

EVENT_REQUIRED = ["id", "tile_col", "tile_row", "from_release_id", "to_release_id"]

PAIR_COLUMNS = [
    "event_id", "tile_col", "tile_row", "from_release_id", "from_date", "to_release_id", "to_date",
    "detected_at", "ssim_score", "change_ratio", "largest_run", "land_windows", "water_windows",
    "ssim_min", "ssim_p05", "embedding_similarity", "embedding_computed", "from_land_cover",
    "to_land_cover", "before_image", "after_image",
]

SNAPSHOT_KEY = ["release_id", "tile_col", "tile_row"]

EMBEDDING_SCHEMA = T.StructType([
    T.StructField("image", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("dim", T.IntegerType()),
])

VERDICT_COLUMNS = ["ai_is_real", "ai_change_type", "ai_cause_tr", "ai_confidence", "ai_model"]


def conform(df: DataFrame, columns: dict) -> DataFrame:
    """Add each missing column as a typed literal default; existing columns are left as they are."""
    present = set(df.columns)
    extra = [F.lit(default).cast(dtype).alias(name) for name, (dtype, default) in columns.items() if name not in present]
    return df.select("*", *extra) if extra else df


def empty_like(df: DataFrame) -> DataFrame:
    return df.limit(0)
