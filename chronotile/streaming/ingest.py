"""Incremental ingestion: new change-event files flow through pairing, similarity and the noise filter.

The reference has no streaming operator; its resumability (skip cached embeddings, do not rewrite images) maps to
a Structured Streaming query with ``Trigger.AvailableNow``: each run processes only files not seen by the checkpoint,
then stops. All steps are stateless stream-static joins and filters, so no state store or watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chronotile.operators.embed import pair_similarity
from chronotile.operators.noise import noise_filter
from chronotile.operators.pairs import build_pairs
from chronotile.params import Params

EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("tile_col", T.IntegerType()),
    T.StructField("tile_row", T.IntegerType()),
    T.StructField("from_release_id", T.StringType()),
    T.StructField("from_date", T.StringType()),
    T.StructField("to_release_id", T.StringType()),
    T.StructField("to_date", T.StringType()),
    T.StructField("detected_at", T.StringType()),
    T.StructField("ssim_score", T.DoubleType()),
    T.StructField("change_ratio", T.DoubleType()),
    T.StructField("largest_run", T.IntegerType()),
])


def candidate_stream(events: DataFrame, snapshots: DataFrame, embeddings: DataFrame, p: Params) -> DataFrame:
    """Streaming (or batch) events -> change candidates; snapshots and embeddings are static tables."""
    pairs = build_pairs(events, snapshots, fallback_ids=False)
    return noise_filter(pair_similarity(pairs, embeddings), p)


def ingest(spark: SparkSession, events_dir: str, snapshots: DataFrame, embeddings: DataFrame, p: Params,
           out_path: str, checkpoint: str, schema: T.StructType = EVENT_SCHEMA) -> StreamingQuery:
    """Start an AvailableNow query appending new candidates to Parquet at ``out_path``."""
    events = spark.readStream.schema(schema).parquet(events_dir)
    cand = candidate_stream(events, snapshots, embeddings, p)
    return (
        cand.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .format("parquet")
        .outputMode("append")
        .start(out_path)
    )
