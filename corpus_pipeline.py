"""A training-data pipeline over ``documents``: toxicity, SimHash near-duplicates, PII, mixing, SentencePiece.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the last return the columns of
``documents``. Stages: toxic documents go; of each near-duplicate group the document with the smallest id stays; personal
data is replaced by its kind; documents are dropped or repeated to meet the sources' target weights; texts are encoded, and decoded
again to show that nothing is lost.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chronotile.llm import mixing, pii, sentencepiece_codec, simhash, toxicity  # noqa: E402
from chronotile.llm.common import prepare, table  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier is fitted on the labelled documents of the source table; the stage's own input is scored."""
    prepare(spark)
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every text, and whether they spell it again."""
    return sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"), verify=True).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet folder of this run under the shared checkpoint folder."""
    prepare(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = f"{base}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
    return docs


#: The fitted classifier, component search and sampled segmentations are not SQL: tests hold the rows against brute force.
ORACLE_SQL = None
