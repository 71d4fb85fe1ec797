"""Image embedding and pair similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotile.functions.images import basename
from chronotile.functions.vectors import cosine_fast
from chronotile.operators.selection import exact_median


def unique_images(pairs: DataFrame) -> DataFrame:
    """Distinct image names over before and after sides, empties dropped (``image`` is the base name)."""
    sides = pairs.select(F.col("before_image").alias("image_path")).union(
        pairs.select(F.col("after_image").alias("image_path"))
    )
    return (
        sides.where(F.col("image_path").isNotNull() & (F.col("image_path") != ""))
        .select(basename("image_path").alias("image"))
        .distinct()
    )


def images_to_embed(images: DataFrame, cache: DataFrame, model: str | None = None) -> DataFrame:
    """Images without a cached vector (left-anti on the image name, and on the model when the cache has one)."""
    keys = ["image"]
    if model is not None and "model" in cache.columns:
        images = images.withColumn("model", F.lit(model))
        keys.append("model")
    return images.join(cache.select(*keys), keys, "left_anti")


def embed_images(
    images: DataFrame,
    make_predict_fn: Callable,
    input_col: str = "data",
    batch_size: int = 32,
    model: str | None = None,
    input_shape: list[int] | None = None,
) -> DataFrame:
    """Batch inference with ``predict_batch_udf``: the user supplies the model factory, which runs once per
    Python worker and receives numpy batches of ``batch_size`` rows. Output rows: image, embedding, dim."""
    from pyspark.ml.functions import predict_batch_udf

    shapes = [list(input_shape)] if input_shape else None
    embed = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                              input_tensor_shapes=shapes)
    out = images.select("image", embed(F.col(input_col)).alias("embedding"))
    out = out.withColumn("dim", F.size("embedding"))
    if model is not None:
        out = out.withColumn("model", F.lit(model))
    return out


def block_mean_embedder(height: int = 8, width: int = 8, block: int = 2) -> Callable:
    """Deterministic stand-in model for tests: mean of ``block x block`` pixel blocks of gray bytes, scaled to 0..1."""

    def make_predict_fn():
        import numpy as np

        def predict(x):
            arr = np.frombuffer(b"".join(x), np.uint8).astype(np.float32).reshape(-1, height // block, block, width // block, block)
            return (arr.mean(axis=(2, 4)) / 255.0).reshape(arr.shape[0], -1)

        return predict

    return make_predict_fn


def pair_similarity(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``dino_similarity`` = cosine of the before and after vectors; null when either is missing.

    Two left equi-joins on the image name (sort-merge, or shuffled hash when AQE sees a small side)."""
    emb = embeddings.select("image", "embedding")
    b = emb.select(F.col("image").alias("_b"), F.col("embedding").alias("_vb"))
    a = emb.select(F.col("image").alias("_a"), F.col("embedding").alias("_va"))
    p = pairs.withColumn("_b", F.when(F.col("before_image") != "", basename("before_image"))).withColumn(
        "_a", F.when(F.col("after_image") != "", basename("after_image"))
    )
    j = p.join(b, "_b", "left").join(a, "_a", "left")
    return j.withColumn("dino_similarity", cosine_fast("_vb", "_va")).drop("_a", "_b", "_va", "_vb")


def similarity_stats(pairs: DataFrame, threshold: float) -> DataFrame:
    """Mean, exact median and share below the threshold of non-null similarities (one row; nulls when there is none)."""
    s = F.col("dino_similarity")
    # the narrow column is read by every pass of the selection and by the moments: materialise it once
    valid = pairs.where(s.isNotNull()).select("dino_similarity").checkpoint(eager=True)
    return valid.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(s).alias("mean_similarity"),
        F.lit(exact_median(valid, "dino_similarity")).cast("double").alias("median_similarity"),
        F.avg((s < threshold).cast("double")).alias("share_below"),
    )
