"""Noise filter (F1, F2, P19): keep pairs whose images differ semantically."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotile.params import Params


def noise_filter(pairs: DataFrame, p: Params) -> DataFrame:
    """``(sim IS NULL OR sim < threshold) AND largest_run >= min``; NaN is not below any threshold.
    The change-ratio floor applies only when it is > 0. Adds ``candidate_reason`` and ``is_candidate``."""
    sim = F.col("dino_similarity")
    below = sim < F.lit(p.similarity_threshold)
    keep = (sim.isNull() | (below & ~F.isnan(sim))) & (F.col("largest_run") >= p.min_largest_run)
    if p.min_change_ratio > 0:
        keep = keep & (F.col("change_ratio") >= p.min_change_ratio)
    return pairs.where(keep).select(
        "*",
        F.when(sim.isNull(), F.lit("no_embedding")).otherwise(F.lit("dino")).alias("candidate_reason"),
        F.lit(True).alias("is_candidate"),
    )
