"""Importance score.

``clip(w_r*clip(ratio,0,1) + w_m*(1-clip(sim,0,1)) + w_l*[change_type != ''] + w_t*recency, 0, 1)`` with
null similarity -> 1.0, null ratio -> 0.0; recency = (to - min) / max(max - min, 1e-9 s) over rows whose
``to_date`` parses, else 0. The global min/max are one-row scalar subqueries (partial aggregates), not a
single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotile.operators.episodes import parse_ts
from chronotile.params import Params


def _clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def importance_score(df: DataFrame, p: Params, dates: DataFrame | None = None) -> Column:
    """``dates``: a stored table with the rows' ``to_date``, from which the bounds are taken instead of from the rows themselves."""
    w = p.weights
    dino = _clip01(F.coalesce(F.col("dino_similarity"), F.lit(1.0)))
    magnitude = F.lit(1.0) - dino
    ratio = _clip01(F.coalesce(F.col("change_ratio"), F.lit(0.0)))
    if "change_type_tr" in df.columns:
        land = (F.col("change_type_tr") != "").cast("double")
    else:
        land = F.lit(0.0)
    to_ts = parse_ts("to_date")
    bounds = (df if dates is None else dates).select(F.struct(F.min(to_ts).alias("lo"), F.max(to_ts).alias("hi"))).scalar()
    t_min, t_max = bounds["lo"], bounds["hi"]
    span_s = F.greatest((F.unix_micros(t_max) - F.unix_micros(t_min)).cast("double") / 1e6, F.lit(1e-9))
    recency = F.when(to_ts.isNotNull(), (F.unix_micros(to_ts) - F.unix_micros(t_min)).cast("double") / 1e6 / span_s).otherwise(F.lit(0.0))
    score = F.lit(w.change_ratio) * ratio + F.lit(w.magnitude) * magnitude + F.lit(w.land_impact) * land + F.lit(w.recency) * recency
    return _clip01(score)


def importance(changes: DataFrame, p: Params, dates: DataFrame | None = None) -> DataFrame:
    base = changes.drop("importance")
    return base.withColumn("importance", importance_score(base, p, dates))
