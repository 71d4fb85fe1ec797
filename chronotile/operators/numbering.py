"""Global prefix numbering without a single-partition window.

Used for row positions (P2), global episode ids (W2) and cluster numbers (W5). The data is range-partitioned
on a total order, sorted inside each partition and checkpointed to the cluster's checkpoint folder, so partition
ids and in-partition order are stable across the passes and survive lost executors. Then:

1. one tiny aggregate gives each partition's totals (one row per partition, a proven size bound) and their
   running offsets, broadcast to every task;
2. one Arrow-batched pass per partition computes in-partition running sums / maxima and adds the offset.

No group, task or driver ever holds more than one range partition; a hot key is spread over several range
partitions because the order includes a unique tie-breaker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotile.session import ensure_checkpoint_dir

PID = "_pid"


def _num_partitions(df: DataFrame, requested: int | None) -> int:
    if requested:
        return requested
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def _scan_fn(sum_cols: list[str], max_cols: list[str]):
    def scan(batches):
        carry_sum = {c: 0 for c in sum_cols}
        carry_max = {c: float("nan") for c in max_cols}
        for pdf in batches:
            if pdf.empty:
                continue
            for c in sum_cols:
                cs = pdf[c].fillna(0).astype("int64").cumsum() + carry_sum[c]
                carry_sum[c] = int(cs.iloc[-1])
                pdf[c] = cs
            for c in max_cols:
                cm = pdf[c].astype("float64").cummax().ffill()
                prev = carry_max[c]
                if prev == prev:  # not NaN
                    cm = cm.fillna(prev).clip(lower=prev)
                last = cm.iloc[-1]
                carry_max[c] = last
                pdf[c] = cm
            yield pdf

    return scan


def ordered_checkpoint(df: DataFrame, order: Sequence, num_partitions: int | None = None) -> DataFrame:
    """Range-partition on ``order``, sort inside partitions, and checkpoint (reliable, to spark.checkpoint.dir)."""
    ensure_checkpoint_dir(df.sparkSession)
    n = _num_partitions(df, num_partitions)
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint(eager=True)


def prefix_scan(
    df: DataFrame,
    order: Sequence,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add inclusive running sums (long) and running maxima (long, nulls skipped) in the global ``order``.

    ``order`` must be a total order (end it with a unique key) for the result to be deterministic."""
    sums = sums or {}
    maxes = maxes or {}
    staged = df.select(
        "*",
        *[c.cast("long").alias(f"_s_{k}") for k, c in sums.items()],
        *[c.cast("long").alias(f"_m_{k}") for k, c in maxes.items()],
    )
    ranged = ordered_checkpoint(staged, order, num_partitions)
    s_cols = [f"_s_{k}" for k in sums]
    m_cols = [f"_m_{k}" for k in maxes]

    totals = ranged.groupBy(F.spark_partition_id().alias(PID)).agg(
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in s_cols],
        *[F.max(c).alias(c) for c in m_cols],
        F.count(F.lit(1)).alias("_n"),
    )
    before = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        PID,
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off{c}") for c in s_cols],
        *[F.max(c).over(before).alias(f"_off{c}") for c in m_cols],
    )

    # the partition number comes from the plan: a task's own number is another one where a union puts this plan second
    ranged = ranged.withColumn(PID, F.spark_partition_id())
    out_fields = list(ranged.schema.fields)
    out_schema = T.StructType(
        [f if f.name not in m_cols else T.StructField(f.name, T.DoubleType(), True) for f in out_fields]
    )
    local = ranged.mapInPandas(_scan_fn(s_cols, m_cols), out_schema)
    # offsets has one row per partition: a proven bound, so broadcasting it is safe at any data size.
    joined = local.join(F.broadcast(offsets), PID, "left")
    result = joined.select(
        *[c for c in df.columns],
        *[(F.col(f"_s_{k}") + F.coalesce(F.col(f"_off_s_{k}"), F.lit(0))).cast("long").alias(k) for k in sums],
        *[F.greatest(F.col(f"_m_{k}").cast("long"), F.col(f"_off_m_{k}")).alias(k) for k in maxes],
    )
    return result


def with_row_number(df: DataFrame, order: Sequence, name: str = "row_no", start: int = 1,
                    num_partitions: int | None = None) -> DataFrame:
    """Consecutive global row number in ``order`` (``start``-based), by the range-partitioned prefix scan."""
    out = prefix_scan(df, order, sums={name: F.lit(1)}, num_partitions=num_partitions)
    return out.withColumn(name, F.col(name) - 1 + start) if start != 1 else out
