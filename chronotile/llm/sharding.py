"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts).

Groups sorted by size, largest first, enter the bin with the least remaining capacity that still holds them; the bins
stand in an ordered tree keyed by remaining capacity. With a fixed number of shards the capacity is an equal part of
all bytes, after groups too large for such a part got a shard of their own; what fits nowhere enters the emptiest bin.
Without a number of shards, a group that fits nowhere opens a new bin.

Scale: packing needs only the sizes and how many groups have each. A bin that a size fits best takes groups of that size
until it is full, so a size enters the bins in runs, and the group of a rank among those of its size belongs to the run
that covers the rank. There are at most sqrt(2 * bytes) different sizes, and the one packing task and the broadcast tables
hold a row for each, for each run and for each SLOT_ROWS groups. Every group is packed alike at every input size.
Slots are numbered in sub-buckets of about SLOT_ROWS rows with offsets from their counts.

Cases: null text counts as empty (size 1, crc32 of nothing) and forms one group with empty texts; an empty table gives
no rows; null ids are kept; repeated rows share a group and get slots of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotile.llm.common import prepare

SHARDS = 16
SLOT_ROWS = 4096


def best_fit_runs(sizes: list[int], counts: list[int], shards: int | None = None, capacity: int | None = None) -> list[tuple[int, int, int, int]]:
    """(index of the size, first rank, rank after the last, bin). Sizes must come largest first, counts are items of each."""
    out: list[tuple[int, int, int, int]] = []
    if not sizes:
        return out
    done, open_bins, opened = [0] * len(sizes), shards or 0, 0
    if shards:
        left, i = sum(x * n for x, n in zip(sizes, counts)), 0
        while i < len(sizes) and open_bins > 1 and sizes[i] * open_bins > left:
            out.append((i, done[i], done[i] + 1, shards - open_bins))  # more than an equal part: a shard of its own
            left, open_bins, done[i] = left - sizes[i], open_bins - 1, done[i] + 1
            i += done[i] == counts[i]
        capacity = -(-left // open_bins)
    elif not capacity:
        raise ValueError("a number of shards or a capacity is needed")
    tree = [(capacity, shards - open_bins + i) for i in range(open_bins)] if shards else []
    for i, size in enumerate(sizes):
        while done[i] < counts[i]:
            k = bisect_left(tree, (size, -1))
            if k == len(tree):
                if shards:
                    k -= 1  # the emptiest
                else:
                    insort(tree, (max(capacity, size), opened))
                    opened += 1
                    k = bisect_left(tree, (size, -1))
            room, name = tree.pop(k)
            n = min(counts[i] - done[i], max(1, room // size))  # it stays the best fit while it holds one more
            insort(tree, (room - n * size, name))
            out.append((i, done[i], done[i] + n, name))
            done[i] += n
    return out


def best_fit_decreasing(sizes: list[int], shards: int | None = None, capacity: int | None = None) -> list[int]:
    """Bin of each size. Sizes must come largest first."""
    return [name for *_, name in sorted(best_fit_runs(sizes, [1] * len(sizes), shards, capacity))]


def _pack(classes: DataFrame, shards: int | None, capacity: int | None) -> DataFrame:
    """classes: (bytes, n), a row for each size; gives (bytes, first, after, shard)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bytes", ascending=False)
        sizes = pdf["bytes"].tolist()
        runs = best_fit_runs(sizes, pdf["n"].tolist(), shards, capacity)
        return pd.DataFrame([(sizes[i], a, b, name) for i, a, b, name in runs], columns=["bytes", "first", "after", "shard"])

    return classes.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "bytes long, first long, after long, shard int")


def assign(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, key, check, shard) for every row; equal texts share a shard. With a capacity in bytes,
    shards are opened as needed and ``shards`` does not count."""
    prepare(docs.sparkSession)
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("key"))
    rows = rows.withColumn("check", F.col("text_crc32") * (1 << 31) + F.col("size")).checkpoint(eager=True)  # no texts
    groups = rows.groupBy("key", "check").agg(F.sum("size").alias("bytes")).checkpoint(eager=True)
    classes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    runs = _pack(classes, None if capacity else shards, capacity).checkpoint(eager=True)
    subs = F.broadcast(classes.select("bytes", F.ceil(F.col("n") / SLOT_ROWS).alias("subs")))
    groups = groups.join(subs, "bytes").withColumn("sub", F.pmod("key", "subs")).drop("subs")
    before = Window.partitionBy("bytes").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    parts = groups.groupBy("bytes", "sub").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    pieces = parts.join(F.broadcast(runs), "bytes").where((F.col("first") < F.col("offset") + F.col("n")) & (F.col("after") > F.col("offset")))
    inside = F.row_number().over(Window.partitionBy("bytes", "sub").orderBy("key", "check")) - 1
    dealt = groups.withColumn("inside", inside).join(F.broadcast(pieces.drop("n")), ["bytes", "sub"]).withColumn("rank", F.col("offset") + F.col("inside"))
    dealt = dealt.where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after"))).select("key", "check", "shard")
    return rows.join(dealt, ["key", "check"]).select("doc_id", "size", "text_crc32", "key", "check", "shard")


def numbered(assigned: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Add slot: gapless from 0 within each shard."""
    rows = assigned.checkpoint(eager=True)
    n, shards = rows.count(), rows.agg(F.max("shard")).first()[0]
    subs = max(1, -(-n // (slot_rows * ((shards or 0) + 1))))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("doc_id", "key"), F.lit(subs)).cast("long"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "key", "check"))
    return rows.withColumn("inside", inside).join(offsets, ["shard", "sub"]).withColumn("slot", F.col("offset") + F.col("inside") - 1)


def shard(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """Every row with its shard and slot under the law `bytes`: sizes of the shards are near equal, or within a capacity."""
    return numbered(assign(docs, shards, capacity)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
