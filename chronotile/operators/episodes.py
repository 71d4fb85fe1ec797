"""Episodes (W1-W4, A10, T2): consecutive changes of one tile that overlap in time form one episode.

Order is (tile_col, tile_row, to_date, event_id); ``to_date`` is compared as text, as stored. A row continues the
previous row's episode iff both are on the same tile, its ``from_date`` parses and is <= the previous row's
parsed ``to_date`` (previous row only, not a running maximum). Episode ids are global, 1-based, in that order.

Scale: the plan never groups a whole tile or episode into one task. A narrow projection (id, tile, parsed dates)
is range-partitioned on the full order (a hot tile is split over several partitions because the order ends in the
event id) and checkpointed. A first Arrow pass returns one summary row per partition (size, starts after its first
row, first and last row); from these partition-count rows the driver derives each partition's offsets and whether
its first row starts an episode (it depends only on the previous partition's last row). A second pass numbers rows,
episodes and in-episode positions with those offsets. ``episode_count`` is a partial aggregate joined back on the id
(AQE splits a hot episode on the big side), and the episode columns are joined to the wide rows on event_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotile.operators.numbering import ordered_checkpoint

ORDER = ["tile_col", "tile_row", "to_date", "event_id"]


def parse_ts(col) -> F.Column:
    """Safe timestamp parse: bad or empty text -> null; offsets converted to UTC."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit(None).cast("timestamp")).otherwise(F.try_to_timestamp(c))


def _continues(pc, pr, pto, c, r, f) -> np.ndarray:
    """Row continues the previous row's episode (NaN dates never compare true)."""
    with np.errstate(invalid="ignore"):
        return (pc == c) & (pr == r) & (f <= pto)


def _frames(batches):
    """Partition batches as numpy arrays with the previous row carried across batch borders."""
    for pdf in batches:
        if pdf.empty:
            continue
        yield (pdf, pdf["tile_col"].to_numpy(np.int64), pdf["tile_row"].to_numpy(np.int64),
               pdf["_f"].to_numpy(np.float64), pdf["_t"].to_numpy(np.float64))


def _stats_pass(batches):
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    n, starts, last_start = 0, 0, None
    first = last = None
    for _pdf, c, r, f, t in _frames(batches):
        if first is None:
            first = (int(c[0]), int(r[0]), float(f[0]))
            pc, pr, pto = np.r_[-1, c[:-1]], np.r_[-1, r[:-1]], np.r_[np.nan, t[:-1]]
            start = ~_continues(pc, pr, pto, c, r, f)
            start[0] = False  # decided on the driver from the previous partition
        else:
            pc, pr, pto = np.r_[last[0], c[:-1]], np.r_[last[1], r[:-1]], np.r_[last[2], t[:-1]]
            start = ~_continues(pc, pr, pto, c, r, f)
        idx = np.nonzero(start)[0]
        if len(idx):
            last_start = n + int(idx[-1]) + 1
        starts += int(start.sum())
        n += len(c)
        last = (int(c[-1]), int(r[-1]), float(t[-1]))
    if n:
        yield pd.DataFrame({"pid": [pid], "n": [n], "starts": [starts],
                            "last_start": [last_start if last_start is not None else -1],
                            "fc": [first[0]], "fr": [first[1]], "ff": [first[2]],
                            "lc": [last[0]], "lr": [last[1]], "lt": [last[2]]})


def _offsets(stats: pd.DataFrame) -> dict:
    """Per partition: (row offset, first row starts?, episode offset, global position of the last start before)."""
    out, rn, ep, last_start, prev = {}, 0, 0, np.nan, None
    for s in stats.sort_values("pid").itertuples(index=False):
        first_starts = prev is None or not bool(_continues(prev[0], prev[1], prev[2], s.fc, s.fr, s.ff))
        out[int(s.pid)] = (rn, first_starts, ep, last_start)
        if first_starts:
            last_start = rn + 1
        if s.last_start > 0:
            last_start = rn + s.last_start
        ep += s.starts + int(first_starts)
        rn += s.n
        prev = (s.lc, s.lr, s.lt)
    return out


def _number_pass(offsets: dict):
    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        rn0, first_starts, ep, carry = offsets.get(pid, (0, True, 0, np.nan))
        pos, last = 0, None
        for pdf, c, r, f, t in _frames(batches):
            if last is None:
                pc, pr, pto = np.r_[-1, c[:-1]], np.r_[-1, r[:-1]], np.r_[np.nan, t[:-1]]
                start = ~_continues(pc, pr, pto, c, r, f)
                start[0] = first_starts
            else:
                pc, pr, pto = np.r_[last[0], c[:-1]], np.r_[last[1], r[:-1]], np.r_[last[2], t[:-1]]
                start = ~_continues(pc, pr, pto, c, r, f)
            rn = rn0 + pos + np.arange(1, len(c) + 1, dtype=np.int64)
            eid = ep + np.cumsum(start)
            srn = pd.Series(np.where(start, rn, np.nan)).ffill().fillna(carry).to_numpy()
            yield pd.DataFrame({"_row": pdf["_row"].to_numpy(), "episode_id": eid.astype(np.int64),
                                "episode_index": (rn - srn).astype(np.int64)})
            ep, carry, pos = int(eid[-1]), float(srn[-1]), pos + len(c)
            last = (int(c[-1]), int(r[-1]), float(t[-1]))

    return run


STATS_SCHEMA = T.StructType([
    T.StructField("pid", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("starts", T.LongType()),
    T.StructField("last_start", T.LongType()), T.StructField("fc", T.LongType()), T.StructField("fr", T.LongType()),
    T.StructField("ff", T.DoubleType()), T.StructField("lc", T.LongType()), T.StructField("lr", T.LongType()),
    T.StructField("lt", T.DoubleType()),
])


def episodes(changes: DataFrame, stored: bool = False) -> DataFrame:
    """Adds episode_id, episode_index, episode_count. ``stored``: the rows are a checkpoint, which is not written once more."""
    from chronotile.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(changes.sparkSession)
    base = changes.drop("episode_id", "episode_index", "episode_count")
    names = base.columns
    # event ids may repeat or be null, so rows are joined back by a key of their own, fixed by the checkpoint
    base = base.withColumn("_row", F.monotonically_increasing_id())
    if not stored:
        base = base.checkpoint(eager=True)
    narrow = base.select(
        "_row", "event_id", "tile_col", "tile_row", "to_date",
        F.unix_micros(parse_ts("from_date")).cast("double").alias("_f"),
        F.unix_micros(parse_ts("to_date")).cast("double").alias("_t"),
    )
    ranged = ordered_checkpoint(narrow, ORDER)
    # one row per non-empty partition: a proven bound for the driver
    stats = ranged.mapInPandas(_stats_pass, STATS_SCHEMA).toPandas()
    offsets = _offsets(stats)
    numbered = ranged.mapInPandas(_number_pass(offsets), "_row long, episode_id long, episode_index long")
    numbered = numbered.checkpoint(eager=True)  # reused by the count and the join back
    counts = numbered.groupBy("episode_id").agg(F.count(F.lit(1)).alias("episode_count"))
    ep = numbered.join(counts, "episode_id")
    return base.join(ep, "_row").select(*names, "episode_id", "episode_index", "episode_count")
