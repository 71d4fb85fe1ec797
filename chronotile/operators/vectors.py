"""Vector table and exact nearest-neighbour search.

Distances are squared L2 in double precision; ties are broken by event id. Search for one event broadcasts a single
query vector (a literal of dim floats) and keeps a top-k: no sort of the table. The batch form runs exact k-NN for every
event of the table without emitting all event pairs: identical vectors are collapsed first (events that share an
image share a vector), distinct vectors are parted by pivots, and blocks are compared only where the triangle inequality
leaves a chance; each vector contributes at most its k smallest event ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotile.functions.images import basename
from chronotile.functions.vectors import sq_l2_fast

# Metadata columns stored next to each vector.
METADATA_COLUMNS = ["tile_col", "tile_row", "centroid_lon", "centroid_lat", "from_date", "to_date", "change_type_tr",
                    "change_type_en", "importance", "episode_id", "has_mask"]


def vector_table(changes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """event_id, vector (the after image's embedding), metadata. Rows without a vector are skipped (inner join).
    ``has_mask`` is computed from ``geometry_mask``."""
    c = changes
    if "has_mask" not in c.columns:
        c = c.withColumn("has_mask", (F.col("geometry_mask") != "") if "geometry_mask" in c.columns else F.lit(None).cast("boolean"))
    meta = [F.col(m) if m in c.columns else F.lit(None).alias(m) for m in METADATA_COLUMNS]
    c = c.select("event_id", F.when(F.col("after_image") != "", basename("after_image")).alias("image"), *meta)
    emb = embeddings.select("image", F.col("embedding").alias("vector"))
    return c.join(emb, "image", "inner").select("event_id", "vector", *METADATA_COLUMNS)


def similar_changes(vectors: DataFrame, event_id: int, k: int, exclude_self_first: bool = False) -> DataFrame:
    """Nearest events to one event: top-k with the event itself included, then itself dropped (normally k-1 rows);
    ``exclude_self_first=True`` drops it before the limit and returns k rows. Unknown id -> empty.
    Output: rank, event_id, distance."""
    # a point lookup: one vector of ``dim`` floats is a proven bound, so it travels as a literal
    row = vectors.where(F.col("event_id") == F.lit(event_id)).select("vector").limit(1).collect()
    if not row or row[0]["vector"] is None:
        return vectors.sparkSession.createDataFrame([], "rank int, event_id long, distance double")
    d = vectors.select("event_id", sq_l2_fast(F.col("vector"), list(row[0]["vector"])).alias("distance")).where(
        F.col("distance").isNotNull())
    if exclude_self_first:
        d = d.where(F.col("event_id") != F.lit(event_id))
    top = d.orderBy("distance", "event_id").limit(k)
    w = Window.orderBy("distance", "event_id")  # at most k rows
    return top.where(F.col("event_id") != F.lit(event_id)).withColumn("rank", F.row_number().over(w)).select(
        "rank", "event_id", "distance")


def similar_features(hits: DataFrame, changes: DataFrame) -> DataFrame:
    """Resolve hits to change rows in one join, keeping the rank order; hits without a row are dropped."""
    return hits.join(changes, "event_id", "inner").orderBy("rank")


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, from explicit differences summed over the dimension in index order."""
    d = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        diff = a[:, j][:, None] - b[:, j][None, :]
        d += diff * diff
    return d


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


#: Names in the result of a search between two blocks; q is the query's vector, c the candidate's.
FOUND = "qvid long, qvid2 long, cvid long, cvid2 long, distance double"

#: Blocks in a strip, the unit that the search sends to a task: with more, vectors are sent less often and a task holds more of them.
STRIP = 8


class Pivots:
    """At most ``most`` vectors (those of smallest hash) that part the distinct vectors into cells by nearest pivot, each with
    its radii. Bounded by ``most``, not by the table."""

    def __init__(self, distinct: DataFrame, n: int, block: int, most: int):
        rows = distinct.orderBy("vid", "vid2").limit(min(most, max(1, -(-n // block)))).select("vec").collect()
        self.vectors = np.array([r["vec"] for r in rows], dtype=np.float64)

    def assign(self, distinct: DataFrame, block: int) -> DataFrame:
        """Add cell, sub and strip: cells of more than ``block`` vectors are split by hash into blocks, and blocks in a row of about
        ``STRIP`` times ``block`` vectors are a strip."""
        held = distinct.sparkSession.sparkContext.broadcast(self.vectors)

        def run(batches):
            for pdf in _slices(batches):
                d = _squared(_matrix(pdf["vec"]), held.value)
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), radius=np.sqrt(d[np.arange(len(d)), cell]))

        fields = T.StructType([*distinct.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())])
        rows = distinct.mapInPandas(run, fields).checkpoint(eager=True)
        cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("lo"), F.max("radius").alias("hi")).collect()
        self.cells = sorted((r["cell"], r["n"], r["lo"], r["hi"], -(-r["n"] // block)) for r in cells)
        self.subs = F.create_map(*[F.lit(x) for c, *_, s in self.cells for x in (c, s)])
        before = np.cumsum([0, *[n for _, n, *_ in self.cells]])
        self._start = F.create_map(*[F.lit(x) for (c, *_), b in zip(self.cells, before) for x in (c, int(b))])
        self._size = F.create_map(*[F.lit(x) for c, n, _, _, s in self.cells for x in (c, n // s)])
        self._strip = STRIP * block
        rows = rows.withColumn("sub", F.pmod("vid2", F.element_at(self.subs, F.col("cell"))).cast("int"))
        return rows.withColumn("strip", self.strip("cell", "sub"))

    def strip(self, cell: str, sub: str):
        cell = F.col(cell)
        return F.floor((F.element_at(self._start, cell) + F.col(sub) * F.element_at(self._size, cell)) / self._strip).cast("int")

    def held(self) -> tuple[np.ndarray, dict[int, tuple[float, float]]]:
        return self.vectors, {c: (lo, hi) for c, _, lo, hi, _ in self.cells}

    def openings(self, rows: DataFrame) -> DataFrame:
        """For each block (cell, sub) of queries the cells that some of them must look into (opened) and how many of them (n, in
        parts): the cells that can hold a vector nearer than a query's bound ``tau`` (squared). The query's cell is always one."""
        held = rows.sparkSession.sparkContext.broadcast(self.held())

        def run(batches):
            pivots, radii = held.value
            names = np.array(list(radii), dtype=np.int32)
            lo, hi = np.array(list(radii.values())).T
            for pdf in _slices(batches):
                d = np.sqrt(_squared(_matrix(pdf["vec"]), pivots[names]))
                open_ = _may_hold(d, lo, hi, pdf["tau"].to_numpy()[:, None])
                for (cell, sub), at in pdf.groupby(["cell", "sub"]).indices.items():
                    n = open_[at].sum(axis=0)
                    yield pd.DataFrame({"cell": np.int32(cell), "sub": np.int32(sub), "opened": names[n > 0], "n": n[n > 0].astype("int64")})

        return rows.select("vec", "tau", "cell", "sub").mapInPandas(run, "cell int, sub int, opened int, n long")


def _slices(batches, most: int = 1024):
    """Batches in pieces of at most ``most`` rows: what is computed for a piece meets every pivot."""
    for pdf in batches:
        for i in range(0, len(pdf), most):
            yield pdf.iloc[i:i + most]


def _may_hold(d, lo, hi, tau):
    """A cell's member lies at least |distance to the pivot - its own radius| away; rounding opens a cell too many, never too few."""
    least = np.maximum(0.0, np.maximum(d - hi, lo - d))
    return least * (1 - 1e-9) - 1e-9 <= np.sqrt(tau)


def _bounds_fn(k: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(pdf["vec"])
        d = _squared(m, m)
        tau = np.partition(d, k - 1, axis=1)[:, k - 1] if len(m) >= k else np.full(len(m), np.inf)
        return pdf.assign(tau=tau)

    return fn


def _within(q: np.ndarray, c: np.ndarray, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of c, squared distance) of the pairs at most ``worst`` apart, of which the k nearest of a query and all that are
    as near are never lost. A matrix product with room for its rounding picks the pairs, ``_squared``'s sums decide them."""
    qn, cn = (q * q).sum(axis=1), (c * c).sum(axis=1)
    if not (np.isfinite(qn).all() and np.isfinite(cn).all()):
        d = _squared(q, c)
        qi, ci = np.nonzero(d <= worst[:, None])
        return qi, ci, d[qi, ci]
    near = q @ c.T
    near *= -2.0
    near += qn[:, None]
    near += cn[None, :]
    room = 1e-9 * (qn + cn.max())
    most = worst + room
    many = np.flatnonzero((near <= most[:, None]).sum(axis=1) > 4 * k)
    if len(many) and len(c) > k:
        most[many] = np.minimum(most[many], np.partition(near[many], k - 1, axis=1)[:, k - 1] + 2 * room[many])
    qi, ci = np.nonzero(near <= most[:, None])
    d = np.zeros(len(qi))
    for j in range(q.shape[1]):
        diff = q[qi, j] - c[ci, j]
        d += diff * diff
    keep = d <= worst[qi]
    return qi[keep], ci[keep], d[keep]


def _k_least(best: np.ndarray, row: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The k least values of each row of ``best`` and of the values ``d`` that belong to it."""
    k = best.shape[1]
    order = np.lexsort((d, row))
    row, d = row[order], d[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    more = np.full(best.shape, np.inf)
    first = place < k
    more[row[first], place[first]] = d[first]
    return np.partition(np.concatenate([best, more], axis=1), k - 1, axis=1)[:, :k]


def _search_fn(k: int, held):
    """Nearest vectors of a strip of queries in a strip of candidates, block by block; a query's bound sinks as it goes."""

    def fn(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(q) and len(c):
            pivots, radii = held.value
            qv, cv, tau = _matrix(q["vec"]), _matrix(c["vec"]), q["tau"].to_numpy()
            blocks = c.groupby(["cell", "sub"]).indices.items()
            for mine in q.groupby(["cell", "sub"]).indices.values():
                worst, best, hits = tau[mine].copy(), np.full((len(mine), k), np.inf), []
                for (cell, _), theirs in blocks:
                    d = np.sqrt(_squared(qv[mine], pivots[cell:cell + 1]))[:, 0]
                    look = np.flatnonzero(_may_hold(d, *radii[cell], worst))
                    if not len(look):
                        continue
                    qi, ci, d = _within(qv[mine[look]], cv[theirs], worst[look], k)
                    best = _k_least(best, look[qi], d)
                    worst = np.minimum(worst, best.max(axis=1))
                    hits.append((look[qi], theirs[ci], d))
                for qi, ci, d in hits:
                    keep = d <= worst[qi]  # ties at the bound stay: the merge decides them by event id
                    out.append((mine[qi[keep]], ci[keep], d[keep]))
        qi, ci, d = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"qvid": q["vid"].to_numpy("int64")[qi], "qvid2": q["vid2"].to_numpy("int64")[qi], "cvid": c["vid"].to_numpy("int64")[ci],
                             "cvid2": c["vid2"].to_numpy("int64")[ci], "distance": d})

    return fn


def _distinct(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members (event_id, vid, vid2, vector), distinct vectors (vid, vid2, vec)); two independent 64-bit hashes are the key
    (a collision among 10^9 distinct vectors has probability ~10^-21)."""
    key = [F.xxhash64(F.col("vector")).alias("vid"), F.xxhash64(F.lit("chronotile"), F.col("vector")).alias("vid2")]
    members = vectors.where(F.col("vector").isNotNull()).select("event_id", "vector", *key).checkpoint(eager=True)
    return members, members.groupBy("vid", "vid2").agg(F.first("vector").alias("vec")).checkpoint(eager=True)


def _opened(distinct: DataFrame, k: int, block: int, most: int) -> tuple[DataFrame, DataFrame, Pivots]:
    """(vectors with cell, sub, strip and bound, cells opened by each block, pivots): the first round bounds every vector's
    k-th distance inside its own block, the second opens the cells that can improve it."""
    pivots = Pivots(distinct, distinct.count(), block, most)
    placed = pivots.assign(distinct, block)
    bounded = placed.groupBy("cell", "sub").applyInPandas(_bounds_fn(k), T.StructType([*placed.schema.fields, T.StructField("tau", T.DoubleType())]))
    bounded = bounded.checkpoint(eager=True)
    return bounded, pivots.openings(bounded).checkpoint(eager=True), pivots


def similar_batch(vectors: DataFrame, k: int, block: int = 2048, pivots: int = 4096) -> DataFrame:
    """Exact k-NN for every event: query_event_id, rank, event_id, distance (self excluded after the top-k,
    as in ``similar_changes``). Rows without a vector take no part.

    Distinct vectors are parted by nearest pivot. Two rounds: each block (part of a cell, about ``block`` vectors) gives its
    members an upper bound of their k-th distance; then a query meets the blocks of a cell only if that cell's lower
    bound beats its upper one. A task holds two strips of blocks and computes two blocks at a time; no event pair list is built.
    Vectors without structure open all cells, which compares all blocks."""
    members, distinct = _distinct(vectors)
    schema = "query_event_id long, rank int, event_id long, distance double"
    if distinct.isEmpty():
        return vectors.sparkSession.createDataFrame([], schema)
    placed, opened, piv = _opened(distinct, k, block, pivots)
    looks = opened.select(piv.strip("cell", "sub").alias("qstrip"), "opened").distinct()
    looks = looks.withColumn("sub", F.explode(F.sequence(F.lit(0), F.element_at(piv.subs, F.col("opened")) - 1)))
    meetings = looks.select("qstrip", piv.strip("opened", "sub").alias("cstrip")).distinct().checkpoint(eager=True)
    # the work of two strips is the product of their rows, so their number, not their bytes, says how many tasks there are
    n, keys = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))), ["qstrip", "cstrip"]
    cols = ["vid", "vid2", "vec", "cell", "sub"]
    qside = placed.select(*cols, "tau", F.col("strip").alias("qstrip")).join(meetings, "qstrip").repartition(n, *keys)
    others = [F.col(c).alias(c) for c in meetings.columns]
    cside = placed.select(*[F.col(c).alias(c) for c in cols], F.col("strip").alias("cstrip")).join(meetings.select(*others), "cstrip").repartition(n, *keys)
    search = _search_fn(k, vectors.sparkSession.sparkContext.broadcast(piv.held()))
    cand = qside.groupBy(*keys).cogroup(cside.groupBy(*keys)).applyInPandas(lambda q, c: search(q, c), FOUND)
    # every vector has an event, so a query's k nearest vectors, and those as near as the last, hold its k nearest events
    wv = Window.partitionBy("qvid", "qvid2").orderBy("distance")
    cand = cand.withColumn("r", F.rank().over(wv)).where(F.col("r") <= k).drop("r")
    # each distinct vector contributes at most its k smallest event ids (a bounded top-k per group)
    wm = Window.partitionBy("vid", "vid2").orderBy("event_id")
    firsts = members.select("vid", "vid2", "event_id").withColumn("r", F.row_number().over(wm)).where(F.col("r") <= k)
    expanded = cand.join(firsts.select(F.col("vid").alias("cvid"), F.col("vid2").alias("cvid2"), "event_id"), ["cvid", "cvid2"])
    wq = Window.partitionBy("qvid", "qvid2").orderBy("distance", "event_id")
    topq = expanded.withColumn("r", F.row_number().over(wq)).where(F.col("r") <= k).select(
        "qvid", "qvid2", "r", "event_id", "distance")
    # attach to every query event (AQE splits a vector shared by many events), drop self, renumber
    queries = members.select(F.col("event_id").alias("query_event_id"), F.col("vid").alias("qvid"), F.col("vid2").alias("qvid2"))
    j = queries.join(topq, ["qvid", "qvid2"]).where(F.col("event_id") != F.col("query_event_id"))
    wr = Window.partitionBy("query_event_id").orderBy("r")
    return j.withColumn("rank", F.row_number().over(wr)).select("query_event_id", "rank", "event_id", "distance")


def compared_share(vectors: DataFrame, k: int, block: int = 2048, pivots: int = 4096) -> DataFrame:
    """What ``similar_batch`` compares: distinct vectors, pairs compared in both rounds, share of all pairs (one row)."""
    _, distinct = _distinct(vectors)
    placed, opened, piv = _opened(distinct, k, block, pivots)
    size = F.create_map(*[F.lit(x) for c, n, *_ in piv.cells for x in (c, n)])
    first = placed.groupBy("cell", "sub").agg(F.count(F.lit(1)).alias("n")).select(F.sum(F.col("n") * F.col("n"))).scalar()
    every = placed.select(F.count(F.lit(1))).scalar()
    pairs = opened.agg(F.sum(F.col("n") * F.element_at(size, F.col("opened"))).alias("n")).select((F.col("n") + first).alias("pairs"))
    return pairs.select(every.alias("vectors"), "pairs", (F.col("pairs") / (every * every)).alias("share"))
