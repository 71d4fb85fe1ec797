"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams (ORDERS code points, lower-cased) present in a text. On the training rows
each gets the log ratio r of its smoothed shares in toxic and other texts; n-grams whose ratio is below R_MIN or within
Z_MIN standard errors of none are left out. A logistic regression with an L2 penalty is fitted on the features scaled by r, with both
classes of equal weight. Scoring reads whole texts: every position of every text is hashed.

The fit is bounded: at most about SAMPLE labelled rows, chosen by a hash of the id (all of them when there are fewer).
Their n-gram counts are summed in PARTS ranges; only the chosen n-grams of each row meet in the one task that fits. The
model is a table of 2 ** BITS numbers and a bias.

Cases: null text counts as empty; an empty text gets the score of no features; without training rows of both classes
the score is the smoothed share of toxic rows, held below THRESHOLD; a labelled id that occurs more than once is toxic
if any of its labels is; rows whose label is null do not train; repeated rows are scored alike; null ids are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotile.llm.common import fresh, prepare, slices

ORDERS = (3, 4, 5)
BITS = 20
PARTS = 64  # the n-gram counts are summed in as many ranges of buckets
SAMPLE = 16_384
THRESHOLD = 0.7
Z_MIN, R_MIN = 3.0, 1.0  # standard errors and log ratio that an n-gram must reach
L2, ROUNDS = 1.0, 200
_M, _K = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each between spaces, and the offsets of the texts."""
    low = [" " + t.lower() + " " if t else "" for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), off


def buckets(code: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(order, bucket of the n-gram that starts at each place)."""
    h = np.zeros(len(code), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(code) < n:
            return
        h = h[: len(code) - n + 1] * _M + code[n - 1:] + np.uint32(1)
        if n in ORDERS:
            yield n, ((h ^ np.uint32(n)) * _K) >> np.uint32(32 - BITS)


def present(texts: list[str | None], useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, sorted; useful: a mask of the buckets that matter."""
    code, off = codes(texts)
    found = []
    for n, b in buckets(code):
        place = np.arange(len(b)) if useful is None else np.flatnonzero(useful[b])
        doc = np.searchsorted(off, place, "right") - 1
        whole = place + n <= off[doc + 1]
        found.append((doc[whole].astype(np.int64) << BITS) | b[place[whole]])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def log_ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log ratio of the smoothed shares of texts with each n-gram; 0 where it is below R_MIN or Z_MIN errors."""
    p, q = pos + 0.5, neg + 0.5
    r = np.log(p / (n_pos + 1.0)) - np.log(q / (n_neg + 1.0))
    return np.where(np.abs(r) >= np.maximum(R_MIN, Z_MIN * np.sqrt(1 / p + 1 / q)), r, 0.0)


def fit(labels: np.ndarray, feats: list[np.ndarray], used: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """(weight of each used bucket, bias). feats: positions in ``used`` that each training row has."""
    y = labels.astype(bool)
    n1, n0 = int(y.sum()), int((~y).sum())
    if not n1 or not n0:
        p = min((n1 + 0.5) / (n1 + n0 + 1.0), 0.5)
        return np.zeros(len(used), np.float32), float(np.log(p / (1 - p)))
    at = np.concatenate(feats)
    doc = np.repeat(np.arange(len(feats), dtype=np.int32), [len(f) for f in feats])
    x, m, k = scale[at], len(y), max(1, len(used))
    cost = np.where(y, 0.5 / n1, 0.5 / n0)
    w, b = np.zeros(len(used)), 0.0
    g2w, g2b = np.full(len(used), 1e-12), 1e-12  # adaptive steps
    for _ in range(ROUNDS):
        z = np.bincount(doc, x * w[at], minlength=m) + b
        err = cost * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        gw = np.bincount(at, x * err[doc], minlength=len(used)) + L2 / k * w
        gb = err.sum()
        g2w, g2b = g2w + gw * gw, g2b + gb * gb
        w, b = w - 0.3 * gw / np.sqrt(g2w), b - 0.3 * gb / np.sqrt(g2b)
    return (w * scale).astype(np.float32), float(b)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> dict:
    """Fit on the labelled rows of ``docs``. ``usable``: a condition on doc_id that labels must meet to train."""
    spark = prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.where(usable) if usable is not None else known
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(place < share) if share < 1 else known
    # bounded by `sample` (16 bytes a row), so that the texts need no shuffle
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(picked), "doc_id")

    by_label = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    n_pos, n_neg = by_label.get(1, 0), by_label.get(0, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for b in slices(batches, "text", 256 << 10):  # small slices sort in cache
            doc, col = present(b.column("text").to_pylist())
            toxic = b.column("toxic").to_numpy()[doc] > 0
            for k in (0, 1):
                seen[k] += np.bincount(col[toxic == bool(k)], minlength=1 << BITS).astype(np.int32)
        cut = seen.reshape(2, PARTS, -1)
        blobs = [zstandard.compress(cut[:, k].tobytes(), 1) for k in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(blobs, pa.binary())], names=["part", "seen"])

    def choose(group: pa.Table) -> pa.Table:
        part, total = group.column("part")[0].as_py(), 0
        for blob in group.column("seen"):
            total = total + np.frombuffer(zstandard.decompress(blob.as_py()), np.int32).reshape(2, -1).astype(np.int64)
        r = log_ratios(total[1], total[0], n_pos, n_neg)
        at = np.flatnonzero(r)
        return pa.table({"bucket": pa.array((at + part * len(r)).astype(np.int32)), "ratio": pa.array(r[at])})

    chosen = rows.mapInArrow(count, "part int, seen binary").groupBy("part").applyInArrow(choose, "bucket int, ratio double")
    got = sorted((r["bucket"], r["ratio"]) for r in chosen.collect())  # at most 2 ** BITS rows
    used, scale = np.array([x for x, _ in got], np.int64), np.array([x for _, x in got], np.float64)
    shared = spark.sparkContext.broadcast((used, scale))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(1 << BITS, bool)
        mask[shared.value[0]] = True
        for b in slices(batches, "text"):
            doc, col = present(b.column("text").to_pylist(), mask)
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            col = np.searchsorted(shared.value[0], col).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(b.num_rows, np.int32)), b.column("doc_id"), b.column("toxic"),
                 pa.array([col[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], names=["one", "doc_id", "toxic", "feats"])

    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("feats", "ascending")])
        feats = [np.frombuffer(x, np.int32) for x in group.column("feats").to_pylist()]
        weight, bias = fit(group.column("toxic").to_numpy(), feats, *shared.value)
        return pa.table({"bias": [bias], "weight": [weight.tobytes()]}, schema=pa.schema([("bias", pa.float64()), ("weight", pa.binary())]))

    cut = rows.mapInArrow(features, "one int, doc_id long, toxic int, feats binary")
    solved = cut.groupBy("one").applyInArrow(solve, "bias double, weight binary").collect()  # one row
    weight = np.zeros(1 << BITS, np.float32)
    if not solved:
        return {"weight": weight, "bias": -2.0}
    weight[used] = np.frombuffer(solved[0]["weight"], np.float32)
    return {"weight": weight, "bias": float(solved[0]["bias"])}


def scores(texts: list[str | None], weight: np.ndarray, bias: float) -> np.ndarray:
    doc, col = present(texts, weight != 0)
    z = np.bincount(doc, weight[col].astype(np.float64), minlength=len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of every whole text; all columns are kept and only the text is read."""
    spark = prepare(docs.sparkSession)
    shared, names = spark.sparkContext.broadcast((model["weight"], model["bias"])), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for b in slices(batches, text):
            s = scores(b.column(text).to_pylist(), weight, bias)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(s)], names=[*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType(), False)]))


def keep_clean(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows scored below the threshold, with their columns as they were."""
    out = fresh(docs, "toxicity_score")
    return score(docs, model, out=out).where(F.col(out) < threshold).drop(out)
