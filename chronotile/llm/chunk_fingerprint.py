"""Document fingerprints by content-defined chunking.

A rolling gear hash over the last WINDOW bytes proposes chunk ends; chunking is normalised: no chunk below MIN_SIZE, a
strict mask up to NORMAL_SIZE, a loose one beyond, an end at MAX_SIZE. Since ends depend on nearby bytes only, chunks far
from an edit stay as they are. A fingerprint is the set of (64-bit digest, length) of a text's chunks; likeness is the
length-weighted share of the first set that the second contains.

``compare_next`` needs each document beside its successor in id order. Documents are dealt to ranges of ids (bounds from
a quantile sketch, one number per partition), and each range also gets the first document of the next one, so one
shuffle of the texts suffices and no window runs over the table.

Cases: null text counts as empty; the fingerprint of an empty text is the empty string; two empty texts have likeness
1, an empty one and another 0; null ids come last; rows of one id are ordered by a hash of their text; the successor of
the last row is the first, so a single row follows itself.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotile.llm.common import mix64, prepare, shuffle_partitions, slices

WINDOW = 32
MIN_SIZE, NORMAL_SIZE, MAX_SIZE = 16, 64, 256
STRICT_BITS, LOOSE_BITS = 7, 4
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
LAST = (1 << 63) - 1


def _gear(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash at each byte, offset of each text); zeros between texts keep them apart."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size + WINDOW) - size - WINDOW
    raw = np.frombuffer((b"\0" * WINDOW).join(texts) + b"\0" * WINDOW, np.uint8)
    h = GEAR[raw]
    for s, n in zip(start, size):
        h[s + n:s + n + WINDOW] = 0
    step = 1
    while step < WINDOW:
        later = h[step:] + (h[:-step] << np.uint32(step))
        h = np.concatenate([h[:step], later])
        step *= 2
    return h, start


def chunk_sets(texts: list[bytes]) -> list[dict[int, int]]:
    """For each text its chunks as digest -> length."""
    if not texts:
        return []
    h, start = _gear(texts)
    top = h >> np.uint32(32 - STRICT_BITS)
    strict = np.flatnonzero(top == 0).tolist()
    loose = np.flatnonzero((h >> np.uint32(32 - LOOSE_BITS)) == 0).tolist()
    digest, out = xxhash.xxh3_64_intdigest, []
    for t, base in zip(texts, start.tolist()):
        found: dict[int, int] = {}
        at, end = base, base + len(t)
        while at < end:
            stop = min(at + MAX_SIZE, end)
            middle = min(at + NORMAL_SIZE, stop)
            k = bisect_left(strict, at + MIN_SIZE - 1)
            if k < len(strict) and strict[k] < middle:
                cut = strict[k] + 1
            else:
                k = bisect_left(loose, max(middle, at + MIN_SIZE - 1))
                cut = loose[k] + 1 if k < len(loose) and loose[k] < stop else stop
            cut = min(cut, end)
            found[digest(t[at - base:cut - base])] = cut - at
            at = cut
        out.append(found)
    return out


def written(chunks: dict[int, int]) -> str:
    return ",".join(f"{d:016x}:{n}" for d, n in sorted(chunks.items()))


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's length in chunks that b has too."""
    if not a:
        return 1.0 if not b else 0.0
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(k: Column, bounds: list[int], run: int = 64) -> Column:
    """How many bounds are below k, by two short scans."""
    if not bounds:
        return F.lit(0)
    every = F.array(*[F.lit(b).cast("long") for b in bounds])
    coarse = F.array(*[F.lit(b).cast("long") for b in bounds[run - 1::run]]).cast("array<long>")
    c = F.size(F.filter(coarse, lambda b: b < k))
    return c * run + F.size(F.filter(F.slice(every, c * run + 1, run), lambda b: b < k))


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def with_successor(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(part, follow, k, h, doc_id, text), sorted by id within each part; the row with follow = 1 is the successor of the
    part's last row and belongs to another part."""
    spark = prepare(docs.sparkSession)
    n = partitions or shuffle_partitions(spark)
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    shares = [i / n for i in range(1, n)]
    ids = docs.select(k.alias("k"))
    bounds = sorted(set(ids.agg(F.percentile_approx("k", shares, 10 * n).alias("q")).first()["q"] or [])) if shares else []
    heads = ids.groupBy(_range_of(F.col("k"), bounds).alias("part")).agg(F.min("k").alias("k")).collect()  # a row per part
    heads = sorted((r["part"], r["k"]) for r in heads)
    rows = docs.select(
        _range_of(k, bounds).alias("part"), F.lit(0).alias("follow"), k.alias("k"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if heads:
        before = {heads[i][1]: heads[i - 1][0] for i in range(len(heads))}
        to = spark.createDataFrame([(key, part) for key, part in before.items()], "head long, to int")
        firsts = rows.where(F.col("k").isin(list(before))).join(F.broadcast(to), F.col("k") == F.col("head"))  # a row per part
        firsts = firsts.groupBy("to").agg(F.min(F.struct("h", "k", "doc_id", "text")).alias("f"))
        rows = rows.unionByName(firsts.select(F.col("to").alias("part"), F.lit(1).alias("follow"), "f.*"))
    return rows.repartitionById(n, "part").sortWithinPartitions("part", "follow", "k", "h")


def compare_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness (see SCHEMA)."""
    ordered = with_successor(docs, partitions).select("follow", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, str, dict] | None = None
        for b in slices(batches, "text"):
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            sets = chunk_sets([t.encode() for t in texts])
            rows = ([held] if held else []) + list(zip(ids, texts, sets))
            held = rows[-1]  # waits for its successor; at the end it is the row that only follows
            if len(rows) == 1:
                continue
            new = [edited(a[1], c[1]).encode() for a, c in zip(rows, rows[1:])]
            again = chunk_sets(new)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows[:-1]], pa.int64()), pa.array([len(r[1]) for r in rows[:-1]], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in new]),
                pa.array([written(r[2]) for r in rows[:-1]]), pa.array([written(s) for s in again]),
                pa.array([likeness(r[2], s) for r, s in zip(rows, again)]),
                pa.array([likeness(r[2], c[2]) for r, c in zip(rows, rows[1:])]),
            ], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return ordered.mapInArrow(run, SCHEMA)
