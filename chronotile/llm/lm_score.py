"""LM scoring: stupid-backoff scores from n-gram counts of the whole corpus, without each document's own share.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. For the word w after context c,
with counts over all other documents (a document's own n-grams are taken out, else nothing would ever back off):

    S(w | c) = count(c w) / count(c)      if count(c w) > 0
               BACKOFF * S(w | c shortened by its first word)   else

and S(w) = count(w) / words for a word that occurs elsewhere, BACKOFF / words if not (words: all of the corpus but the
document's own, at least 1). A document's score is the sum of log S over its words, each log as whole billionths, so that
the sum does not depend on its order, cut down to millionths.

Relational form. Documents are dealt to blocks by a hash of id and text. Each block lists its n-grams of all orders with
their counts: pre-aggregated, so even the most frequent n-gram has one entry per block. The lists are partitioned by the
n-gram's hash into count tables; only counts that differ from the block's own go back, where they are joined to the
n-grams of the block's documents and summed per document. An entry is a 64-bit hash and a count; the entries that one
block and one partition exchange travel as one packed row (sorted, as differences), which halves the shuffle. Nothing
that grows with the corpus is broadcast or collected but the total number of words.

Cases: null text counts as empty; a text without words has 0 words and score 0.0; repeated rows count as documents of
their own; null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotile.llm.common import byte_lengths, mix64, prepare, segment_sums, shuffle_partitions, utf8

ORDER = 2
BACKOFF = 0.4
BLOCK_BYTES = 16 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, offsets of the texts into the words)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _WORD[raw]
    new = np.zeros(n + 1, bool)
    new[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | new[1:n]
    at = np.flatnonzero(start)
    rank = np.cumsum(inside)  # letters up to and with each place
    begin = rank[at] - 1
    letters = np.ascontiguousarray(_LOWER[raw[inside]])
    ends = np.concatenate([begin, [len(letters)]]).astype(np.int64)
    enc = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    h = np.array([xxhash.xxh64_intdigest(w, 1) for w in enc.dictionary.to_pylist()], np.uint64)
    code = enc.indices.to_numpy(zero_copy_only=False)
    return (h[code] if len(h) else np.zeros(0, np.uint64)), np.searchsorted(at, offsets)


def grams(word: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order the hash of the n-gram that ends at each word; 0 where the text has too few words before."""
    place = np.arange(len(word)) - np.repeat(first[:-1], np.diff(first))
    out = [word]
    for n in range(2, order + 1):
        # the hash of an n-gram is that of its first n-1 words carried on by the last one
        shifted = np.concatenate([np.zeros(1, np.uint64), out[-1][:-1]])
        h = mix64(shifted * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(n))
        out.append(np.where(place >= n - 1, h, np.uint64(0)))
    return out


def _blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(shuffle_partitions(spark), -(-size // BLOCK_BYTES))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).select("block", "doc_id", "text"), n


def _by_block(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of one block in batches sorted by block, of at most about ``limit`` text bytes each."""
    for b in batches:
        block = b.column("block").to_numpy(zero_copy_only=False)
        size = np.cumsum(byte_lengths(b.column("text")))
        start = 0
        while start < b.num_rows:
            end = int(np.searchsorted(block, block[start], "right"))
            room = size[start] + limit
            end = max(start + 1, min(end, int(np.searchsorted(size, room, "right"))))
            yield int(block[start]), b.slice(start, end - start)
            start = end


def pack(h: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted distinct hashes and their counts: differences and counts by byte planes, compressed."""
    planes = [np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T, n.astype(np.uint32).view(np.uint8).reshape(-1, 4).T]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    m = len(raw) // 12
    h = np.ascontiguousarray(raw[:8 * m].reshape(8, m).T).view(np.uint64).ravel()
    return np.cumsum(h, dtype=np.uint64), np.ascontiguousarray(raw[8 * m:].reshape(4, m).T).view(np.uint32).ravel().astype(np.int64)


def _sum(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, their summed counts, index of each entry's hash)."""
    h, at = np.unique(h, return_inverse=True)
    return h, np.bincount(at, n, minlength=len(h)).astype(np.int64), at


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def block_counts(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, block, entries): n-grams of all orders counted per block, by range of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(block: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            h, n, _ = _sum(np.concatenate([x for x, _ in held]), np.concatenate([c for _, c in held]))
            at = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(at))
            blobs = [pack(h[at[k]:at[k + 1]], n[at[k]:at[k + 1]]) for k in used]
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), block, np.int32)), pa.array(blobs, pa.binary())],
                                              names=["bucket", "block", "entries"])

        now, held = None, []
        for block, b in _by_block(batches, 4 << 20):
            if block != now and held:
                yield flush(now, held)
                held = []
            now = block
            w, first = words(*utf8(b.column("text")))
            every = np.concatenate(grams(w, first, order)) if len(w) else np.zeros(0, np.uint64)
            held.append(np.unique(every[every != 0], return_counts=True))
        if held:
            yield flush(now, held)

    return blocks.mapInArrow(run, "bucket int, block int, entries binary")


def corpus_counts(counted: DataFrame) -> DataFrame:
    """(block, entries): for each block the corpus counts of its n-grams that other blocks have too."""

    def run(group: pa.Table) -> pa.Table:
        block = group.column("block").to_numpy()
        parts = [unpack(x) for x in group.column("entries").to_pylist()]
        size = np.array([len(h) for h, _ in parts])
        n = np.concatenate([c for _, c in parts])
        h, total, at = _sum(np.concatenate([x for x, _ in parts]), n)
        ends, out = np.cumsum(size), []
        for k, (e, m) in enumerate(zip(ends, size)):
            mine = at[e - m:e]
            shared = total[mine] != n[e - m:e]
            out.append((block[k], pack(h[mine[shared]], total[mine[shared]])))
        return pa.table({"block": pa.array([b for b, _ in out], pa.int32()), "entries": pa.array([x for _, x in out], pa.binary())})

    return counted.groupBy("bucket").applyInArrow(run, "block int, entries binary")


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """(doc_id, n_words, log_score, n_backoff) for every row; n_backoff counts words scored by a lower order."""
    if order < 1:
        raise ValueError("order must be at least 1")
    rows, n = _blocks(docs)
    dealt = rows.repartition(n, "block").sortWithinPartitions("block")
    back = corpus_counts(block_counts(dealt, order, n))
    size = F.regexp_count(F.col("text"), F.lit(r"[^\x00-/:-@\[-`{-\x7f]+"))
    all_words = int(rows.agg(F.sum(size.cast("long"))).first()[0] or 0)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in right.column("entries").to_pylist()]
        h = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.uint64)
        known = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
        by = np.argsort(h)
        h, known = h[by], known[by]
        w, first = words(*utf8(left.column("text")))
        orders = grams(w, first, order)
        own_h, own_at, own_n = np.unique(np.concatenate(orders), return_inverse=True, return_counts=True)
        k = np.minimum(np.searchsorted(h, own_h), max(len(h) - 1, 0))
        found = (h[k] == own_h) if len(h) else np.zeros(len(own_h), bool)
        corpus = np.where(found, known[k] if len(h) else 0, own_n)  # not sent back: this block has all of them
        corpus[own_h == 0] = 0
        sizes = np.diff(first)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        elsewhere = []
        for i in range(order):  # counts outside the document
            code = own_at[i * len(w):(i + 1) * len(w)].astype(np.int64)
            _, at, c = np.unique(doc * np.int64(len(own_h)) + code, return_inverse=True, return_counts=True)
            elsewhere.append(corpus[code] - np.where(orders[i] == 0, 0, c[at]))
        s = np.where(elsewhere[0] > 0, elsewhere[0], backoff) / np.maximum(all_words - sizes, 1)[doc]
        lower = np.zeros(len(w), bool)
        for i in range(1, order):
            seen, full = elsewhere[i] > 0, orders[i] != 0
            context = np.concatenate([np.ones(1, np.int64), elsewhere[i - 1][:-1]])[:len(w)]
            s = np.where(seen, elsewhere[i] / np.maximum(context, 1), np.where(full, backoff * s, s))
            lower = np.where(full, ~seen, lower)
        backs = np.concatenate([[0], np.cumsum(lower)])[first]
        logs = np.rint(np.log(s) * 1e9).astype(np.int64)
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(sizes.astype(np.int64)),
                         "log_score": pa.array(np.floor(segment_sums(logs, first) / 1000) / 1e6), "n_backoff": pa.array(np.diff(backs).astype(np.int64))})

    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(work, "doc_id long, n_words long, log_score double, n_backoff long")
