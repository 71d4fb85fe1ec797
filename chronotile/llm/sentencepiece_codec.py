"""SentencePiece encoding and decoding: forward filtering, backward sampling over the piece lattice.

Each text gets one segmentation drawn from all segmentations into pieces of a fixed public vocabulary, with chance
in proportion to the product of its piece weights. The forward pass (once per distinct word of a slice) gives, for
every end position, the chance of each last piece; the backward pass draws pieces from the end of every occurrence.
All draws are hashes of (seed, row key, word number, position), so a rerun, a retried task or another partitioning
gives the same pieces. Decoding joins the pieces; it is lossless for every text (see lattice.py).

The vocabulary ships no probabilities that fit a lattice (its scores are merge ranks), so a piece of rank r weighs
(r + RANK_OFFSET) ** -alpha; a byte piece weighs BYTE_WEIGHT ** alpha.

Cases: null text -> null pieces, decoded as null; empty text -> no pieces, decoded as empty; null key -> the draws of
one shared key; equal rows -> equal pieces; other columns are kept. Texts are never cut short.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotile.llm.common import fresh, mix64, others, prepare, segment_sums, slices, unit_interval, utf8
from chronotile.llm.lattice import (
    LONG_UNIT, Vocabulary, arc_shares, arc_weights, cut_units, forward, load_pieces, sparse_forward, spelled_bytes, utf8_width,
)

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, ALPHA = 7, 1.0
RANK_OFFSET, BYTE_WEIGHT = 10.0, 1e-7
STEP = np.uint64(0x8CB92BA72F3D8DD7)
CODEC_BYTES = 3 << 20  # text bytes of a slice: more of them share one lattice per distinct word
_HELD: dict = {}


def held(shared) -> Vocabulary:
    """The vocabulary of a broadcast, built once per Python worker."""
    if shared.id not in _HELD:
        _HELD.clear()
        _HELD[shared.id] = Vocabulary(shared.value)
    return _HELD[shared.id]


class Shared:
    """A broadcast with an id that survives pickling."""

    def __init__(self, spark, value, name: str):
        self.id, self._b = name, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._b.value


def share_vocabulary(spark, model: str) -> Shared:
    return Shared(spark, load_pieces(model), model)


@lru_cache(maxsize=4)
def _rank_weights(size: int, first: int, alpha: float) -> np.ndarray:
    w = np.full(size, BYTE_WEIGHT)
    w[first:] = 1.0 / (np.arange(size - first) + RANK_OFFSET)
    return w ** alpha


def rank_weights(vocab: Vocabulary, alpha: float) -> np.ndarray:
    return _rank_weights(vocab.spec["size"], min(vocab.spec["ids"]), alpha)


def sample_slice(vocab: Vocabulary, raw: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int, alpha: float):
    """Pieces of the texts of one slice: (ids, offsets of the texts into ids, log chance of each segmentation)."""
    u = cut_units(raw, offsets)
    weight = rank_weights(vocab, alpha)
    log_weight = np.concatenate([np.log(weight), [0.0, 0.0]])
    n_occ, n_docs = len(u.code), len(offsets) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(u.first))
    key = mix64(keys.astype(np.int64).view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    occ_key = key[doc] + (np.arange(n_occ) - u.first[doc]).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    order = np.argsort(u.code, kind="stable")
    at = np.searchsorted(u.code[order], np.arange(len(u.lengths) + 1))
    count = np.zeros(n_occ, np.int64)
    occ_log = np.zeros(n_occ)
    steps: list[tuple[np.ndarray, ...]] = []

    def record(occ, ids, chars):
        width = np.ones(len(ids), np.int64)
        spelled = np.flatnonzero(ids < 0)
        width[spelled] = utf8_width(chars[spelled])
        steps.append((occ, ids, chars, count[occ], width))
        count[occ] += width

    for g in vocab.groups(u.chars, u.lengths):
        w = arc_weights(vocab, g, weight)
        log_total, logs = forward(g, w)
        # whole numbers, so that a draw does not depend on the words it shares a slice with
        upto = np.cumsum(np.rint(arc_shares(g, w, logs) * (1 << 31)).astype(np.int64))
        before = np.concatenate([[0], upto])[g.first[:-1]]  # by node
        log_w = np.log(w)
        times = at[g.rows + 1] - at[g.rows]
        row = np.repeat(np.arange(len(g.rows)), times)
        occ = order[np.repeat(at[g.rows] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(len(row))]
        occ_log[occ] -= log_total[row]
        node = row * (g.length + 1) + g.length
        while len(occ):
            draw = (mix64(occ_key[occ] + (node % (g.length + 1)).astype(np.uint64) * STEP) >> np.uint64(33)).astype(np.int64)
            arc, last = g.first[node], g.first[node + 1] - 1
            want = before[node] + (draw * (upto[last] - before[node]) >> 31)
            open_ = np.flatnonzero((upto[arc] <= want) & (arc < last))
            while len(open_):  # arcs of a node, longest piece first
                arc[open_] += 1
                open_ = open_[(upto[arc[open_]] <= want[open_]) & (arc[open_] < last[open_])]
            occ_log[occ] += log_w[arc]
            start = g.start[arc]
            record(occ, g.piece[arc], g.chars[g.row[arc], start])
            more = start > 0
            occ, node = occ[more], node[more] - g.size[arc[more]]
    for r in np.flatnonzero(u.lengths > LONG_UNIT):
        a = u.lengths[:r].sum()
        cp = u.chars[a:a + u.lengths[r]]
        log_total, into, alpha_log = sparse_forward(vocab, cp, log_weight)
        for o in order[at[r]:at[r + 1]]:
            end, one = len(cp), np.array([o])
            occ_log[o] -= log_total
            while end:
                part = np.cumsum([np.exp(alpha_log[j] + lw - alpha_log[end]) for j, _, lw in into[end]])
                draw = unit_interval(mix64(occ_key[one] + np.uint64((end * int(STEP)) & 0xFFFFFFFFFFFFFFFF)))[0]
                k = min(int(np.searchsorted(part, draw * part[-1], "right")), len(part) - 1)
                j, i, lw = into[end][k]
                occ_log[o] += lw
                record(one, np.array([i]), cp[j:j + 1])
                end = j
    off = np.concatenate([[0], np.cumsum(count)])
    ids = np.zeros(int(off[-1]), np.int32)
    for occ, piece, chars, back, width in steps:
        to = off[occ] + count[occ] - back - width
        whole = piece >= 0
        ids[to[whole]] = piece[whole]
        if not whole.all():
            b = spelled_bytes(chars[~whole])
            for k in range(4):
                has = b[:, k] >= 0
                ids[to[~whole][has] + k] = vocab.byte_ids[b[has, k]]
    return ids, off[u.first], np.round(segment_sums(occ_log, u.first), 6)


def decode_ids(vocab: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """UTF-8 bytes of all texts and their row offsets."""
    data, start, size = _piece_bytes(vocab)
    width = size[ids]
    ends = np.concatenate([[0], np.cumsum(width)])
    take = np.repeat(start[ids] - ends[:-1], width) + np.arange(ends[-1])
    return data[take].tobytes(), ends[offsets]


_BYTES: dict = {}


def _piece_bytes(vocab: Vocabulary):
    if id(vocab) not in _BYTES:
        by_id = [b""] * vocab.spec["size"]
        for p, i in zip(vocab.spec["pieces"], vocab.spec["ids"]):
            by_id[i] = p.replace("▁", " ").encode()
        for b, i in enumerate(vocab.spec["bytes"]):
            by_id[i] = bytes([b])
        size = np.array([len(b) for b in by_id], np.int64)
        _BYTES.clear()
        _BYTES[id(vocab)] = (np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(size) - size, size)
    return _BYTES[id(vocab)]


def _lists(ids: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> pa.Array:
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
    return pa.ListArray.from_buffers(
        lists.type, len(null), [pa.py_buffer(np.packbits(~null, bitorder="little")), lists.buffers()[1]], children=[lists.values]
    )


def _spelled(vocab, ids: np.ndarray, at: np.ndarray, raw: np.ndarray, off: np.ndarray, most: int = 1 << 18) -> tuple[list[str], list[bool]]:
    """(SHA-256 of what each text's pieces spell, whether that is the text), decoded some texts at a time."""
    digests, same, start = [], [], 0
    while start < len(at) - 1:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        data, ends = decode_ids(vocab, ids[at[start]:at[stop]], at[start:stop + 1] - at[start])
        for k, i, j in zip(range(start, stop), ends[:-1], ends[1:]):
            digests.append(hashlib.sha256(data[i:j]).hexdigest())
            same.append(bytes(data[i:j]) == raw[off[k]:off[k + 1]].tobytes())
        start = stop
    return digests, same


def encode(docs: DataFrame, model: str = MODEL, seed: int = SEED, alpha: float = ALPHA, text: str = "text",
           key: str = "doc_id", pieces: str = "piece_ids", log_prob: str = "log_prob", verify: bool = False) -> DataFrame:
    """Add (or replace) the sampled pieces (array of int) and the log chance of that segmentation among all of its text. With
    ``verify`` the pieces are decoded in the same pass: decoded_sha256 and lossless, whether they spell the text."""
    spark = prepare(docs.sparkSession)
    checks = ["decoded_sha256", "lossless"] if verify else []
    names = others(docs, pieces, log_prob, *checks)
    docs = docs.select(*names)
    shared, hashed = share_vocabulary(spark, model), fresh(docs, "row_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = held(shared)
        for b in slices(batches, text, CODEC_BYTES):
            raw, off = utf8(b.column(text))
            ids, at, logs = sample_slice(vocab, raw, off, b.column(hashed).to_numpy(zero_copy_only=False), seed, alpha)
            null = np.asarray(b.column(text).is_null())
            cols = [b.column(c) for c in names] + [_lists(ids, at, null), pa.array(logs, mask=null)]
            if verify:
                digests, same = _spelled(vocab, ids, at, raw, off)
                cols += [pa.array(digests, pa.string(), mask=null), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, pieces, log_prob, *checks])

    keyed = docs.withColumn(hashed, F.xxhash64(F.col(key)))
    fields = [*docs.schema.fields, T.StructField(pieces, T.ArrayType(T.IntegerType())), T.StructField(log_prob, T.DoubleType())]
    fields += [T.StructField(c, t) for c, t in zip(checks, (T.StringType(), T.BooleanType()))]
    return keyed.mapInArrow(run, T.StructType(fields))


def _id_slices(batches: Iterator[pa.RecordBatch], pieces: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds at most ``limit`` ids, or one row."""
    for b in batches:
        upto = np.cumsum(b.column(pieces).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + limit, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def decode(encoded: DataFrame, model: str = MODEL, pieces: str = "piece_ids", text: str = "text") -> DataFrame:
    """Add (or replace) the text that the pieces spell; null pieces give null."""
    spark = prepare(encoded.sparkSession)
    shared = share_vocabulary(spark, model)
    names = [c for c in encoded.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = held(shared)
        for b in _id_slices(batches, pieces):
            col = b.column(pieces)
            flat = col.flatten().to_numpy(zero_copy_only=False)
            sizes = np.array(col.value_lengths().fill_null(0))
            data, off = decode_ids(vocab, flat, np.concatenate([[0], np.cumsum(sizes)]))
            null = np.asarray(col.is_null())
            texts = [None if z else data[i:j].decode() for z, i, j in zip(null, off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(texts, pa.string())], names=[*names, text])

    fields = [encoded.schema[c] for c in names] + [T.StructField(text, T.StringType())]
    return encoded.mapInArrow(run, T.StructType(fields))


ROUND_TRIP = ("doc_id long, n_pieces long, log_prob double, piece_ids_sha256 string, decoded_sha256 string, lossless boolean")


def round_trip(docs: DataFrame, model: str = MODEL, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """Encode and decode every text in one pass: piece count, log chance, digests of the pieces (little-endian int32)
    and of the decoded text, and whether that equals the text. Null texts have null digests and lossless true."""
    spark = prepare(docs.sparkSession)
    shared = share_vocabulary(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = held(shared)
        for b in slices(batches, "text", CODEC_BYTES):
            raw, off = utf8(b.column("text"))
            ids, at, logs = sample_slice(vocab, raw, off, b.column("row_key").to_numpy(zero_copy_only=False), seed, alpha)
            data, doff = decode_ids(vocab, ids, at)
            text = raw.tobytes()
            null = np.asarray(b.column("text").is_null())
            wire = ids.astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(np.diff(at)), pa.array(logs, mask=null),
                pa.array([None if z else hashlib.sha256(wire[4 * i:4 * j]).hexdigest() for z, i, j in zip(null, at[:-1], at[1:])], pa.string()),
                pa.array([None if z else hashlib.sha256(data[i:j]).hexdigest() for z, i, j in zip(null, doff[:-1], doff[1:])], pa.string()),
                pa.array([data[i:j] == text[k:m] for i, j, k, m in zip(doff[:-1], doff[1:], off[:-1], off[1:])]),
            ], names=[c.split()[0] for c in ROUND_TRIP.split(", ")])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.xxhash64(F.col("doc_id")).alias("row_key"))
    return keyed.mapInArrow(run, ROUND_TRIP)
