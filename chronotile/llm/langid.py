"""Language identification by segmentation-marginalised unigrams.

A language is a unigram distribution over the pieces of a fixed public vocabulary. Training takes one expectation
step from rank weights: every text's lattice gives the expected number of uses of each piece (over all segmentations),
summed per language over all training rows and smoothed. A text's likelihood under a language is the total weight of
all its segmentations (forward algorithm), not of one of them; the language with the largest likelihood wins and the
score is its posterior under equal priors.

Bounds: the model has (vocabulary size x languages) numbers; more than MAX_LANGUAGES raises. Work inside a task is
bounded by the slice (common.SLICE_BYTES) or one text.

Cases: null text or no letter -> `und`, score 0; no training rows -> `und`; rows with null language do not train;
repeated rows each count; ties go to the language first in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotile.llm.common import others, prepare, segment_sums, slices, utf8
from chronotile.llm.lattice import LONG_UNIT, arc_shares, arc_weights, cut_units, expected_uses, forward, sparse_forward
from chronotile.llm.sentencepiece_codec import MODEL, Shared, held, rank_weights, share_vocabulary

SMOOTHING, MAX_LANGUAGES = 0.1, 500


def _long_units(u):
    starts = np.concatenate([[0], np.cumsum(u.lengths)])
    for r in np.flatnonzero(u.lengths > LONG_UNIT):
        yield r, u.chars[starts[r]:starts[r + 1]]


def piece_counts(docs: DataFrame, shared: Shared, text: str = "text", lang: str = "lang") -> DataFrame:
    """Expected piece counts per language: rows (lang, piece, n), pre-aggregated per slice, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = held(shared)
        weight = rank_weights(vocab, 1.0)
        log_weight = np.log(weight)
        for b in slices(batches, text):
            raw, off = utf8(b.column(text))
            u = cut_units(raw, off)
            enc = b.column(lang).dictionary_encode()
            names, of_doc = enc.dictionary.to_pylist(), enc.indices.to_numpy(zero_copy_only=False)
            of_occ = np.repeat(of_doc, np.diff(u.first))
            k, v = len(names), vocab.spec["size"]
            times = np.bincount(of_occ * len(u.lengths) + u.code, minlength=k * len(u.lengths)).reshape(k, -1)
            total = np.zeros((k, v + 1))
            for g in vocab.groups(u.chars, u.lengths):
                w = arc_weights(vocab, g, weight)
                use = expected_uses(g, arc_shares(g, w, forward(g, w)[1]))
                piece = np.where(g.piece >= 0, g.piece, v)  # byte-spelled characters gather in a last column
                for x in range(k):
                    total[x] += np.bincount(piece, use * times[x][g.rows][g.row], minlength=v + 1)
            for r, cp in _long_units(u):
                log_total, into, alpha = sparse_forward(vocab, cp, log_weight)
                visit = np.zeros(len(cp) + 1)
                visit[-1] = 1.0
                for e in range(len(cp), 0, -1):
                    for j, i, lw in into[e]:
                        p = visit[e] * np.exp(alpha[j] + lw - alpha[e])
                        visit[j] += p
                        if i >= 0:
                            total[:, i] += p * times[:, r]
            x, i = np.nonzero(total[:, :v])
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[a] for a in x], pa.string()), pa.array(i.astype(np.int32)), pa.array(total[x, i])], names=["lang", "piece", "n"]
            )

    rows = docs.select(F.col(lang).cast("string").alias(lang), F.col(text).cast("string").alias(text)).where(F.col(lang).isNotNull())
    # fixed point: sums of whole millionths do not depend on the order in which tasks finish
    return (rows.mapInArrow(run, "lang string, piece int, n double")
            .groupBy("lang", "piece").agg(F.sum((F.col("n") * 1e6).cast("long")).alias("n")))


def train(docs: DataFrame, model: str = MODEL, smoothing: float = SMOOTHING) -> dict:
    """Piece probabilities per language, learned from the text and language of the given rows."""
    spark = prepare(docs.sparkSession)
    shared = share_vocabulary(spark, model)
    spec = shared.value
    counts = piece_counts(docs, shared).checkpoint(eager=True)
    langs = sorted(r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    at = {x: i for i, x in enumerate(langs)}
    table = np.zeros((len(langs), spec["size"]))
    got = counts.toPandas()  # bounded: languages x vocabulary
    table[got["lang"].map(at).to_numpy(int), got["piece"].to_numpy(int)] = got["n"].to_numpy() / 1e6
    table += smoothing
    table /= table.sum(axis=1, keepdims=True)
    return {"langs": langs, "probs": table, "shared": shared}


def log_likelihoods(vocab, raw: np.ndarray, offsets: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """[text, language] log of the total weight of all segmentations."""
    u = cut_units(raw, offsets)
    per_unit = np.zeros((len(u.lengths), len(probs)))
    for g in vocab.groups(u.chars, u.lengths):
        for k, p in enumerate(probs):
            per_unit[g.rows, k] = forward(g, arc_weights(vocab, g, p))[0]
    for r, cp in _long_units(u):
        for k, p in enumerate(probs):
            per_unit[r, k] = sparse_forward(vocab, cp, np.log(p))[0]
    out = np.zeros((len(offsets) - 1, len(probs)))
    for k in range(len(probs)):
        out[:, k] = segment_sums(per_unit[u.code, k], u.first)
    return out


def predict(docs: DataFrame, model: dict, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add (or replace) the predicted language and its posterior. Only the text is read."""
    spark = prepare(docs.sparkSession)
    names, langs, vocab_of = others(docs, lang_pred, score), model["langs"], model["shared"]
    docs = docs.select(*names)
    probs = spark.sparkContext.broadcast(model["probs"])
    fields = [*docs.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]
    if not langs:
        return docs.select("*", F.lit("und").alias(lang_pred), F.lit(0.0).alias(score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = held(vocab_of)
        for b in slices(batches, text):
            raw, off = utf8(b.column(text))
            ll = log_likelihoods(vocab, raw, off, probs.value)
            best = ll.argmax(axis=1)
            post = np.round(1.0 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1), 9)
            data = raw.tobytes()
            letters = [any(map(str.isalpha, data[i:j].decode())) for i, j in zip(off[:-1], off[1:])]
            cols = [pa.array([langs[k] if a else "und" for k, a in zip(best, letters)], pa.string()), pa.array(np.where(letters, post, 0.0))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + cols, names=[*names, lang_pred, score])

    return docs.mapInArrow(run, T.StructType(fields))
