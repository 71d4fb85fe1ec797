"""SimHash near-duplicates: fingerprints, a segment-popcount grid join, connected components.

Fingerprint: A-Z lower-cased, words between ASCII white space, shingles of WORDS words (repeats included; fewer words:
the whole sequence; no word: fingerprint zero), XXH64 (seed 42) of each; a bit is 1 if set in over half the hashes.

Search. The 64 bits are cut into segments of SEGMENT bits; a fingerprint maps to its bit count per segment. The
Manhattan distance of two such maps never exceeds the bit distance, in each block of segments as in the whole. With
BLOCKS = (segments, radius) and the sum of (radius + 1) above MAX_BITS, two fingerprints within MAX_BITS lie within the
radius in at least one block. So for each block every fingerprint enters its grid cell, and with radius 1 also the
cells one count above; rows that meet in a cell are candidates, kept if their Manhattan distance, then their bit
distance, allows. Radii of 0 and 1 are supported.

Scale. Equal texts and equal fingerprints are one row before the search. A cell with more than CELL_ROWS rows is split
into chunks and every pair of chunks is a task of its own, so no group is unbounded and no pair is lost. Each group
reports links that connect what it found (at most one fewer than its rows), not all pairs; components come from
checkpointed rounds over those links.

Cases: null text counts as empty; empty texts share fingerprint zero; a null id is never a component's id unless the
whole component has none; repeated rows and equal texts share a component; rows are neither lost nor repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotile.llm.common import fresh, prepare, shuffle_partitions, slices, utf8
from chronotile.operators.components import connected_components

WORDS, MAX_BITS = 4, 4
SEGMENT = 2
BLOCKS = ((12, 1), (12, 1), (8, 0))
CELL_ROWS = 4096
SHINGLES_AT_ONCE = 1 << 18


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64-bit fingerprint of one text (UTF-8)."""
    parts = text.lower().split()  # both work on ASCII only, as bytes
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = ends + 1 - np.array([len(p) + 1 for p in parts])
    n = max(1, len(parts) - words + 1)
    a, b = starts[:n].tolist(), ends[min(words, len(parts)) - 1:].tolist()
    ones, h64 = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLES_AT_ONCE):
        h = np.array([h64(joined[i:j], 42) for i, j in zip(a[at:at + SHINGLES_AT_ONCE], b[at:at + SHINGLES_AT_ONCE])], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, text: str = "text", out: str = "fp") -> DataFrame:
    """Add the fingerprint (as a signed long) to every row."""
    prepare(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            raw, off = utf8(b.column(text))
            data = raw.tobytes()
            fp = np.array([fingerprint(data[i:j], words) for i, j in zip(off[:-1], off[1:])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(fp)], names=[*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType(), False)]))


def _segment_table(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """By byte: the byte with each segment's bits sorted (so that XOR counts Manhattan distance), counts by segment."""
    per = 8 // bits
    value = np.arange(256)
    counts = np.stack([np.bitwise_count(((value >> (bits * k)) & ((1 << bits) - 1)).astype(np.uint8)) for k in range(per)], 1)
    packed = sum(((1 << counts[:, k].astype(int)) - 1) << (bits * k) for k in range(per))
    return packed.astype(np.uint8), counts.astype(np.int64)


def embed(fp: np.ndarray, bits: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """(sorted-segment form, counts by segment) of fingerprints given as uint64."""
    packed, counts = _segment_table(bits)
    by = np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)
    return packed[by].view(np.uint64).ravel(), counts[by].reshape(len(fp), -1)


def grid_cells(fps: DataFrame, segment: int = SEGMENT, blocks=BLOCKS, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows (block, cell, above, fp): the own cell of each block and, with radius 1, the cells one count above."""
    if sum(r + 1 for _, r in blocks) <= max_bits or sum(n for n, _ in blocks) * segment != 64 or any(r > 1 for _, r in blocks):
        raise ValueError("the blocks do not cover the distance")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            counts, out, first = embed(fp, segment)[1], [], 0
            for k, (n, radius) in enumerate(blocks):
                part = counts[:, first:first + n]
                first += n
                power = (segment + 1) ** np.arange(n)
                cell = part @ power
                out.append((k, cell, np.arange(len(fp)), False))
                for i in range(n * radius):
                    up = np.flatnonzero(part[:, i] < segment)
                    out.append((k, cell[up] + power[i], up, True))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.full(len(r), k, np.int32) for k, _, r, _ in out])),
                pa.array(np.concatenate([c for _, c, _, _ in out])),
                pa.array(np.concatenate([np.full(len(r), u) for _, _, r, u in out])),
                pa.array(np.concatenate([fp[r] for _, _, r, _ in out]).view(np.int64)),
            ], names=["block", "cell", "above", "fp"])

    return fps.select("fp").mapInArrow(run, "block int, cell long, above boolean, fp long")


def spread(cells: DataFrame, limit: int = CELL_ROWS) -> DataFrame:
    """Give rows of large cells to pairs of chunks: chunk i meets every chunk j, in a group (i, j) of its own."""
    large = cells.groupBy("block", "cell").count().where(F.col("count") > limit)
    n = F.coalesce(F.ceil(F.col("count") / limit), F.lit(1)).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("n"))
    return (
        cells.join(large, ["block", "cell"], "left").withColumn("n", n).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .select("block", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "above", "fp")
    )


def _join(parent: dict, a: int, b: int) -> bool:
    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    x, y = root(a), root(b)
    if x != y:
        parent[max(x, y)] = min(x, y)
    return x != y


def links_of_cell(fp: np.ndarray, above: np.ndarray, own: np.ndarray, split: bool, max_bits: int, segment: int) -> list[tuple[int, int]]:
    """Links that connect all rows of one group which lie within max_bits. Own-cell rows meet own-cell rows and rows
    from the cell below; in a split cell only rows of different chunks, or of the one chunk, meet."""
    packed, home, parent, out = embed(fp, segment)[0], np.flatnonzero(~above), {}, []
    for at in range(0, len(home), 256):
        rows = home[at:at + 256]
        near = np.bitwise_count(packed[rows][:, None] ^ packed[None, :]) <= max_bits  # the lower bound
        near &= above[None, :] | (np.arange(len(fp))[None, :] > rows[:, None])
        if split:
            near &= own[rows][:, None] != own[None, :]
        a, b = np.nonzero(near)
        a = rows[a]
        exact = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
        for x, y in zip(fp[a[exact]].tolist(), fp[b[exact]].tolist()):
            if x != y and _join(parent, x, y):
                out.append((x, y))
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS, segment: int = SEGMENT, blocks=BLOCKS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that connect all within max_bits."""
    spark = prepare(fps.sparkSession)
    rows = spread(grid_cells(fps, segment, blocks, max_bits), cell_rows)
    group = ["block", "cell", "i", "j"]

    def small(key: np.ndarray, fp: np.ndarray, above: np.ndarray):
        """Links of all groups of an ordered run at once; key numbers the groups."""
        size = np.bincount(key)
        end = np.cumsum(size)[key]
        n = end - np.arange(len(key)) - 1
        packed = embed(fp, segment)[0]
        for at in range(0, len(key), 1 << 15):
            c = n[at:at + (1 << 15)]
            a = np.repeat(np.arange(at, at + len(c)), c)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.concatenate([[0], np.cumsum(c)[:-1]]), c)
            keep = np.bitwise_count(packed[a] ^ packed[b]) <= max_bits
            a, b = a[keep], b[keep]
            keep = (np.bitwise_count(fp[a] ^ fp[b]) <= max_bits) & ~(above[a] & above[b])
            parent: dict = {}
            for x, y in zip(fp[a[keep]].tolist(), fp[b[keep]].tolist()):
                if x != y and _join(parent, x, y):
                    yield x, y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(t: pa.Table) -> pa.RecordBatch:
            col = {c: t.column(c).to_numpy() for c in t.column_names}
            new = np.zeros(t.num_rows, bool)
            for c in group:
                new[1:] |= col[c][1:] != col[c][:-1]
            new[0] = True
            key = np.cumsum(new) - 1
            size = np.bincount(key)
            fp, above, own = col["fp"].view(np.uint64), col["above"], col["own"]
            out: list[tuple[int, int]] = []
            big = (size > 128) | (col["i"][np.flatnonzero(new)] != col["j"][np.flatnonzero(new)])
            start = np.flatnonzero(new)
            for k in np.flatnonzero(big):
                s = slice(start[k], start[k] + size[k])
                out += links_of_cell(fp[s], above[s], own[s], bool(col["i"][start[k]] != col["j"][start[k]]), max_bits, segment)
            rest = ~big[key]
            if rest.any():
                _, again = np.unique(key[rest], return_inverse=True)
                out += small(again, fp[rest], above[rest])
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])

        for b in batches:  # a group may go on in the next batch
            if not b.num_rows:
                continue
            last = [b.column(c)[b.num_rows - 1].as_py() for c in group]
            same = np.ones(b.num_rows, bool)
            for c, v in zip(group, last):
                same &= b.column(c).to_numpy(zero_copy_only=False) == v
            cut = int(np.flatnonzero(same)[0])
            if cut or (held and [held[-1].column(c)[0].as_py() for c in group] != last):
                t = pa.Table.from_batches([*held, b.slice(0, cut)])
                held = []
                if t.num_rows:
                    yield work(t)
            held.append(b.slice(cut))
        if held:
            yield work(pa.Table.from_batches(held))

    n = shuffle_partitions(spark)
    sorted_rows = rows.repartition(n, *group).sortWithinPartitions(*group)
    return sorted_rows.mapInArrow(run, "u long, v long")


def components(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest id reachable over links of at most max_bits."""
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = fingerprints(own, words).select("doc_id", "fp").checkpoint(eager=True)  # 16 bytes a row
    return own.join(_by_fingerprint(own, max_bits).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _by_fingerprint(own: DataFrame, max_bits: int) -> DataFrame:
    """(fp, rep, component, component_id): rep is the smallest id with that fingerprint."""
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = links(fps, max_bits)
    comp = connected_components(found)  # node, component: fingerprints with a link
    named = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return named.join(ids, "component")


def keep_one(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component: that with the smallest id (of its rows with that id, one; which one is fixed by its
    fingerprint, and rows equal in both id and fingerprint count as repeats). All columns are kept."""
    prepare(docs.sparkSession)
    mark, fp_col, kept_fp = fresh(docs, "kept_id"), fresh(docs, "fp_of_row"), fresh(docs, "kept_fp")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = fingerprints(own, words).select("doc_id", "fp").checkpoint(eager=True)
    named = _by_fingerprint(own, max_bits)
    kept = named.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "fp")).alias("k"))
    kept = kept.select(F.col("k.rep").alias(mark), F.col("k.fp").alias(kept_fp))
    rows = fingerprints(docs, words, out=fp_col)
    out = rows.join(kept, (rows[fp_col] == kept[kept_fp]) & rows["doc_id"].cast("long").eqNullSafe(kept[mark]), "inner")
    return out.drop(mark, kept_fp).dropDuplicates(["doc_id", fp_col]).select(*docs.columns)
