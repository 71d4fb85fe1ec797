"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Documents become token ids (a public tokenizer file, no special tokens, an end id); only documents longer than a sequence
are cut. The reduction then fixes sets that no alternative can beat. With ``room`` = what a piece j leaves of a sequence:

* nothing else fits: {j};
* the largest piece that fits, j*, fills the room exactly, or at most one more piece can ever fit: {j, j*};
* at most two more fit and no feasible pair is larger than j*: {j, j*};
* at most two more fit, the best pair (a, b) has a = j*, and no two other pieces above b fit together: {j, a, b}.

In each case every feasible set with j can be exchanged for the fixed one: its other members fit, one into each place, into
the fixed members. Fixing shrinks the instance, so passes over all sizes repeat until nothing more is fixed. What remains is
packed best-fit decreasing.

Scale: pieces of one length are interchangeable, so both steps work on how many pieces have each length: at most
``capacity`` numbers, whatever the input. A rule stays true while its members last, so it is applied to whole counts at
once; bins are ranges of equal bins. The plan, runs (length, first rank, count, first bin, pieces a bin, place), depends on
the capacity only and goes to every task. A piece finds its run by its rank among those of its length: a running count in its
partition plus that of earlier partitions. Texts and ids are never shuffled.

Cases: null text counts as empty and becomes one end id; an empty table gives no rows; null and repeated ids and equal
texts keep a piece each; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotile.llm.common import ascii_words, prepare, slices, utf8

TOKENIZER, CAPACITY, END_ID = "word_bpe_49k.json", 2048, 0
KNOWN_WORDS, JOINED_WORDS, TEXT_BYTES = 1_000_000, 500, 4 << 20  # kept by a worker; in one call; text at once
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_TOKENIZERS: dict[int, object] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _strings(words: pa.Array) -> list[str]:
    """The words as Python strings; as none holds white space, one decoded line is cut."""
    if not len(words):
        return []
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
    return pc.binary_join(one, " ")[0].as_py().split(" ")


def _splitter(spec: dict) -> Callable[[str], list[str]] | None:
    """What finds the parts of a lower-case printable ASCII word that the tokenizer encodes one by one, if the tokenizer does
    nothing else to such a word: Unicode composition, white space and case are its only normal forms, one pattern its split."""
    form, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    forms = [x.get("type") for x in form.get("normalizers", [])]
    steps = split.get("pretokenizers", [])
    if forms != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in steps] != ["Split", "ByteLevel"]:
        return None
    if form["normalizers"][1]["pattern"] != {"Regex": "\\s+"} or steps[0]["behavior"] != "Removed" or not steps[0]["invert"]:
        return None
    if steps[1]["add_prefix_space"] or steps[1]["use_regex"] or "Regex" not in steps[0]["pattern"]:
        return None
    return regex.compile(steps[0]["pattern"]["Regex"]).findall


class Encoder:
    """Ids of many texts at once. The tokenizer drops white space and no token spans it, so each different word is encoded
    once and its ids are kept, for at most KNOWN_WORDS words. Printable ASCII words are cut by the tokenizer's own pattern
    and each different part is given to its model once; other words are encoded whole, many in one call."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model, read = self.tokenizer.model, json.loads(spec)
        self.split = _splitter(read)
        marks = "".join(regex.escape(t["content"][0], special_only=False) for t in read.get("added_tokens", []))
        self.plain = regex.compile(rf"(?V1)[[!-~]--[{marks} ]]+").fullmatch  # printable ASCII without the start of an added token
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.parts: dict[str, list[int]] = {}
        self.flat, self.end = np.array([END_ID], np.uint32), np.array([0, 1], np.int64)  # entry 0 is the end id

    def _plain(self, words: list[str]) -> tuple[list[int], list[int]]:
        """(ids, how many each word has) of words that the pattern splits."""
        parts, ids, size = self.parts, [], []
        for w in words:
            n = 0
            for p in self.split(w.lower()):
                known = parts.get(p)
                if known is None:
                    known = parts[p] = [t.id for t in self.model.tokenize(p)]
                ids += known
                n += len(known)
            size.append(n)
        return ids, size

    def _whole(self, words: list[str]) -> tuple[list[int], list[int]]:
        ids, size = [], []
        for i in range(0, len(words), JOINED_WORDS):
            some = words[i:i + JOINED_WORDS]
            begin = np.cumsum([0] + [len(w) + 1 for w in some])
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            at = np.array([a for a, _ in e.offsets], np.int64)
            size += np.bincount(np.searchsorted(begin, at, side="right") - 1, minlength=len(some)).tolist()
            ids += e.ids
        return ids, size

    def learn(self, words: list[str]) -> None:
        plain = [self.plain(w) is not None for w in words] if self.split else [False] * len(words)
        for group, encode in (([w for w, a in zip(words, plain) if a], self._plain), ([w for w, a in zip(words, plain) if not a], self._whole)):
            if group:
                ids, size = encode(group)
                n = len(self.end) - 1
                self.known.update(zip(group, range(n, n + len(group))))
                self.end = np.concatenate([self.end, self.end[-1] + np.cumsum(size)])
                self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with its end id; where each text begins)."""
        words, first = ascii_words(*utf8(column))
        enc = words.dictionary_encode()
        different = _strings(enc.dictionary)
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        known = self.known
        if new := [w for w in different if w not in known]:
            self.learn(new)
        entry = np.fromiter(map(known.__getitem__, different), np.int64, len(different))
        code = np.insert(entry[enc.indices.to_numpy(zero_copy_only=False)], first[1:], 0)
        n = np.diff(self.end)[code]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.end[code] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, upto[first + np.arange(len(first))]


def _encoder(shared) -> Encoder:
    if shared.id not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[shared.id] = Encoder(shared.value)
    return _TOKENIZERS[shared.id]


class _Shared:
    """A broadcast with a key that is the same in every worker."""

    def __init__(self, spark, spec: str):
        self.held = spark.sparkContext.broadcast(spec)
        self.id = zlib.crc32(spec.encode())

    @property
    def value(self) -> str:
        return self.held.value


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids, cut only where longer than ``capacity``."""
    spark = prepare(docs.sparkSession)
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        shared = _Shared(spark, f.read())
    names = [c.split()[0] for c in PIECES.split(", ")] + (["ids"] if keep_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for b in slices(batches, "text", TEXT_BYTES):
            ids, first = encoder.ids(b.column("text"))
            n = -(-np.diff(first) // capacity)
            row = np.repeat(np.arange(b.num_rows), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            lo = first[row] + piece * capacity
            hi = np.minimum(lo + capacity, first[row + 1])
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(lo.tolist(), hi.tolist())]
            cols = [b.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece.astype(np.int64) * capacity),
                    pa.array((hi - lo).astype(np.int64)), pa.array(crc, pa.int64())]
            if keep_ids:  # pieces lie one after another
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(lo, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else ""))


class Plan:
    """Runs of pieces of one length; ``left[s]`` pieces of length s are not placed yet."""

    def __init__(self, counts: dict[int, int], capacity: int):
        if any(not 0 < s <= capacity for s in counts):
            raise ValueError("a piece is empty or longer than a sequence")
        self.capacity, self.bins = capacity, 0
        self.left = np.zeros(capacity + 1, np.int64)
        for s, n in counts.items():
            self.left[s] = n
        self.done = np.zeros(capacity + 1, np.int64)
        self.runs: list[tuple[int, int, int, int, int, int]] = []

    def put(self, size: int, n: int, bin_: int, per_bin: int, place: int) -> None:
        self.runs.append((size, int(self.done[size]), n, bin_, per_bin, place))
        self.done[size] += n
        self.left[size] -= n

    def fix(self, members: list[int]) -> None:
        """Give as many bins as the members last for this set."""
        need = {s: members.count(s) for s in members}
        times = min(int(self.left[s]) // m for s, m in need.items())
        place = 0
        for s, m in need.items():
            self.put(s, times * m, self.bins, m, place)
            place += m * s
        self.bins += times


def dominant_set(left: np.ndarray, j: int, capacity: int) -> list[int] | None:
    """The set that dominates every other feasible set with a piece of size j, if one of the four rules gives it.
    ``left`` counts the pieces of each size, j among them."""
    room, left = capacity - j, left.copy()
    left[j] -= 1
    sizes = np.flatnonzero(left[:room + 1] > 0)
    if not len(sizes):
        return [j]
    best = int(sizes[-1])
    smallest = np.repeat(sizes[:3], np.minimum(left[sizes[:3]], 3))[:3]
    fits = int((np.cumsum(smallest) <= room).sum())
    if best == room or fits == 1:
        return [j, best]
    if fits > 2:
        return None
    below = np.maximum.accumulate(np.where(left[:room + 1] > 0, np.arange(room + 1), 0))
    partner = below[np.minimum(room - sizes, sizes)]
    alone = (partner == sizes) & (left[sizes] < 2)
    partner = np.where(alone, below[np.maximum(sizes - 1, 0)], partner)
    pair = np.where(partner > 0, sizes + partner, 0)
    if best >= pair.max():
        return [j, best]
    second = int(partner[-1])
    if pair[-1] < pair.max() or not second:
        return None
    others = left[second + 1:best + 1].copy()
    if best > second:
        others[-1] -= 1
    two = np.repeat(np.flatnonzero(others > 0)[:2] + second + 1, np.minimum(others[others > 0][:2], 2))[:2]
    return [j, best, second] if len(two) < 2 or two.sum() > room else None


def reduce_by_dominance(plan: Plan) -> None:
    changed = True
    while changed:
        changed = False
        for j in range(plan.capacity, 0, -1):
            while plan.left[j] and (found := dominant_set(plan.left, j, plan.capacity)):
                plan.fix(found)
                changed = True


def best_fit_decreasing(plan: Plan) -> None:
    """Each size, largest first, into the fullest bins that take it; bins of equal room are ranges."""
    c = plan.capacity
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(c + 1)]
    some = np.zeros(c + 1, bool)

    def give(room: int, lo: int, hi: int) -> None:
        if hi > lo:
            rooms[room].append((lo, hi))
            some[room] = True

    for s in range(c, 0, -1):
        while n := int(plan.left[s]):
            open_ = np.flatnonzero(some[s:])
            if not len(open_):
                more = -(-n // (c // s))
                give(c, plan.bins, plan.bins + more)
                plan.bins += more
                continue
            room = s + int(open_[0])
            lo, hi = rooms[room].pop()
            some[room] = bool(rooms[room])
            k = room // s
            full = min(hi - lo, n // k)
            if full:
                plan.put(s, full * k, lo, k, c - room)
                give(room - k * s, lo, lo + full)
            rest = n - full * k
            if full < hi - lo and 0 < rest:
                plan.put(s, rest, lo + full, rest, c - room)
                give(room - rest * s, lo + full, lo + full + 1)
                full += 1
            give(room, lo + full, hi)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """counts: pieces by length."""
    plan = Plan(counts, capacity)
    reduce_by_dominance(plan)
    plan.fixed_bins = plan.bins
    best_fit_decreasing(plan)
    return plan


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces that have a ``length``."""
    prepare(rows.sparkSession)
    names = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    held = rows.select(*names).checkpoint(eager=True)  # partitions and their order stay
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            size = b.column("length").to_numpy(zero_copy_only=False)
            order = np.argsort(size, kind="stable")
            sizes, first, n = np.unique(size[order], return_index=True, return_counts=True)
            inside = np.empty(len(size), np.int64)
            inside[order] = np.arange(len(size)) - np.repeat(first, n)
            inside += seen[size]
            seen[sizes] += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(inside)], names=[*names, "part_", "inside_"])

    ranked = held.withColumn("part_", F.spark_partition_id()).mapInArrow(rank, f"{fields}, part_ int, inside_ long")
    per_part = held.groupBy(F.spark_partition_id().alias("part_"), "length").agg(F.count(F.lit(1)).alias("n_")).checkpoint(eager=True)
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n_").alias("n")).collect()}  # a row per length
    plan = plan_bins(counts, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
    shared = rows.sparkSession.sparkContext.broadcast(runs)  # bounded by the capacity, not by the rows
    before = Window.partitionBy("length").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part_", "length", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("upto_"))
    placed = ranked.join(offsets, ["part_", "length"]).select(*names, (F.col("inside_") + F.col("upto_")).alias("rank_"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, _, bin_, per_bin, start = shared.value.T if len(shared.value) else np.zeros((6, 0), np.int64)
        keys = (size << 48) + first
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            at = b.column("rank_").to_numpy(zero_copy_only=False)
            r = np.searchsorted(keys, (length << 48) + at, side="right") - 1
            nth = at - first[r]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(bin_[r] + nth // per_bin[r]), pa.array(start[r] + nth % per_bin[r] * length)],
                names=[*names, "sequence_id", "offset"])

    return placed.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed pieces (with ids) put together; a group is one sequence, bounded by its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and place, without the ids."""
    return pack(pieces(docs, path, capacity, keep_ids=False), capacity)
