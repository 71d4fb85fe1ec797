"""Periodic runs of words by grammar-compressed run detection.

A run is a stretch of consecutive words with smallest period q, of at least max(MIN_WORDS, exponent * q) words, that no
neighbouring word extends keeping the period. Steps, for all texts of a slice at once, in NumPy:

1. Cut. Each pair of neighbouring words of a run occurs in it at least exponent - 1 times, so places whose pair is rarer in
   its stretch lie in no run. Cutting there is repeated while stretches shrink.
2. Re-Pair. In rounds, repeated pairs of symbols become nonterminals, the more frequent first (by powers of two, then by
   hash): a pair is replaced where no more frequent one overlaps it, equal neighbours in steps of two. Pairs that occur once
   come last, until each stretch is one symbol. Rounds are few, for frequencies and hashes both break up long chains.
3. Boundaries. For each nonterminal X = YZ, once: a run across the boundary with exponent >= 4 has two periods on one side,
   so q is a candidate if Z starts or Y ends with a square of period q (prefix sums of hashes, confirmed word by word).
   From there the period is extended inside X. A square inside a smaller period found before is a repetition of it.
4. Translation. What X holds is moved to all places where X stands in the derivation. A run lies whole in the smallest
   nonterminal around it; what other nonterminals see of it is a part of the same interval, which merging by period drops.

Words are numbered exactly (dictionary), never by hash alone. Rows are independent: no shuffle, and a task holds one
slice (common.SLICE_BYTES) or one text.

Cases: null and empty texts have no words, no runs and an empty collapsed text; repeated rows and null ids are kept; input
columns with the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotile.llm.common import ascii_words, mix64, prepare, slices, utf8

MIN_WORDS, EXPONENT = 6, 4
PAIRS_AT_ONCE = 1 << 21
RUN = "struct<start:long,length:long,period:long>"


def _codes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each pair (a, b), how often each number occurs, its first place)."""
    _, first, code, n = np.unique(a * (int(b.max()) + 1) + b, return_index=True, return_inverse=True, return_counts=True)
    return code, n, first


def stretches(words: np.ndarray, text: np.ndarray, min_words: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of words that may lie in runs, number of the stretch of each), both ascending."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[1:] == text[:-1])  # places of pairs
    if not len(at):
        return nothing
    pair = _codes(words[at], words[at + 1])[0]
    part = text[at]
    while True:
        code, n, _ = _codes(part, pair)
        keep = n[code] >= exponent - 1
        breaks = np.concatenate([[True], (np.diff(at[keep]) > 1) | (np.diff(part[keep]) > 0)]) if keep.any() else np.zeros(0, bool)
        part_of = np.cumsum(breaks) - 1
        size = np.bincount(part_of) if len(part_of) else np.zeros(0, np.int64)
        long_enough = size[part_of] >= min_words - 1
        before = len(at)
        at, pair, part = at[keep][long_enough], pair[keep][long_enough], part_of[long_enough]
        if not len(at):
            return nothing
        if len(at) > 0.9 * before:
            break
    last = np.append(np.diff(part) > 0, True)  # the pair that ends a stretch brings its second word
    place = np.repeat(at, 1 + last)
    stretch = np.repeat(part, 1 + last)
    ends = np.flatnonzero(last) + np.arange(1, int(last.sum()) + 1)
    place[ends] += 1
    return place, stretch


class Grammar:
    """Nonterminals of the stretches: for each its length, that of its left part, and the places where it stands."""

    def __init__(self, words: np.ndarray, stretch: np.ndarray):
        symbols, part, at = words.astype(np.int64), stretch, np.arange(len(words), dtype=np.int64)
        length = np.ones(int(words.max()) + 1, np.int64)
        terminals = len(length)
        left, rules, places = [], [], []
        while True:
            pairs = np.flatnonzero(part[1:] == part[:-1])
            if not len(pairs):
                break
            code, n, first = _codes(symbols[pairs], symbols[pairs + 1])
            key = mix64(symbols[pairs][first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + symbols[pairs + 1][first].astype(np.uint64))
            rank = np.empty(len(n), np.int64)
            rank[np.lexsort((key, np.log2(n).astype(np.int64)))] = np.arange(len(n))
            r = np.full(len(symbols) + 1, -1, np.int64)  # r[i]: rank of the pair at i; the last entry closes the row
            r[pairs] = rank[code]
            starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))  # streaks of one pair: equal symbols
            ends = np.append(starts[1:], len(r))
            own = r[starts]
            lo = starts + (np.concatenate([[-1], own[:-1]]) > own)
            hi = ends - (np.append(own[1:], -1) > own)
            some = (own >= 0) & (hi > lo)
            lo, hi = lo[some], hi[some]
            take = (hi - lo + 1) // 2
            chosen = np.repeat(lo - 2 * (np.cumsum(take) - take), take) + 2 * np.arange(int(take.sum()))
            chosen = chosen[part[chosen] == part[chosen + 1]]
            used, rule = np.unique(r[chosen], return_inverse=True)
            where = np.flatnonzero(np.isin(rank, used))
            where = where[np.argsort(rank[where])]
            y, z = symbols[pairs][first[where]], symbols[pairs + 1][first[where]]
            left.append(length[y])
            rules.append(len(length) - terminals + rule)
            places.append(at[chosen])
            symbols[chosen] = len(length) + rule
            length = np.concatenate([length, length[y] + length[z]])
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, part, at = symbols[keep], part[keep], at[keep]
        none = [np.zeros(0, np.int64)]
        self.length = length[terminals:]
        self.left = np.concatenate(left or none)
        rules, places = np.concatenate(rules or none), np.concatenate(places or none)
        order = np.argsort(rules, kind="stable")
        self.places = places[order]
        self.first = np.searchsorted(rules[order], np.arange(len(self.length) + 1))


def _squares(words: np.ndarray, g: Grammar, rules: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the rules: (rule, candidate periods, square right of the boundary, square left of it)."""
    base = np.uint64(0xD1342543DE82EF95)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words), base)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(words.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    tries = g.length[rules] // 4
    upto = np.cumsum(tries)
    i = 0
    while i < len(rules):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS_AT_ONCE, side="right")))
        n = tries[i:j]
        x = np.repeat(rules[i:j], n)
        q = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1
        lo = g.places[g.first[x]]
        mid, hi = lo + g.left[x], lo + g.length[x]
        right, leftwards = mid + 2 * q <= hi, mid - 2 * q >= lo
        right[right] &= words[mid[right]] == words[mid[right] + q[right]]
        leftwards[leftwards] &= words[mid[leftwards] - 1] == words[mid[leftwards] - 1 - q[leftwards]]

        def equal(at: np.ndarray, q: np.ndarray) -> np.ndarray:
            return (sums[at + q] - sums[at]) * power[q] == sums[at + 2 * q] - sums[at + q]

        right[right] &= equal(mid[right], q[right])
        leftwards[leftwards] &= equal(mid[leftwards] - 2 * q[leftwards], q[leftwards])
        some = np.flatnonzero(right | leftwards)
        x, q, right, leftwards = x[some], q[some], right[some], leftwards[some]
        cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(x[a]), q[a:b], right[a:b], leftwards[a:b]
        i = j


def boundary_runs(words: np.ndarray, g: Grammar, min_words: int, exponent: int) -> np.ndarray:
    """Rows (rule, start in the rule, end, period): repetitions across each rule's boundary, as far as the rule goes."""
    out = []
    for x, q, right, leftwards in _squares(words, g, np.flatnonzero(g.length >= min_words)):
        w = words[g.places[g.first[x]]:][:g.length[x]]
        mid = int(g.left[x])
        while len(q):
            p = int(q[0])
            differ = np.flatnonzero(w[:-p] != w[p:])
            sides = ([mid] if right[0] else []) + ([mid - 2 * p] if leftwards[0] else [])
            right[0] = leftwards[0] = False
            for i in sides:
                k = np.searchsorted(differ, i)
                lo = int(differ[k - 1]) + 1 if k else 0
                hi = (int(differ[k]) if k < len(differ) else len(w) - p) + p
                if hi - i < 2 * p:
                    continue  # equal hashes, different words
                right &= (lo > mid) | (mid + 2 * q > hi)
                leftwards &= (hi < mid) | (mid - 2 * q < lo)
                if hi - lo >= max(min_words, exponent * p):
                    out.append((x, lo, hi, p))
            still = right | leftwards
            q, right, leftwards = q[still], right[still], leftwards[still]
    return np.array(out, np.int64).reshape(-1, 4)


def merged(part: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the maximal intervals: those of one part and period that share a period's length are one run."""
    order = np.lexsort((end, start, period, part))
    part, start, end, period = part[order], start[order], end[order], period[order]
    group = np.cumsum(np.concatenate([[True], (np.diff(part) > 0) | (np.diff(period) != 0)])) - 1
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(group * far + end) - group * far
    new = np.concatenate([[True], (np.diff(group) > 0) | (start[1:] + period[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    return start[first], np.maximum.reduceat(end, first), period[first]


def find(words: np.ndarray, text: np.ndarray, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs as (start, end, period) in places of ``words``; ``text`` numbers the text of each word, ascending."""
    nothing = (np.zeros(0, np.int64),) * 3
    place, stretch = stretches(words, text, min_words, exponent)
    if not len(place):
        return nothing
    w = words[place].astype(np.int64)
    g = Grammar(w, stretch)
    rows = boundary_runs(w, g, min_words, exponent)
    if not len(rows):
        return nothing
    rule, lo, hi, period = rows.T
    n = g.first[rule + 1] - g.first[rule]
    every = np.repeat(g.first[rule] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    at = g.places[every]
    start, end, period = merged(stretch[at], at + np.repeat(lo, n), at + np.repeat(hi, n), np.repeat(period, n))
    start, end = place[start], place[end - 1] + 1
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def find_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed",
              min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """Add the runs of each text, by start, then period, and the text without what a run repeats: its words joined by one
    space, those that follow the first period of a run left out."""
    if exponent < 4 or min_words < 2:
        raise ValueError("a run needs an exponent of 4 and two words at least")
    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in (runs.lower(), collapsed.lower()) or c == text]
    if text in (runs, collapsed):
        raise ValueError("results need names other than the text's")
    fields = [f for f in docs.schema.fields if f.name in names]
    item = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([*fields, T.StructField(runs, T.ArrayType(item)), T.StructField(collapsed, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            words, first = ascii_words(*utf8(b.column(text)))
            enc = words.dictionary_encode()
            of = np.repeat(np.arange(b.num_rows), np.diff(first))
            code = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            start, end, period = find(code, of, min_words, exponent)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, end, -1)
            kept = np.cumsum(change[:-1]) == 0
            upto = np.concatenate([[0], np.cumsum(kept)])[first]
            lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), words.filter(pa.array(kept)).cast(pa.string()))
            text_of = of[start] if len(start) else start
            cols = [start - first[text_of], end - start, period]
            structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["start", "length", "period"])
            offsets = np.searchsorted(text_of, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.ListArray.from_arrays(pa.array(offsets), structs), pc.binary_join(lists, " ")],
                names=[*names, runs, collapsed])

    return docs.select(*names).mapInArrow(run, schema)


def longest(runs: Column) -> Column:
    """The run of greatest length; ties: smallest start, then period. Null if there is none."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("k"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(order)


def written(runs: Column) -> Column:
    """`start,length,period` and a line feed for every run."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, chosen by the id's crc32, the words from a place on repeat with a period,
    both set by the same number. The other texts stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def tail(w: Column, s: Column) -> Column:
        return F.transform(F.sequence(s["a"], s["n"] - 1), lambda i: F.element_at(w, (s["a"] + (i - s["a"]) % s["p"] + 1).cast("int")))

    def changed(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        # arrays of one element bind what the lambdas read often
        facts = F.array(F.struct(n.alias("n"), a.alias("a"), (F.floor((n - a) / (3 + g % 8)).cast("long") + 1).alias("p")))
        done = F.transform(facts, lambda s: F.array_join(F.concat(F.slice(w, 1, s["a"].cast("int")), tail(w, s)), " "))
        return F.when(n > 0, F.element_at(done, 1)).otherwise(F.lit(""))

    text = F.col("text").cast("string")
    new = F.element_at(F.transform(F.array(words_of(F.coalesce(text, F.lit("")))), changed), 1)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(h % 10 == 0, new).otherwise(text).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Runs of every text after ``with_repeated_tails``, as counts, the longest run and digests."""
    found = find_runs(with_repeated_tails(docs))
    top = F.col("top")
    return found.select("doc_id", "runs", "collapsed", longest(F.col("runs")).alias("top")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.floor(top["length"] * 1000 / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(written(F.col("runs")), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
