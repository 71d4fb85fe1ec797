"""Merkle manifest, periodic runs and sequence packing against plain restatements."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from chronotile.llm import merkle, runs, sequence_packing


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(t):
    return t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain_tree(digests, k):
    """(top, for each leaf its runs and slots from the leaf up)."""
    paths, at, row = [[] for _ in digests], list(range(len(digests))), digests
    while len(row) > 1:
        for p, i in zip(paths, at):
            p.append((row[i // k * k:i // k * k + k], i % k))
        at, row = [i // k for i in at], [H(*row[b:b + k]) for b in range(0, len(row), k)]
    return row[0], paths


def plain_manifest(rows, k=16):
    groups = defaultdict(list)
    for r in rows:
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        leaf, other = (H(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, t))) for t in (r.text, lower(r.text) if hit else r.text))
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf, other, r.doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    if not names:
        return []
    for s in names:
        groups[s].sort()
    trees = [plain_tree([x[2] for x in groups[s]], k) for s in names]
    root, upper = plain_tree([t[0] for t in trees], k)
    out = []
    for s, (sub, paths), up in zip(names, trees, upper):
        for (_, _, leaf, other, doc), path in zip(groups[s], paths):
            proof = H(*[d for run, i in path + up for j, d in enumerate(run) if j != i])
            for run, i in path + up:
                other = H(*[other if j == i else d for j, d in enumerate(run)])
            out.append((doc, leaf, sub, root, proof, other, other == root))
    return out


def test_manifest(spark, documents, odd):
    for df in (documents, odd, odd.limit(0), documents.where("doc_id = 5"), documents.withColumns({"tree": documents.text, "pos": documents.lang})):
        got = merkle.verify_manifest(df)
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        got = sorted(map(str, map(tuple, got.collect())))
        assert got == sorted(map(str, plain_manifest(df.collect())))


@pytest.mark.parametrize("arity,n", [(2, 1), (2, 13), (3, 27), (16, 256), (16, 257)])
def test_trees_of_other_arities(spark, arity, n):
    digests = [H(str(i)) for i in range(n)]
    nodes = spark.createDataFrame([("t", i, bytes.fromhex(d)) for i, d in enumerate(digests)], "tree string, pos long, digest binary")
    levels, tops = merkle.build(nodes, arity)
    top, paths = plain_tree(digests, arity)
    assert tops.first()["digest"].hex() == top
    got = merkle.attach_paths(nodes, levels, arity).select("pos", merkle.fold(nodes.digest, merkle.F.col("path")).alias("f"), "path").collect()
    assert len(got) == n and all(r.f == top for r in got)
    for r in got:
        assert [([bytes(d).hex() for d in e.digests], e.slot) for e in r.path] == paths[r.pos]


def test_positions_over_a_hot_group_split_over_partitions(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, '=a', concat('=', id % 7)) tree", "id").checkpoint()
    got = merkle.positions(rows, ["id"]).toPandas().sort_values(["tree", "id"])
    assert (got.pos == got.groupby("tree").cumcount()).all()
    assert got[got.tree == "=a"].pos.max() == 999


def test_manifest_matches_its_sql(spark, documents, odd, tmp_path):
    import duckdb
    from chronotile.llm.oracle import MERKLE
    from tools.check_oracle import digest

    for i, df in enumerate((documents, odd.drop("fp", "row_key", "score", "size"))):
        df.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{i}/documents.parquet/*.parquet')")
        rel = con.sql(MERKLE)
        want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
        got = [r.asDict() for r in merkle.verify_manifest(df).collect()]
        assert digest(got, sorted(rel.columns))[0] == digest(want, sorted(rel.columns))[0]


def plain_runs(w, min_words=6, exponent=4):
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        k = 0
        while k < n - q:
            e = k
            while e < n - q and w[e] == w[e + q]:
                e += 1
            s, end = k, e + q
            if e > k and end - s >= max(min_words, exponent * q):
                if not any(q % d == 0 and w[s:end - d] == w[s + d:end] for d in range(1, q)):
                    out.append((s, end - s, q))
            k = max(e, k + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_report(r):
    w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
    n = len(w)
    h = None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
    return (r.doc_id, len(found), *top, None if top[0] is None else 1000 * top[1] // top[2],
            H(*[f"{s},{m},{q}\n" for s, m, q in found]), H(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_runs_report(spark, documents, odd):
    short = documents.where("length(text) < 12000")
    for df in (short, odd.where("doc_id is null or doc_id <> 5"), odd.limit(0), odd.withColumnRenamed("fp", "runs").withColumnRenamed("size", "collapsed").limit(2)):
        got = sorted(str(tuple(r)) for r in runs.report(df).collect())
        assert got == sorted(str(plain_report(r)) for r in df.select("doc_id", "text").collect())
    assert sum(r.n_runs for r in runs.report(short).collect()) > 10


def test_runs_of_random_words_match_brute_force():
    rng = random.Random(3)

    def text():
        w = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p, m = [rng.randrange(7) for _ in range(rng.randint(1, 8))], rng.randint(2, 40)
            w += (p * m)[:m]
        return w + [rng.randrange(3) for _ in range(rng.randint(0, 10))]

    for _ in range(300):
        docs = [text() for _ in range(rng.randint(1, 8))]
        off = list(itertools.accumulate(map(len, docs), initial=0))
        want = [(s + o, s + o + m, q) for d, o in zip(docs, off) for s, m, q in plain_runs(d)]
        words = np.array([x for d in docs for x in d], np.int64)
        got = runs.find(words, np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
        assert list(zip(*(x.tolist() for x in got))) == want


def test_runs_of_long_texts():
    n = 200_000
    for words, want in ((np.zeros(n, np.int64), (0, n, 1)), (np.arange(n) % 3, (0, n, 3)),
                        (np.random.default_rng(0).integers(0, 9999, 5000)[np.arange(n) % 5000], (0, n, 5000))):
        s, e, q = runs.find(words, np.zeros(n, np.int64))
        assert list(zip(s.tolist(), e.tolist(), q.tolist())) == [want]


def test_ids_equal_the_tokenizers(documents, odd):
    from tokenizers import Tokenizer

    with open(sequence_packing.tokenizer_path(), encoding="utf-8") as f:
        spec = f.read()
    plain, encoder = Tokenizer.from_str(spec), sequence_packing.Encoder(spec)
    extra = ["  a  b ", "Ünïcode x y é ́z ΣΑΣ it's don't 123 <|endoftext|> x\x0by\x0cz <|startoftext|>q", "İ I ﬁ", "z" * 5000, " 　"]
    texts = [r.text for df in (documents, odd) for r in df.select("text").collect()] + extra
    for _ in range(2):  # the second time from what is known
        ids, first = encoder.ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [plain.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def bins_of(plan):
    out = defaultdict(list)
    for size, first, n, b, per_bin, place in plan.runs:
        for i in range(n):
            out[b + i // per_bin].append((place + i % per_bin * size, size))
    for rows in out.values():
        at = 0
        for place, size in sorted(rows):
            assert place == at
            at += size
        assert at <= plan.capacity
    return out


def fewest_bins(sizes, capacity):
    """Exact, by depth-first search over bin contents."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, rooms[:k] + (rooms[k] - sizes[i],) + rooms[k + 1:])
        place(i + 1, rooms + (capacity - sizes[i],))

    place(0, ())
    return best[0]


def test_plan_places_everything_and_dominance_keeps_the_optimum():
    rng = random.Random(5)
    for _ in range(300):
        c = rng.choice([10, 20, 50])
        sizes = [rng.randint(1, c) if rng.random() < 0.6 else rng.randint(max(1, c // 4), c // 2) for _ in range(rng.randint(1, 9))]
        counts = {s: sizes.count(s) for s in sizes}
        plan = sequence_packing.plan_bins(counts, c)
        assert sorted(s for rows in bins_of(plan).values() for _, s in rows) == sorted(sizes)
        plan = sequence_packing.Plan(counts, c)
        sequence_packing.reduce_by_dominance(plan)
        left = [s for s in counts for _ in range(int(plan.left[s]))]
        assert plan.bins + (fewest_bins(left, c) if left else 0) == fewest_bins(sizes, c)
    with pytest.raises(ValueError):
        sequence_packing.plan_bins({11: 1}, 10)


def check_packing(rows, docs, ids_of, capacity):
    by_doc = defaultdict(list)
    for r in docs:
        by_doc[r.doc_id].append(sorted((k // capacity, k, len(p), zlib.crc32(np.array(p, "<u4").tobytes()))
                                       for t in [ids_of(r.text)] for k in range(0, len(t), capacity) for p in [t[k:k + capacity]]))
    want = sorted((d if d is not None else -1, *p) for d, texts in by_doc.items() for t in texts for p in t)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        assert [o for o, _ in sorted(parts)] == list(itertools.accumulate([n for _, n in sorted(parts)], initial=0))[:-1]
        assert sum(n for _, n in parts) <= capacity
    return len(fill)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(spark, documents, odd, capacity):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(sequence_packing.tokenizer_path())
    for df in (documents, odd, odd.limit(0), odd.withColumnRenamed("fp", "offset").withColumnRenamed("size", "length")):
        rows = sequence_packing.pack_documents(df, capacity=capacity).collect()
        n = check_packing(rows, df.select("doc_id", "text").collect(), lambda t: plain.encode(t or "", add_special_tokens=False).ids + [0], capacity)
        assert n <= -(-sum(r.length for r in rows) // capacity) + 2


def test_sequences_hold_the_ids(spark, odd):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(sequence_packing.tokenizer_path())
    packed = sequence_packing.pack(sequence_packing.pieces(odd)).checkpoint()
    seqs = {r.sequence_id: r.ids for r in sequence_packing.sequences(packed).collect()}
    texts = defaultdict(list)
    for r in odd.select("doc_id", "text").collect():
        texts[r.doc_id].append(plain.encode(r.text or "", add_special_tokens=False).ids + [0])
    for r in packed.collect():
        assert seqs[r.sequence_id][r.offset:r.offset + r.length] == r.ids
        assert any(t[r.start:r.start + r.length] == r.ids for t in texts[r.doc_id])
