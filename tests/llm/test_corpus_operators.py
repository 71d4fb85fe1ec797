import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chronotile.llm import ann, lm_score, mixing, sharding, simhash


def brute_scores(texts, order):
    toks = [re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]

    def count(w):
        c = Counter()
        for n in range(1, order + 1):
            c.update(tuple(w[i - n + 1:i + 1]) for i in range(n - 1, len(w)))
        return c

    own = [count(w) for w in toks]
    every, total = sum(own, Counter()), sum(map(len, toks))

    def s(g, o, m):
        c = every[g] - o[g]
        if len(g) == 1:
            return max(c, 0.4 if c <= 0 else 0) / m
        return c / (every[g[:-1]] - o[g[:-1]]) if c > 0 else 0.4 * s(g[1:], o, m)

    return [sum(math.log(s(tuple(w[max(0, i - order + 1):i + 1]), o, max(total - len(w), 1))) for i in range(len(w))) for w, o in zip(toks, own)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stupid_backoff(spark, documents, odd, order):
    for df in (documents, odd):
        rows = df.select("doc_id", "text").collect()
        got = sorted((r.doc_id or -1, round(r.log_score, 6)) for r in lm_score.score(df, order).collect())
        want = brute_scores([r.text or "" for r in rows], order)
        want = sorted((r.doc_id or -1, round(x, 6)) for r, x in zip(rows, want))
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-5)
    assert lm_score.score(odd.limit(0)).count() == 0


def test_lm_score_matches_its_sql(spark, documents, odd, tmp_path):
    import duckdb
    from chronotile.llm.oracle import LM_SCORE
    from chronotile.llm.registry import op1_lm_score
    from tools.check_oracle import digest

    for i, df in enumerate((documents, odd.select("doc_id", "text"), odd.limit(0))):
        sf = str(tmp_path / str(i))
        df.write.parquet(f"{sf}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
        rel = con.sql(LM_SCORE)
        want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
        got = [r.asDict() for r in op1_lm_score(spark, sf).collect()]
        assert digest(got, sorted(rel.columns))[0] == digest(want, sorted(rel.columns))[0]


def test_ann_recall_and_exact_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    r = ann.search(rows, rows.where("vec_id % 20 = 0")).toPandas()
    p = rows.toPandas()
    x, ids, hits = np.array(p.embedding.tolist(), float), p.vec_id.to_numpy(), []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -9
        mine = r[r.query_id == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine.score, [s[np.flatnonzero(ids == v)[0]] for v in mine.vec_id])
        hits.append(len(set(ids[np.lexsort((ids, -s))[:20]]) & set(mine.vec_id)) / 20)
    assert np.mean(hits) >= 0.9


def test_ann_exact_when_all_lists_are_probed_with_ties_and_odd_rows(spark):
    e = spark.createDataFrame(
        [(1, None), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (40, [None, 1.0]),
         (60, [0.5, 2.0]), (7, [1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.search(e, e.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 3, 1.0), (20, 2, 60, 0.5), (60, 1, 3, 0.5), (60, 2, 20, 0.5)]
    assert ann.search(e.limit(0), e.limit(0)).count() == 0
    many = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(100)], "vec_id long, embedding array<float>")
    got = ann.search(many, many.where("vec_id = 40")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))


@pytest.mark.parametrize("norm", [1e4, 1e20, 1e-20])
def test_ann_one_row_of_far_norm_leaves_the_others_exact(spark, norm):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 24))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    x[7] *= norm
    x = x.astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    r = ann.search(rows, rows.where("vec_id % 20 = 0"), lists=1).toPandas()
    hits = []
    for q in range(0, 600, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(set(np.argsort(-s)[:20]) & set(r[r.query_id == q].vec_id)) / 20)
    assert np.mean(hits) >= 0.99


def test_ann_many_ties_keep_the_smallest_ids(spark):
    rows = spark.createDataFrame([(1000 - i, [1.0, float(i)]) for i in range(1, 301)] + [(2000, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = ann.search(rows, rows.where("vec_id = 2000"), lists=1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 1.0) for i in range(700, 720)]


def brute_components(fps, bits):
    part = list(range(len(fps)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1:]) <= bits) + i + 1:
            a, b = root(i), root(j)
            part[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("cell_rows", [4096, 16])
def test_simhash_links_against_all_pairs(spark, cell_rows):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = np.concatenate([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 300), dtype=np.uint64)) for k in (1, 2, 4, 6)])
    hot = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, near, hot]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = [(r.u, r.v) for r in simhash.links(df, cell_rows=cell_rows).collect()]
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    for u, v in links:
        assert bin((u ^ v) & ((1 << 64) - 1)).count("1") <= 4
    part = list(range(len(fps)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for u, v in links:
        a, b = root(at[u]), root(at[v])
        part[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(fps))] == brute_components(fps, 4)


def test_simhash_components_and_keep_one(spark, documents, odd):
    for df in (documents, odd):
        r = simhash.components(df).toPandas()
        fps = np.unique(r.fp.to_numpy().view(np.uint64))
        group = dict(zip(fps.view(np.int64).tolist(), brute_components(fps, 4)))
        r["g"] = [group[x] for x in r.fp]
        want = r.groupby("g").doc_id.transform("min")
        assert len(r) == df.count() and (want.fillna(-1) == r.component_id.fillna(-1)).all()
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns and kept.count() == r.g.nunique()
    assert simhash.components(odd.limit(0)).count() == 0
    assert simhash.fingerprint(b"  \n") == 0 and simhash.fingerprint(b"A b") == simhash.fingerprint(b"a  B")


def test_mixing_meets_targets(spark, documents, odd):
    r = mixing.mix(documents).toPandas()
    again = mixing.mix(documents.repartition(7)).toPandas()
    assert r.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    words = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in documents.collect()}
    assert dict(zip(r.doc_id, r["size"])) == words and (r.taken <= 3 * r["size"]).all()
    per = r.groupby("source").agg(words=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    target, free, w = np.zeros(len(per)), np.ones(len(per), bool), np.array([(5, 2, 1)[i % 3] for i in range(len(per))], float)
    while True:
        target[free] = (per.words.sum() - target[~free].sum()) * w[free] / w[free].sum()
        over = free & (target > 3 * per.words)
        if not over.any():
            break
        target[over], free = 3.0 * per.words[over], free & ~over
    assert np.allclose(per.target, target) and (abs(per.taken - per.target) <= per.most / 2 + 1).all()
    taken = mixing.take(documents)
    assert taken.columns == documents.columns and taken.count() == r.copies.sum()
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0
    assert mixing.take(odd).count() == mixing.mix(odd).toPandas().copies.sum()


def test_sharding_sizes_slots_and_groups(spark, documents, odd):
    for df in (documents, odd):
        s, d = sharding.shard(df).toPandas(), df.toPandas()
        assert len(s) == len(d)
        g = s.groupby("shard")
        assert (g.slot.max() + 1 == g.size()).all() and (g.slot.nunique() == g.size()).all()
        if len(d) > 100:
            m = d.merge(s, on="doc_id")
            assert (m.groupby("text").shard.nunique() == 1).all()
            assert (m.text_crc32 == m.text.map(lambda t: zlib.crc32(t.encode()))).all()
            assert g["size"].sum().max() <= 1.02 * max(g["size"].sum().mean(), m.groupby("text")["size"].sum().max())
    assert sharding.shard(odd.limit(0)).count() == 0


def test_best_fit_decreasing():
    assert sharding.best_fit_decreasing([6, 5, 4, 3, 2], capacity=10) == [0, 1, 0, 1, 1]
    assert len(set(sharding.best_fit_decreasing([9] + [1] * 30, shards=4))) == 4


def one_by_one(sizes, capacity):
    room, out = [], []
    for x in sizes:
        fits = [i for i, r in enumerate(room) if r >= x]
        if not fits:
            room.append(max(capacity, x))
        out.append(min(fits, key=lambda i: (room[i], i)) if fits else len(room) - 1)
        room[out[-1]] -= x
    return out


def test_sharding_packs_every_group_by_size(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = sorted(rng.integers(1, 12, 60).tolist(), reverse=True)
        assert sharding.best_fit_decreasing(sizes, capacity=10) == one_by_one(sizes, 10)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 64)
    texts = [f"{i:05d}" + "x" * int(n) for i, n in enumerate(rng.integers(0, 20, 3000))] + ["same"] * 500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = Counter()
    for t in texts:
        group[t] += len(t) + 1
    sizes = sorted(group.values(), reverse=True)
    for kind, want in (({"capacity": 4000}, one_by_one(sizes, 4000)), ({"shards": 5}, sharding.best_fit_decreasing(sizes, 5))):
        got = sharding.assign(docs, **kind).collect()
        assert len(got) == len(texts) and len({(r.key, r.check, r.shard) for r in got}) == len(group)
        bins = {texts[r.doc_id]: r.shard for r in got}
        assert Counter((group[t], b) for t, b in bins.items()) == Counter(zip(sizes, want))
