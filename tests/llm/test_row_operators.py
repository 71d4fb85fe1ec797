import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotile.llm import chunk_fingerprint, langid, pii, sentencepiece_codec, toxicity
from chronotile.llm.lattice import Vocabulary, load_pieces


def spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


FRAGMENTS = ["a@b.c", "_d@e.f.", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "0000255.1.2.3",
             "+49 (30) 1234.567-8", "+1234567", "++12 34 56 78 9", "😀", "é", " ", "\n", "x@y", "@@", "..", "-", "DE89 3704 0044 0532 0130 00 ",
             "123-45-6789", " ssn ", "9", "."]


def test_pii_against_brute_force(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(FRAGMENTS) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    texts += [None, "", "a" * 50000, "a@b" + ".c" * 30000, "1 " * 30000, "a@b.co " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for i, t in enumerate(texts):
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in spans(t or ""))
        r = got[i]
        assert ",".join(x for x in r.spans.split(",") if x.split(":")[0] in pii.BASE) == want
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want.split(",")) for k in pii.BASE]
        out, pos = [], 0
        for a, b, k in sorted((int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in r.spans.split(",") if x):
            if a >= pos:
                out += [t[pos:a], f"<{k.upper()}>"]
            pos = max(pos, b)
        if t is None:
            assert red[i] is None
        elif len({x.split(":")[0] for x in r.spans.split(",")}) <= 1:
            assert red[i] == "".join(out) + t[pos:]


def test_pii_added_kinds_and_scores(spark):
    df = spark.createDataFrame([(1, "my iban DE89370400440532013000 ok"), (2, "DE89370400440532013001"), (3, "ssn 123-45-6789"), (4, "123-45-6789")],
                               "doc_id long, text string")
    got = {r.doc_id: (r.n_iban, r.n_ssn, r.scores) for r in pii.report(df).collect()}
    assert got == {1: (1, 0, "1.00"), 2: (0, 0, ""), 3: (0, 1, "0.80"), 4: (0, 0, "")}


def test_pii_ibans_beside_other_words(spark):
    a, b = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    texts = [f"IBAN {a} BIC COBADEFFXXX", "DE89370400440532013000 2024-01-02", f"{a} {b} 7", f"{a} 12 NO9386011117947",
             f"AT12 {a}", f"AT12 {a} {b}", a[:-1], a + "X", f"MA64 0115 1900 0001 2050 0053 4921 {b}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("iban")] for r in pii.report(df).collect()}
    want = [[a], ["DE89370400440532013000"], [a, b], [a, "NO9386011117947"], [a], [a, b], [], [], ["MA64 0115 1900 0001 2050 0053 4921", b]]
    assert [[t[s:e] for s, e in got[i]] for i, t in enumerate(texts)] == want
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert red[0] == "IBAN <IBAN> BIC COBADEFFXXX" and red[2] == "<IBAN> <IBAN> 7" and red[5] == "AT12 <IBAN> <IBAN>"


def test_pii_context_reaches_across_matches(spark):
    listed = "SSN: 123-45-6789, 234-56-7890, 345-67-8901"
    texts = [listed, listed + ", 456-78-9012", "123-45-6789, 234-56-7890, 345-67-8901 are ssn", "ssn 😀 123-45-6789\n😀234-56-7890",
             "call +4930123456, +4930123457", "1.2.3.4 5.6.7.8 host", "DE89370400440532013000, GB82WEST12345698765432 konto",
             "GB82WEST12345698765432" + "." * 35 + "konto", "GB82WEST12345698765432" + "." * 36 + "konto",
             "ssn" + "." * 37 + "123-45-6789", "ssn" + "." * 38 + "123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.scores) for r in pii.report(df).collect()}
    for i, t in enumerate(texts):
        want = []
        for k, (kind, pattern, lift) in enumerate([("ip", r"(?:\d+\.){3}\d+", ("host", 0.6, 0.3)), ("phone", r"\+\d+", ("call", 0.6, 0.3)),
                                                   ("iban", r"[A-Z]{2}\d\d[A-Z0-9]{18}", ("konto", 0.9, 0.1)), ("ssn", r"\d{3}-\d\d-\d{4}", ("ssn", 0.3, 0.5))]):
            for m in re.finditer(pattern, t):
                near = f"{t[max(0, m.start() - 40):m.start()]} {t[m.end():m.end() + 40]}".lower()
                score = lift[1] + lift[2] * (lift[0] in near)
                if score >= 0.5:
                    want.append((f"{kind}:{m.start()}:{m.end()}", f"{score:.2f}"))
        assert got[i] == (",".join(w[0] for w in want), ",".join(w[1] for w in want))
    assert got[0][0].count("ssn") == 3 and pii.redact(df.where("doc_id = 0")).first().text == "SSN: <SSN>, <SSN>, <SSN>"


def test_forward_total_equals_sum_over_segmentations(spark):
    vocab = Vocabulary(load_pieces(sentencepiece_codec.MODEL))
    w = sentencepiece_codec.rank_weights(vocab, 1.0)

    def brute(t):
        s, f = t.replace(" ", "▁"), [1.0] + [0.0] * len(t)
        for e in range(1, len(t) + 1):
            for j in range(max(0, e - vocab.longest), e):
                if s[j:e] in vocab.by_text:
                    f[e] += f[j] * w[vocab.by_text[s[j:e]]]
                elif e - j == 1:
                    f[e] += f[j] * w[vocab.byte_ids[0]] ** len(t[j:e].encode())
        return math.log(f[-1])

    texts = ["Hello  world", "the quick the quick", "日本語 😀 x", " lead", "a" * 70, "éèß\n\t."]
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    ll = langid.log_likelihoods(vocab, np.frombuffer("".join(texts).encode(), np.uint8), off, w[None, :])[:, 0]
    assert np.allclose(ll, [brute(t) for t in texts])


def test_sentencepiece_round_trip_reproducible_and_distribution(spark, documents, odd):
    for df in (documents, odd):
        r = sentencepiece_codec.round_trip(df).collect()
        again = sentencepiece_codec.round_trip(df.repartition(5)).collect()
        assert len(r) == df.count() and all(x.lossless for x in r)
        assert sorted(map(str, r)) == sorted(map(str, again))
    enc = sentencepiece_codec.encode(odd)
    back = sentencepiece_codec.decode(enc.drop("text"))
    assert sorted(str(x.text) for x in back.collect()) == sorted(str(x.text) for x in odd.collect())
    assert enc.columns == [*odd.columns, "piece_ids", "log_prob"] and sentencepiece_codec.encode(odd.limit(0)).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the cat").alias("text"))
    rows = sentencepiece_codec.encode(many).groupBy("piece_ids").agg(F.count("*").alias("n"), F.first("log_prob").alias("p")).collect()
    for x in rows:  # shares follow the chances
        p = math.exp(x.p)
        assert abs(x.n / 3000 - p) < 5 * math.sqrt(p * (1 - p) / 3000) + 1e-3


def test_langid_held_out_accuracy_and_odd_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs.where(~held))
    r = langid.predict(docs.where(held), model).where("lang is not null and lang_pred <> 'und'")
    assert r.where("lang = lang_pred").count() >= 0.95 * r.count()
    out = {x.doc_id: x for x in langid.predict(odd.select("doc_id", "text"), model).collect()}
    assert out[2].lang_pred == out[3].lang_pred == "und" and out[2].score == 0.0 and 0 <= out[1].score <= 1
    none = langid.train(docs.limit(0))
    assert {x.lang_pred for x in langid.predict(odd.select("doc_id", "text"), none).collect()} == {"und"}


def test_toxicity_held_out_and_edge_cases(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.train(docs, labels, ~held)
    r = toxicity.score(docs.where(held).select("doc_id", "text"), model).join(labels, "doc_id").toPandas()
    assert (r[r.toxic == 1].score >= 0.7).mean() >= 0.7 and (r[r.toxic == 0].score >= 0.7).mean() <= 0.03
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    empty = toxicity.train(odd.limit(0), labels.limit(0))
    assert toxicity.score(odd.select("doc_id", "text"), empty).where("score >= 0.7").count() == 0


def test_fingerprints_against_neighbours(spark, documents, odd):
    def check(df):
        rows = sorted(((math.inf if r.doc_id is None else r.doc_id), r.text or "") for r in df.collect())
        got = sorted(chunk_fingerprint.compare_next(df, 3).collect(), key=lambda r: math.inf if r.doc_id is None else r.doc_id)
        return rows, got

    rows, got = check(documents)
    for i, (r, (_, t)) in enumerate(zip(got, rows)):
        after = rows[(i + 1) % len(rows)][1]
        new = chunk_fingerprint.edited(t, after)
        a, b, c = chunk_fingerprint.chunk_sets([t.encode(), new.encode(), after.encode()])
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and r.n_chars == len(t)
        assert r.fingerprint == chunk_fingerprint.written(a) and r.edited_fingerprint == chunk_fingerprint.written(b)
        assert r.near_edited == pytest.approx(chunk_fingerprint.likeness(a, b)) and r.near_next == pytest.approx(chunk_fingerprint.likeness(a, c))
    rows, got = check(odd)
    assert len(got) == len(rows) and chunk_fingerprint.compare_next(odd.limit(0)).count() == 0
    assert chunk_fingerprint.compare_next(odd.limit(1)).first().near_next == 1.0


def test_chunks_cover_text_and_survive_a_shift():
    rnd = random.Random(1)
    t = bytes(rnd.choice(b"abcdefghij klmnop") for _ in range(20000))
    a, b = chunk_fingerprint.chunk_sets([t, b"shift " + t])
    assert chunk_fingerprint.likeness(a, b) > 0.95 and max(a.values()) <= chunk_fingerprint.MAX_SIZE
