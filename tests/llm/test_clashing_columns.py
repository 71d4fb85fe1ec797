"""Columns that have the names of helper or result columns: kept where they are the caller's, replaced where they are results."""

import corpus_pipeline
from chronotile.llm import langid, mixing, sentencepiece_codec, simhash

HELPERS = ["kept_fp", "kept_id", "fp_of_row", "k_id", "k_source", "k_size", "k_nth", "mix_nth", "mix_copies", "mix_size", "row_key_", "component", "rep", "none"]


def test_helper_names_stay_the_callers(spark, documents):
    docs = documents.where("doc_id < 60").withColumns({c: documents.doc_id * 10 for c in HELPERS})
    for stage in (simhash.keep_one, mixing.take):
        out = stage(docs)
        rows = out.collect()
        assert out.columns == docs.columns and rows
        assert all(r[c] == r.doc_id * 10 for r in rows for c in HELPERS)
    coded = sentencepiece_codec.encode(docs).collect()
    assert len(coded) == 60 and all(r[c] == r.doc_id * 10 for r in coded for c in HELPERS)


def test_result_names_are_replaced(spark, documents):
    docs = documents.where("doc_id < 40").withColumns({c: documents.text for c in ("log_prob", "PIECE_IDS", "score", "lang_pred")})
    plain = {r.doc_id: r for r in sentencepiece_codec.encode(documents.where("doc_id < 40")).collect()}
    got = sentencepiece_codec.encode(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "lang_pred", "piece_ids", "log_prob"]
    assert all(r.piece_ids == plain[r.doc_id].piece_ids and r.log_prob == plain[r.doc_id].log_prob for r in got.collect())
    model = langid.train(documents.where("doc_id < 100"))
    want = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(documents.where("doc_id < 40"), model).collect()}
    out = langid.predict(docs, model)
    assert out.columns[-2:] == ["lang_pred", "score"] and len(set(out.columns)) == len(out.columns)
    assert {r.doc_id: (r.lang_pred, r.score) for r in out.collect()} == want
    none = langid.predict(docs, {**model, "langs": []})
    assert none.columns == out.columns and {r.lang_pred for r in none.collect()} == {"und"}


def test_two_runs_keep_their_results_and_lose_no_text(spark, sf_small):
    first = corpus_pipeline.run(spark, sf_small)
    second = corpus_pipeline.run(spark, sf_small)
    rows = [sorted((r.doc_id, tuple(r.piece_ids), r.decoded_sha256) for r in x.collect()) for x in (first, second)]
    assert rows[0] == rows[1] and rows[0] and first.where("not lossless").count() == 0


def test_decoding_in_slices(spark, odd):
    import pyarrow as pa

    rows = pa.record_batch([pa.array([[1, 2], None, [], [3, 4, 5], [6]], pa.list_(pa.int32()))], names=["p"])
    cut = [x.column("p").to_pylist() for x in sentencepiece_codec._id_slices([rows, rows.slice(0, 0)], "p", 3)]
    assert cut == [[[1, 2], None, []], [[3, 4, 5]], [[6]]]
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(odd.select("doc_id", "text")), text="again")
    assert all(r.again == r.text for r in back.collect())
