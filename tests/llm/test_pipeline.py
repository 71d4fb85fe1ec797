"""The pipeline against its operators run one after another, and its stages on odd rows."""

from collections import Counter

import corpus_pipeline
from chronotile.llm import mixing, pii, sentencepiece_codec, simhash


def test_stages_and_run(spark, sf_small, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "sentencepiece"]
    out = corpus_pipeline.run(spark, sf_small).toPandas()
    step = corpus_pipeline.drop_toxic(spark, documents, sf_small).checkpoint()
    assert step.columns == documents.columns
    step = simhash.keep_one(step).checkpoint()
    comp = simhash.components(step)
    assert comp.count() == comp.select("component_id").distinct().count()
    step = mixing.take(pii.redact(step)).checkpoint()
    want = sentencepiece_codec.encode(step).select("doc_id", "piece_ids").collect()
    assert Counter((r.doc_id, tuple(r.piece_ids)) for r in want) == Counter(zip(out.doc_id, map(tuple, out.piece_ids)))


def test_stages_on_odd_rows(spark, sf_small, odd):
    for rows in (odd, odd.limit(0)):
        docs = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, sf_small).checkpoint()
            assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == odd.columns
        assert rows is not odd or docs.count() > 0
