"""The stages against plain versions, each on what the one before it kept."""

import numpy as np
import public_tokenizers
from brute import contamination, jaccard
from test_line_dedup import brute as line_brute
from tokenizers import Tokenizer

import corpus_pipeline
from doseframe.llm.queries import table, toxicity_model

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    for df in seen[:-1]:
        assert df.columns == docs.columns
    model = toxicity_model(spark, docs, SF)
    clean = [(d, t) for d, t in pairs(seen[0]) if model.score((t or "").encode())[0] < 0.5]
    assert sorted(pairs(seen[1])) == sorted(clean)
    assert sorted(pairs(seen[2])) == sorted((d, t) for d, t, _, _ in line_brute(pairs(seen[1])))
    assert all(r.n_chars == len(r.text) for r in seen[2].collect())
    before = pairs(seen[2])
    keep = {d for (d, n, c, _) in jaccard(before, threshold=80, shingle=5) if n == 0 or d == c}
    assert sorted(pairs(seen[3])) == sorted((d, t) for d, t in before if d in keep)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {d for d, n, hit, _ in contamination(pairs(seen[3]), items) if hit and 20 * hit >= n}
    assert sorted(pairs(seen[4])) == sorted((d, t) for d, t in pairs(seen[3]) if d not in bad)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in seen[5].collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= 200
