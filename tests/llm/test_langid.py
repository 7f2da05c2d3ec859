import numpy as np
import pytest
from pyspark.sql import functions as F

from doseframe.llm import langid
from doseframe.llm.common import bucket5
from doseframe.llm.queries import QUERIES


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    model = langid.LanguageModel(["a", "b", "c"], hidden=3)
    for part in model.parts():
        part[...] = rng.normal(0, 0.5, part.shape)
    x, y = rng.integers(97, 101, (7, 5)), np.array([0, 1, 2, 0, 1])

    def loss():
        logs = model.log_probs(x).astype(np.float64)
        return -logs[:, y, np.arange(5)].mean()

    for part, grad in zip(model.parts(), model.gradients(x, y)):
        for at in [np.unravel_index(np.abs(grad).argmax(), grad.shape), tuple(0 for _ in part.shape)]:
            was = part[at]
            part[at] = was + 0.01
            up = loss()
            part[at] = was - 0.01
            down = loss()
            part[at] = was
            assert (up - down) / 0.02 == pytest.approx(grad[at], abs=2e-3)


def test_held_out_accuracy(spark):
    rows = QUERIES["op6_language"](spark, "/root/testdata/sf0.01").toPandas()
    true = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = rows.merge(true, on="doc_id")
    assert len(rows) == len(true) and rows.score.between(0, 1).all()
    held = both[both.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() >= 0.97


def test_sample_is_the_lowest_hashes_of_all_tasks(table):
    docs = table([(i, f"text {i % 300} of words") for i in range(900)], parts=7)
    got = sorted(r.piece for r in langid.training_windows(docs, "text", "lang", 50, 1).collect())
    every = docs.select(F.xxhash64("text").alias("h"), "text").collect()
    assert got == sorted(t for _, t in sorted(map(tuple, every))[:50])


def test_defined_results(spark, table):
    docs = table([(i, t) for i, t in enumerate(["the and of that", "und der die das"] * 30)])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    model = langid.fit_language_model(docs.where(bucket5(F.col("doc_id")) != 0), steps=40)
    assert model.langs == ["de", "en"]
    asked = table([(1, None), (2, ""), (3, "12 - 34"), (4, "the and of " * 30_000), (5, "und der die"), (5, "und der die"), (None, "of that")])
    got = sorted((r.doc_id or 0, r.lang_pred, sum(r.position_counts.values())) for r in langid.identify_language(asked, model).collect())
    assert got == [(0, "en", 7), (1, "und", 0), (2, "und", 0), (3, "und", 0), (4, "en", 330_000), (5, "de", 11), (5, "de", 11)]
    assert langid.fit_language_model(table([])) is None
    assert [r.lang_pred for r in langid.identify_language(asked, None).collect()] == ["und"] * 7
    assert langid.identify_language(table([]), model).collect() == []
