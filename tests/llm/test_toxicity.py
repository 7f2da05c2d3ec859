import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from doseframe.llm import toxicity as tox
from doseframe.llm.queries import QUERIES


def corpus(n=300, seed=4):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6):x}" for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["idiot", "scumbag", "Moronic"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark, table):
    docs, labels = corpus()
    labels += [(None, 1), (3, None), (9999, 1), (0, 0)]
    return tox.fit_toxicity(table(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_texts(learned):
    docs, labels = corpus(seed=9)
    right = [(learned.score(text.encode())[0] >= 0.5) == bool(y) for (_, text), (_, y) in zip(docs, labels)]
    assert np.mean(right) > 0.97


def test_index_is_exact(learned):
    vectors = [learned.vector({i: n for i, n in enumerate(row) if n}) for row in np.random.default_rng(2).poisson(0.4, (500, len(learned.idf))).tolist()]
    vectors = [v for v in vectors if len(v[0])]
    index = tox.BlockMaxIndex(vectors, len(learned.idf))
    dense = np.zeros((len(vectors), len(learned.idf)))
    for row, (terms, weights) in zip(dense, vectors):
        row[terms] = weights
    for i, (terms, weights) in enumerate(vectors):
        found = index.nearest(terms, weights, 15)
        cosine = dense @ dense[i]
        assert found.similarity == pytest.approx(np.sort(cosine)[::-1][:15])
        left = index.nearest(terms, weights, 15, leave=i)
        assert i not in left.examples and left.similarity == pytest.approx(np.sort(np.delete(cosine, i))[::-1][:15])


def test_word_index_is_exact():
    rng = np.random.default_rng(5)
    dense = rng.poisson(0.3, (700, 40)) * rng.random(40)
    dense[300:340] = dense[100]  # ties
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    vectors = [(np.flatnonzero(row), row[np.flatnonzero(row)]) for row in dense]
    index = tox.WordIndex(vectors, 40, block=32)
    for i in range(0, 700, 7):
        cosine = dense @ dense[i]
        want = np.lexsort((np.arange(700), -cosine.round(9)))[:15]
        found = index.nearest(*vectors[i], 15)
        want = want[cosine[want] > 0]
        assert found.similarity == pytest.approx(cosine[want]) and found.examples.tolist() == want.tolist()
        cosine[i] = 0
        left = index.nearest(*vectors[i], 15, leave=i)
        assert i not in left.examples and left.similarity == pytest.approx(np.sort(cosine)[::-1][: len(left.similarity)])


def test_scores_of_texts_without_chosen_words(spark, table):
    """Neighbours, votes and scores by the plain formula, from the texts alone."""
    docs, labels = corpus(n=120, seed=2)
    model = tox.fit_toxicity(table(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = {str(i): tox.counted(t.encode()) for i, t in docs}
    label = {str(i): y for i, y in labels}
    known = set().union(*texts.values())
    df = {w: sum(w in t for t in texts.values()) for w in known}

    def vector(words):
        v = {w: np.sqrt(n) * (np.log((1 + len(docs)) / (1 + df[w])) + 1) for w, n in words.items() if w in known}
        if others := sum(n for w, n in words.items() if w not in known):
            v[None] = np.sqrt(others)
        length = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    vectors = {i: vector(t) for i, t in texts.items()}
    asked = [t for _, t in corpus(n=20, seed=2)[0]] + ["unseen " * 3 + docs[1][1]]
    compared = 0
    for text in asked:
        counts = tox.counted(text.encode())
        if model.speaks(model.vector(model.features.of(counts))[0]):
            continue
        compared += 1
        mine = vector(counts)
        cosine = {i: sum(x * v.get(w, 0) for w, x in mine.items()) for i, v in vectors.items()}
        nearest = sorted((c for c in cosine.values() if c > 0), reverse=True)[: tox.NEIGHBOURS]
        score, evidence = model.score(text.encode())
        assert [s for _, s, _ in evidence] == pytest.approx([min(1, c) for c in nearest])
        assert all(cosine[i] == pytest.approx(s) and label[i] == y for i, s, y in evidence)
        weights = [1 / (0.05 + np.sqrt(max(0, 2 - 2 * s))) for _, s, _ in evidence]
        vote = sum(w * y for w, (_, _, y) in zip(weights, evidence)) / sum(weights) - 0.5
        a, b, c = model.word_curve
        assert score == pytest.approx(1 / (1 + np.exp(-(a + b * vote + c * vote * nearest[0]))), abs=1e-6)
    assert compared >= 10


def test_sample_is_bounded_by_bytes(spark, table, monkeypatch):
    docs, labels = corpus(n=60)
    asked = spark.createDataFrame(labels, "doc_id long, toxic int")
    whole = tox.example_rows(table(docs), asked, "doc_id", "text").collect()
    assert len(whole) == 60
    monkeypatch.setattr(tox, "SAMPLE_BYTES", sum(len(r.raw) for r in whole) // 2)
    part = tox.example_rows(table(docs), asked, "doc_id", "text").collect()
    assert 10 < len(part) < 50 and sum(len(r.raw) for r in part) <= tox.SAMPLE_BYTES
    assert {r.raw for r in part} <= {r.raw for r in whole}


def test_rejected_rows_leave_clashing_columns_alone(table, learned):
    rows = table([(1, "quite plain"), (2, "you idiot idiot scumbag")]).withColumn("Score", F.lit(0.25)).withColumn("evidence", F.lit("mine"))
    assert [(r.doc_id, r.Score, r.evidence) for r in tox.remove_toxic(rows, learned).collect()] == [(1, 0.25, "mine")]


def test_defined_results(spark, table, learned):
    asked = [(1, None), (2, ""), (3, "quite plain"), (4, "you idiot"), (4, "you idiot"), (None, "idiot " * 50_000)]
    rows = tox.score_toxicity(table(asked).withColumnRenamed("lang", "SCORE"), learned).collect()
    by = {}
    for r in rows:
        assert 0 <= r.score <= 1 and all(0 < e.similarity <= 1 for e in r.evidence)
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(scores) == 1 for scores in by.values()) and by[1] == by[2] == by[3] and max(by[4]) >= 0.5 > max(by[1])
    assert sorted(r.doc_id for r in tox.remove_toxic(table(asked[:5]), learned).collect()) == [1, 2, 3]
    assert tox.score_toxicity(table([]), learned).collect() == []


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1)]])
def test_too_few_labels(spark, table, labels):
    model = tox.fit_toxicity(table([(1, "a text"), (2, "another")]), spark.createDataFrame(labels, "doc_id long, toxic int"))
    want = float(np.mean([y for _, y in labels])) if labels else 0.0
    assert {r.score for r in tox.score_toxicity(table([(5, "x"), (6, None)]), model).collect()} == {want}


def test_query_on_held_out_labels(spark):
    rows = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    held = rows.where("held_out").join(labels, "doc_id").toPandas()
    assert rows.count() == 10_000 and len(held) > 500
    assert held[held.toxic == 1].predicted.mean() > 0.85 and held[held.toxic == 0].predicted.mean() < 0.01
