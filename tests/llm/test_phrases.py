import random

import pytest
from brute import repeats

from doseframe.llm.phrases import remove_repeats


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


def corpus(seed, window):
    rng = random.Random(seed)

    def text(n, kinds=500):
        return [f"w{rng.randrange(kinds)}" for _ in range(n)]

    passage = text(window * 3)
    docs = []
    for i in range(30):
        cut = rng.randrange(0, window * 2)
        part = passage[cut : cut + rng.randrange(window - 3, window * 2)]
        docs.append((i, " ".join(text(rng.randrange(0, 60)) + part + text(rng.randrange(0, 60)))))
    docs += [(100, docs[0][1]), (101, docs[0][1] + " more"), (102, " ".join(passage * 3)), (103, " ".join(text(200, 2))), (104, "a b " * window)]
    docs += [(105, None), (106, ""), (107, " \t\n"), (None, docs[3][1]), (1, docs[1][1]), (1, docs[1][1])]
    return docs


@pytest.mark.parametrize("window", [35, 12, 5, 1])
def test_matches_brute_force(table, window):
    docs = corpus(window, window)
    assert found(remove_repeats(table(docs), window=window)) == sorted(repeats(docs, window), key=str)


def test_no_rows_and_clashing_columns(table):
    assert found(remove_repeats(table([]))) == []
    out = remove_repeats(table([(1, "a b")]).withColumnRenamed("lang", "KEPT"))
    assert out.columns == ["doc_id", "text", "source", "n_chars", "n_words", "n_removed", "kept"]
    assert found(out) == [(1, 2, 0, "a b")]


def test_a_passage_in_all_rows(table):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, f"only{i} {passage} tail{i}") for i in range(500)]
    assert {(r.n_removed, r.kept) for r in remove_repeats(table(docs)).collect() if r.doc_id == 7} == {(60, "only7 tail7")}
