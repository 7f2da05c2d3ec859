import random

import pytest
from brute import contamination

from doseframe.llm import decontaminate as dec


def found(df):
    rows = df.select("doc_id", "n_words", dec.n_hit().alias("n_hit"), "hit_items").collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r.hit_items)) for r in rows), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "ñu", "delta9", "x"]

    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))

    items = [(i, text(n)) for i, n in enumerate([30, 13, 12, 5, 1, 0, 40])]
    items += [(None, text(20)), (7, None), (8, "... --"), (0, text(15))]
    docs = [(i, text(rng.randrange(0, 80))) for i in range(40)]
    docs += [(99, items[7][1] + text(9)), (100, text(30) + items[0][1] + text(30)), (101, items[6][1].upper()), (None, items[1][1]), (102, None), (103, ""), (104, ", .")]
    return docs + docs[:2], items


@pytest.mark.parametrize("set_bytes", [dec.SET_BYTES, 200])
def test_matches_brute_force_in_one_block_and_in_many(spark, table, set_bytes):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = found(dec.find_contamination(table(docs), bench, set_bytes=set_bytes))
    assert got == sorted(contamination(docs, items), key=str)


def test_empty_tables_and_clashing_columns(spark, table):
    none = spark.createDataFrame([], "item_id int, text string")
    docs = table([(1, "a b c"), (2, None)]).withColumnRenamed("lang", "N_WORDS")
    assert found(dec.find_contamination(docs, none)) == [(1, 3, 0, []), (2, 0, 0, [])]
    some = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    assert found(dec.find_contamination(table([]), some)) == []
    assert dec.remove_contaminated(docs, some).columns == docs.columns
    own = table([(2, "c"), (5, "q r")]).withColumnsRenamed({"lang": "N_WORDS", "source": "hit_items"})
    for made in (dec.remove_contaminated(own, some), dec.remove_spans(own, some)):
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, own.collect()))


def test_items_without_id_hit_but_have_no_name(spark, table):
    passage = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(None, passage), (4, " ".join(passage.split()[:13]))], "item_id int, text string")
    got = found(dec.find_contamination(table([(1, "a " + passage), (2, passage[3:])]), bench))
    assert got == [(1, 21, 20, ["4"]), (2, 19, 19, [])]


def test_documents_and_spans_are_removed(spark, table):
    passage = " ".join(f"w{i}" for i in range(13))
    bench = spark.createDataFrame([("q", passage)], "item_id string, text string")
    long = " ".join(f"v{i}" for i in range(400))
    docs = table([(1, "see: " + passage.upper() + "!"), (2, long + " " + passage + "."), (3, long), (4, None)])
    assert sorted(r.doc_id for r in dec.remove_contaminated(docs, bench).collect()) == [2, 3, 4]
    texts = {r.doc_id: r.text for r in dec.remove_spans(docs, bench).collect()}
    assert texts == {1: "see: !", 2: long + " .", 3: long, 4: None}


def test_window_set_is_small_and_compares_words(monkeypatch):
    import pickle

    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(40_000)).encode()
    held = dec.WindowSet([("a", text), ("b", text)], dec.WINDOW)
    # About 80,000 windows: 12 bytes each and 4 for a word, besides the vocabulary.
    assert len(pickle.dumps(held)) < 80_000 * 18
    words = text.split()
    assert held.hits(words[100:113]) == ([(0, 13)], {"a", "b"})
    # Equal hashes of unlike windows are told apart.
    monkeypatch.setattr(dec, "window_hashes", lambda ids, size: dec.np.zeros(max(0, len(ids) - size + 1), dec.np.uint64))
    held = dec.WindowSet([("a", b"x y z"), ("b", b"z y x"), ("c", b"x y z x y z")], 3)
    assert held.hits(b"q x y z q".split()) == ([(1, 4)], {"a", "c"})
    assert held.hits(b"y y z".split()) == ([], set())
