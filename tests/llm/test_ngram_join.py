import random

import numpy as np
import pytest
from brute import jaccard

from doseframe.llm import ngram_join as ng


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in df.collect()), key=str)


def corpus(seed=3):
    rng = random.Random(seed)

    def text(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]

    docs, number = [], 0
    for size in (3, 5, 9, 10, 11, 12, 20, 40, 80, 200):
        base = text(size)
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, size // 25))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
            if rng.random() < 0.3:
                words += text(max(1, size // 30))
            docs.append((number := number + 1, " ".join(words)))
    docs += [(501, None), (502, ""), (503, "  \n"), (504, "one"), (505, "ONE"), (506, "one two"), (507, "one  two"), (None, docs[5][1]), (2, docs[1][1]), (2, docs[1][1])]
    return docs


def test_matches_all_pairs(table):
    docs = corpus()
    want = []
    for doc, n, component, links in jaccard(docs):
        want.append((doc, n, doc if n == 0 else component, links))
    assert found(ng.jaccard_components(table(docs))) == sorted(want, key=str)


def test_blocks_give_the_same_components(table, monkeypatch):
    monkeypatch.setattr(ng, "BLOCK_NODES", 3)
    docs = corpus(9)
    want = [(doc, n, doc if n == 0 else component, links) for doc, n, component, links in jaccard(docs)]
    assert found(ng.jaccard_components(table(docs))) == sorted(want, key=str)


def test_sets_meet_only_blocks_of_like_sizes(spark, monkeypatch):
    """Bands of sizes 10 to 10,240 with two blocks each: a set goes to those of its band and of neighbouring ones."""
    monkeypatch.setattr(ng, "BLOCK_NODES", 3)
    rows = [(1, number, 10 * 2**k) for k in range(11) for number in range(6)] + [(2, 0, 7), (2, 1, 900)]
    sized = spark.createDataFrame(rows, "grp long, node long, n_shingles long").withColumn("band", ng.size_band("n_shingles", 50))
    found = sorted(tuple(r) for r in ng.banded_blocks(sized).select("grp", "band", "start", "below", "blocks", "above").collect())
    large, small = [r[2:] for r in found if r[0] == 1], {r[2:] for r in found if r[0] == 2}
    assert small == {(0, 0, 1, 0)} and sum(blocks for _, _, blocks, _ in large) == 22
    assert all(below + blocks + above <= 6 for _, below, blocks, above in large)


@pytest.mark.parametrize("threshold", [75, 80, 90, 95, 99])
def test_linked_sizes_are_in_neighbouring_bands(spark, threshold):
    sizes = [(-(-b * threshold // 100), b) for b in range(1, 6000)]
    pairs = spark.createDataFrame(sizes, "a long, b long")
    gap = ng.size_band("b", threshold) - ng.size_band("a", threshold)
    assert pairs.where(~gap.between(0, 1)).count() == 0


@pytest.mark.parametrize("threshold", [75, 80, 90, 95, 100])
def test_other_thresholds_and_shingles(table, threshold):
    docs = corpus(threshold)[:110]
    want = [(doc, n, doc if n == 0 else component, links) for doc, n, component, links in jaccard(docs, threshold)]
    assert found(ng.jaccard_components(table(docs), threshold=threshold)) == sorted(want, key=str)


def test_low_thresholds_are_refused():
    with pytest.raises(ValueError):
        ng.Classes(50)


@pytest.mark.parametrize("size", [9, 10, 30, 100, 1000, 5000])
def test_linked_sets_share_a_segment(size):
    rng = np.random.default_rng(size)
    classes = ng.Classes(90)
    for _ in range(20):
        a = np.unique(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
        keep = -(-len(a) * 95 // 100)  # J of two such sets is 0.9 or just above
        b = np.unique(np.concatenate([rng.choice(a, keep, replace=False), rng.integers(0, 1 << 63, len(a) - keep, np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            assert len(a) < 9 or np.intersect1d(ng.signatures(a, classes), ng.signatures(b, classes)).size


def test_no_rows_and_one_of_each(table):
    assert found(ng.jaccard_components(table([]))) == []
    assert ng.keep_one_of_each(table([])).collect() == []
    docs = corpus(4)
    kept = [r.doc_id for r in ng.keep_one_of_each(table(docs).withColumnRenamed("lang", "Node")).collect()]
    want = {(doc if n == 0 else c) for doc, n, c, _ in jaccard(docs)}
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_a_group_is_dealt_by_its_blocks(spark, table, monkeypatch):
    """Without broadcasts, too, the pairs of blocks of one group lie in several partitions."""
    plans = []
    plain = ng.stored

    def spied(df, label):
        if label == "ngram-links":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    monkeypatch.setattr(ng, "stored", spied)
    monkeypatch.setattr(ng, "BLOCK_NODES", 4)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(w if rng.random() > 0.005 else f"x{rng.randint(0, 9)}" for w in base)) for i in range(40)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ng.jaccard_components(table(docs)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32m")
    assert got == {d: (n, c, k) for d, n, c, k in jaccard(docs)}
    assert "Exchange hashpartitioning(grp#" in plans[0] and ", low#" in plans[0].split("FlatMapGroupsInArrow")[1].split("Exchange")[1]


def test_columns_of_the_same_names_keep_their_values(table):
    docs = table([(1, "a b c d"), (2, "a b c d"), (3, "x y z")]).withColumnsRenamed({"lang": "node", "source": "N_shingles", "n_chars": "_again"})
    kept = ng.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id != 2)


def test_segments_and_sets_are_not_stored_and_segments_shuffled_once(table, monkeypatch):
    """Segments and sets are most of the join's bytes; how often they are written decides its disk use."""
    plans, kept = {}, ng.components
    monkeypatch.setattr(ng, "components", lambda edges, label: plans.setdefault(label, edges) and kept(edges, label))
    labels, write = [], ng.stored
    monkeypatch.setattr(ng, "stored", lambda df, label: labels.append(label) or write(df, label))
    docs = corpus(4)
    want = [(doc, n, doc if n == 0 else component, links) for doc, n, component, links in jaccard(docs)]
    assert found(ng.jaccard_components(table(docs))) == sorted(want, key=str)
    assert not {"ngram-segments", "ngram-sets"} & set(labels)
    plan = plans["ngram-ties"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(sig") == 1, plan


@pytest.mark.parametrize("nodes, part", [(4, 2), (3, 5), (40, 3)])
def test_blocks_meet_in_parts_and_sets_are_not_sent_to_their_own_block(table, monkeypatch, nodes, part):
    """A set goes to the other blocks in reach only; its own block's sets meet in one of these tasks, a few parts at a time."""
    seen, plain = [], ng.block_links

    def spied(df, label):
        if label == "ngram-links":
            seen.append(df)
        return kept(df, label)

    kept = ng.stored
    monkeypatch.setattr(ng, "stored", spied)
    monkeypatch.setattr(ng, "BLOCK_NODES", nodes)

    def small(threshold):
        def run(found):
            ng.PART_NODES = part
            return plain(threshold)(found)

        return run

    monkeypatch.setattr(ng, "block_links", small)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(w if rng.random() > 0.006 else f"x{rng.randint(0, 9)}" for w in base)) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ng.jaccard_components(table(docs)).collect()}
    assert got == {d: (n, c, k) for d, n, c, k in jaccard(docs)}
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "inner#" in plan


def test_every_pair_of_a_pair_of_blocks_is_compared_once():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 400, np.uint64)
    sets = [np.unique(np.where(rng.random(400) < 0.03, rng.integers(0, 1 << 60, 400, np.uint64), base)) for _ in range(23)]

    def overlap(a, b):
        both = len(np.intersect1d(a, b))
        return 100 * both >= 90 * (len(a) + len(b) - both)

    own = [i % 2 for i in range(23)]
    for inner in ((False, False), (True, False), (False, True), (True, True)):
        old, ng.PART_NODES = ng.PART_NODES, 4
        try:
            table = pa.table(
                {
                    "node": pa.array(range(23), pa.int64()),
                    "weight": pa.array([1] * 23, pa.int64()),
                    "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
                    "own": pa.array(own),
                    "inner": pa.array([inner[o] for o in own]),
                }
            )
            found = ng.block_links(90)(table).to_pydict()
        finally:
            ng.PART_NODES = old
        want = {
            i: n
            for i in range(23)
            if (n := sum(i != j and (own[i] != own[j] or inner[own[i]]) and overlap(sets[i], sets[j]) for j in range(23)))
        }
        assert dict(zip(found["node"], found["n_links"])) == want and want


def test_texts_tied_by_a_passage_are_not_in_one_group(table, monkeypatch):
    """Each text has a passage of the next one and one near copy: a few equal segments are no tie, so groups are pairs."""
    rng = random.Random(8)
    passages = [[f"w{rng.randrange(9000)}" for _ in range(130)] for _ in range(41)]
    docs = []
    for i in range(40):
        words = passages[i] + [f"v{rng.randrange(9000)}" for _ in range(100)] + passages[i + 1]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-6], *[f"x{n}" for n in range(6)]]))]
    groups, write = [], ng.stored

    def spied(df, label):
        kept = write(df, label)
        if label == "ngram-groups":
            groups.append(kept)
        return kept

    monkeypatch.setattr(ng, "stored", spied)
    want = [(doc, n, doc if n == 0 else component, links) for doc, n, component, links in jaccard(docs, 80)]
    assert found(ng.jaccard_components(table(docs), threshold=80)) == sorted(want, key=str)
    sizes = sorted(r["count"] for r in groups[0].groupBy("grp").count().collect())
    assert sizes == [2] * 40, sizes


@pytest.mark.parametrize("threshold", [75, 80, 90, 95])
def test_linked_sets_share_as_many_segments_as_is_asked_of_them(spark, threshold):
    rng = np.random.default_rng(threshold)
    classes, rows = ng.Classes(threshold), []
    for size in (5, 12, 23, 60, 131, 400, 1500):
        for _ in range(12):
            pool = np.unique(rng.integers(0, 1 << 63, 2 * size, np.uint64) * np.uint64(2))
            rng.shuffle(pool)
            a, both = np.sort(pool[:size]), size * 100 // threshold
            # Partners that are larger by new shingles, smaller, and that differ by as many on each side.
            swapped = size * (100 - threshold) // (100 + threshold)
            for b in (pool[:both], pool[: -(-size * threshold // 100)], pool[swapped : size + swapped]):
                least = min(len(a), len(b))
                k = classes.number(least)
                shared = np.intersect1d(ng.signatures(a, classes), ng.signatures(np.sort(b), classes))
                n = int((shared & np.uint64((1 << ng.CLASS_BITS) - 1) == np.uint64(k)).sum())
                if classes.most_different(classes.tops[k]):
                    rows += [(len(a), k, n), (len(b), k, n)]
    pairs = spark.createDataFrame(rows, "n long, k long, shared long")
    short = pairs.where(pairs.shared < ng.least_shared(pairs.n, pairs.k, threshold))
    assert short.count() == 0 and pairs.count() > 100
