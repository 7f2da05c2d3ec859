"""Mixing against a plain solver, exact targets and the promises on what is taken."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from doseframe.llm import mixing
from doseframe.llm.queries import QUERIES


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(5, 2, 1), percent=150, most=2):
    """Reshare the excess round by round, as exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, fixed = Fraction(percent * sum(sizes.values()), 100), {}
    while True:
        rest = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in rest)
        shares = {s: left * weight[s] / total for s in rest}
        over = [s for s in rest if shares[s] > most * sizes[s]]
        if not over:
            return {**fixed, **shares}
        for s in over:
            fixed[s] = Fraction(most * sizes[s])
        left = Fraction(percent * sum(sizes.values()), 100) - sum(fixed.values())


def plain_rates(sizes, target, most=2):
    """The tilted rates of one source by bisection, on unscaled sizes."""

    def rate(lam, z):
        return most / (1 + (most - 1) * math.exp(min(700, -lam * z)))

    lo, hi = -1000.0, 1000.0
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(z * rate(mid, z) for z in sizes) < target else (lo, mid)
    return {z: rate(lo, z) for z in sizes}


def nearest(sizes, target):
    """How near to the target any choice of none, one or two copies of each comes."""
    sums = {0}
    for z in sizes if len(sizes) < 40 else []:
        sums = {s + k * z for s in sums for k in (0, 1, 2)}
    return min(abs(s - target) for s in sums) if len(sizes) < 40 else 0


def corpus(seed, n, sources):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join("w" for _ in range(int(rng.paretovariate(0.9)) % 3000)) if i % 17 else ""
        rows.append((i, rng.choices(sources, [2 ** -j for j in range(len(sources))])[0], text if i % 29 else None))
    return rows


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(parts)


@pytest.mark.parametrize("seed,n,sources", [(1, 400, ["b", "a", None, "é", "z", ""]), (2, 900, ["x"]), (3, 60, ["p", "q", "r", "s"])])
def test_targets_rates_and_taken(spark, seed, n, sources):
    rows = corpus(seed, n, sources)
    got = mixing.mix(frame(spark, rows), keep=["source"]).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    texts, by_source = {i: t for i, _, t in rows}, defaultdict(list)
    for r in got:
        assert r.size == size_of(texts[r.doc_id]) and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        by_source[r.source].append(r)
    sizes = {s: sum(r.size for r in rs) for s, rs in by_source.items()}
    targets = plain_targets(sizes)
    for s, rs in by_source.items():
        assert {r.source_size for r in rs} == {sizes[s]}
        assert all(math.isclose(r.target, float(targets[s]), rel_tol=1e-12) for r in rs)
        assert abs(sum(r.taken for r in rs) - targets[s]) <= max(2, 0.01 * targets[s], 1.5 * nearest([r.size for r in rs], targets[s]))
        if 0 < targets[s] < 2 * sizes[s]:
            want = plain_rates([r.size for r in rs], float(targets[s]))
            assert all(math.isclose(r.rate, want[r.size], rel_tol=1e-4, abs_tol=1e-6) for r in rs if r.size)
    assert math.isclose(sum(targets.values()), 1.5 * sum(sizes.values()))


def test_settled_comes_as_near_as_pairs_can():
    got = mixing.settled(65.0, np.array([900, 300, 240, 10, 1]), np.array([1, 1, 1, 2, 2]), np.array([2, 2, 2, 2, 2]))
    assert abs(65 - int((got - [1, 1, 1, 2, 2]) @ [900, 300, 240, 10, 1])) <= 5 and got.min() >= 0 and got.max() <= 2


def test_rates_are_nearest_to_one_in_entropy(spark):
    """Moving words between two documents of a source never lowers the relative entropy."""
    got = mixing.mix(frame(spark, [(i, "t", "w " * (i + 1)) for i in range(30)] + [(99, "s", "w " * 300)])).where("doc_id < 99").collect()

    def entropy(rate):
        p = rate / 2
        return 2 * (p * math.log(2 * p) + (1 - p) * math.log(2 * (1 - p)))

    for a, b in zip(got, got[1:]):
        d = 1e-4
        assert entropy(a.rate) + entropy(b.rate) <= entropy(a.rate + d / a.size) + entropy(b.rate - d / b.size) + 1e-9


def test_reruns_agree_and_a_hot_size_is_split(spark):
    rows = [(i, "hot", "a b c") for i in range(3000)] + [(5000 + i, f"s{i % 7}", "w " * (i % 50)) for i in range(900)]
    one, two = (sorted((r.doc_id, r.taken) for r in mixing.mix(frame(spark, rows, p)).collect()) for p in (1, 9))
    assert one == two
    plan = mixing.mix(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_repeated_rows_null_ids_and_copies(spark):
    rows = [(None, "s", "a b"), (None, "s", "a b"), (1, None, "x y z"), (1, None, "x y z"), (2, "", None)]
    mixed = mixing.mix(frame(spark, rows), keep=["text"])
    got = mixed.collect()
    assert len(got) == 5 and Counter(r.size for r in got) == {2: 2, 3: 2, 0: 1}
    again = mixing.repeated(mixed)
    assert again.where("size > 0").agg(F.sum("size")).first()[0] == sum(r.taken for r in got)
    assert again.where("size = 0").count() == 1


def test_no_rows_no_words_and_clashing_columns(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    got = mixing.mix(frame(spark, [(1, "a", ""), (2, None, None)])).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.copies, r.taken) for r in got) == [(1, 0, 0, 0.0, 1, 0), (2, 0, 0, 0.0, 1, 0)]
    df = frame(spark, [(1, "a", "b c")]).withColumns({"Target": F.lit("mine"), "s": F.lit(1), "bucket": F.lit(2), "n": F.lit(3)})
    got = mixing.mix(df, keep=["s", "bucket", "Target", "n"])
    assert got.columns == ["doc_id", "s", "bucket", "n", *mixing.NEW_COLUMNS]
    assert tuple(got.first())[:5] == (1, 1, 2, 3, 2)


def test_query_on_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_mixing"](spark, sf).collect()
    sizes, taken, targets = Counter(), Counter(), {}
    for r in got:
        d = docs[r.doc_id]
        assert r.size == size_of(d.text) and r.taken <= 2 * r.size
        sizes[d.source] += r.size
        taken[d.source] += r.taken
        targets[d.source] = r.target
    want = plain_targets(sizes)
    assert len(got) == len(docs) and all(math.isclose(targets[s], float(want[s]), rel_tol=1e-12) for s in sizes)
    assert all(abs(taken[s] - want[s]) <= max(5, 0.002 * want[s]) for s in sizes)
