"""Whitening against exact integer arithmetic and plain linear algebra."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from doseframe.llm import whitening as wh
from doseframe.llm.queries import QUERIES


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute(rows):
    """Exact covariance and deviations by Fractions over Python integers."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if usable(v)]
    n, dims = len(kept), len(kept[0][1])
    sums = [sum(x[d] for _, x in kept) for d in range(dims)]
    centred = [[n * x[d] - sums[d] for d in range(dims)] for _, x in kept]
    cov = [[float(Fraction(sum(c[i] * c[j] for c in centred), n**3)) for j in range(dims)] for i in range(dims)]
    return n, [i for i, _ in kept], np.array([[float(Fraction(v, n)) for v in c] for c in centred]), [sum(v * v for v in c) for c in centred], np.array(cov)


def check(df, rows, tolerance=1e-9):
    n, ids, centred, deviation, cov = brute(rows)
    got = df.orderBy("vec_id", "component").collect()
    parts = min(32, cov.shape[0])
    assert sorted(r.vec_id for r in got) == sorted(i for i in ids for _ in range(parts))
    by_id = dict(zip(ids, deviation))
    assert all(r.n == n and int(r.deviation) == by_id[r.vec_id] for r in got)
    y = np.array([r.whitened for r in got]).reshape(-1, parts)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1][:parts]
    order = np.argsort(ids, kind="stable")
    assert np.allclose([r.explained for r in got[:parts]], values / np.trace(cov), rtol=1e-6)
    # Each component is an eigenvector: regress whitened values on centred rows, which are its projection over sqrt(e).
    assert np.abs(np.cov(y.T, bias=True).reshape(parts, parts) - np.eye(parts)).max() < 1e-6
    axes = (centred[order].T @ y / n) / np.sqrt(values)
    assert np.allclose(np.linalg.norm(axes, axis=0), 1, atol=1e-6) and np.allclose(cov @ axes, axes * values, atol=tolerance * values[0])
    assert np.allclose(centred[order] @ axes / np.sqrt(values), y, atol=1e-6)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-6


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(parts)


@pytest.mark.parametrize("n,dims,scale", [(300, 5, 1.0), (9000, 40, 0.3), (200, 3, 1e6)])
def test_matches_exact_arithmetic(spark, n, dims, scale):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) * scale * np.linspace(1, 3, dims)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(n, None), (n + 1, [None] * dims), (n + 2, [float("nan")] * dims), (n + 3, [float("inf")] * dims), (n + 4, [1.0] * (dims + 1)), (n + 5, [])]
    rows += [(n + 6, [1e30] * dims)]
    check(wh.whiten(frame(spark, rows)), rows[:n])


def test_planes_give_exact_products():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 100, (130, 3)), rng.integers(0, 1 << 40, (130, 1))], axis=1).astype(np.uint64)
    bits = [int(v).bit_length() for v in x.max(axis=0)]
    limbs = np.zeros((5, 4, 4), np.int64)
    wh.add_shared_bits(limbs, *wh.packed_planes(x, bits))
    got = sum(limbs[k].astype(object) << (wh.LIMB * k) for k in range(5))
    want = x.astype(object).T @ x.astype(object)
    assert all(got[i][j] == want[i][j] for i in range(4) for j in range(i, 4))


def test_large_common_part_and_wide_numbers_stay_exact(spark):
    rows = [(i, [2.0**50 + 2.0**27 * (i % 3), float(i % 5), -(2.0**40)]) for i in range(60)]
    got = wh.whiten(frame(spark, rows)).collect()
    _, ids, _, deviation, cov = brute(rows)
    assert {r.vec_id: int(r.deviation) for r in got} == dict(zip(ids, deviation))
    assert math.isclose(got[0].explained, np.linalg.eigvalsh(cov)[-1] / np.trace(cov), rel_tol=1e-9)


def test_directions_without_variance(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 3.0]) for i in range(70)]
    got = wh.whiten(frame(spark, rows)).collect()
    assert {r.component: r.whitened is None for r in got} == {1: False, 2: True, 3: True}
    assert got[0].identity_error < 1e-9
    same = wh.whiten(frame(spark, [(1, [0.5, 0.5]), (1, [0.5, 0.5])])).collect()
    assert [(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in same] == [
        (1, c, 2, 0, None, 0.0, None) for c in (1, 2, 1, 2)
    ]


def test_repeated_and_null_ids_empty_tables_and_clashing_columns(spark):
    rows = [(None, [1.0, 2.0]), (None, [2.0, 1.0]), (5, [4.0, 4.0]), (5, [4.0, 4.0])]
    df = frame(spark, rows).withColumn("n", F.lit("mine")).withColumn("v", F.lit(0)).withColumn("component", F.lit(9))
    got = wh.whiten(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert sorted(str(r.vec_id) for r in got.collect()) == ["5"] * 4 + ["None"] * 4 and got.first().n == 4
    assert wh.whiten(frame(spark, [])).collect() == [] and wh.whiten(frame(spark, [(1, []), (2, None)])).collect() == []


def test_reruns_agree_whatever_the_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(500, 6)))]
    one, two = (sorted((r.vec_id, r.component, r.whitened) for r in wh.whiten(frame(spark, rows, p)).collect()) for p in (1, 7))
    assert one == two


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(QUERIES["op12_whitening"](spark, sf), rows)
