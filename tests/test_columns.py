"""Scalar expressions and the semantic traps of the data."""

import math

import pytest
from pyspark.sql import functions as F

from doseframe.functions import columns as C
from doseframe.functions.frames import nan_to_null, with_hash_position
from doseframe.operators import filters as S
from doseframe.schema import DE_SCHEMA
from literals import rows_table


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("conc,label", [(0.05, 0.1), (0.25, 0.3), (5.04, 5.0), (0.5, 0.5)])
def test_dose_label(spark, conc, label):
    assert one(spark, C.conc_key(F.lit(conc))) == label


def test_dose_tolerance_is_open(spark):
    doses = spark.createDataFrame([(0.05,), (0.0505,), (0.0491,), (0.052,), (None,)], "concentration double")
    kept = {r[0] for r in S.conc_tolerance(doses, 0.05).collect()}
    assert kept == {0.05, 0.0505, 0.0491}


def test_percent_change(spark):
    assert one(spark, C.pct_change(F.lit(-1.0))) == -50.0
    assert one(spark, C.pct_change(F.lit(1.0))) == 100.0


def test_names(spark):
    assert one(spark, C.normalise_name(F.lit("Ca-co 2"))) == "CACO2"
    assert one(spark, C.safe_name(F.lit("a/b c"))) == "a_b_c"
    row = spark.createDataFrame([("Drug X", 5.0, "A549")], "drug string, concentration double, cell_line string")
    got = row.select(C.treatment_label("drug", "concentration", "cell_line"), C.result_key("drug", F.col("concentration"))).first()
    assert tuple(got) == ("Drug X_5.0uM_A549", "Drug_X_5.0")


def test_ic50(spark):
    assert one(spark, C.ic50_um(F.lit(1.0))) == 2.7183


def test_matches_is_regex_unless_literal(spark):
    df = spark.createDataFrame([("MEK inhibitor",), ("a.b",), (None,)], "v string")
    assert df.where(C.matches(F.col("v"), "mek|erk")).count() == 1
    assert df.where(C.matches(F.col("v"), "A.B", literal=True)).count() == 1
    assert df.where(C.matches(F.col("v"), "mek|erk", literal=True)).count() == 0
    assert df.where(~C.matches(F.col("v"), "mek")).count() == 2


@pytest.mark.parametrize("value,digits", [(0.0625, 3), (0.1875, 3), (-0.0625, 3), (0.0025, 3), (1.005, 2), (0.125, 2), (0.375, 2), (2.675, 2), (-1.74, 2), (1.0, 3)])
def test_fixed_rounds_as_python(spark, value, digits):
    assert one(spark, C.fixed(F.lit(value), digits)) == f"{value:.{digits}f}"


def test_rank_metric(spark):
    assert one(spark, C.rank_metric(F.lit(-2.0), F.lit(0.01))) == -2.0
    assert one(spark, C.rank_metric(F.lit(2.0), F.lit(0.0))) == 300.0
    zero = one(spark, C.rank_metric(F.lit(-2.0), F.lit(1.0)))
    assert zero == 0 and math.copysign(1, zero) == 1


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), float("nan")), (1.0, None)], "a double, b double")
    got = nan_to_null(df, ["a"]).orderBy("a").collect()
    assert got[0].a is None and math.isnan(got[0].b)
    assert nan_to_null(df).agg(F.avg("a"), F.min("b")).first()[:] == (1.0, None)


def test_grams(spark):
    assert set(one(spark, C.grams(F.lit("AbAc"), [1, 3]))) == {"a", "b", "c", "aba", "bac"}
    assert one(spark, C.grams(F.lit(""), [1, 2, 3])) == [] and one(spark, C.grams(F.lit("ab"), [3])) == []


def test_rows_table_keeps_types(spark):
    rows = [("g", 1.0, None, 2.0, "d", 0.05, "c"), ("h", None, 0.1, 2.0, "d", 5.0, "c")]
    assert [tuple(r) for r in rows_table(spark, DE_SCHEMA, rows).collect()] == rows


def test_hash_position_is_the_global_rank(spark):
    ids = spark.range(5000).select(F.col("id").cast("string").alias("id"))
    placed = with_hash_position(ids, F.md5("id"), ["id"], "p").collect()
    import hashlib

    want = {v: i for i, v in enumerate(sorted((str(i) for i in range(5000)), key=lambda s: (hashlib.md5(s.encode()).hexdigest(), s)))}
    assert {r.id: r.p for r in placed} == want
