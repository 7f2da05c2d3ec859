import pytest
from pyspark.sql import functions as F

from doseframe.operators import aggregates as A
from doseframe.operators import questions as Q

ENR = "cell_line string, drug string, concentration double, pathway string, nes double, fdr double"


@pytest.fixture(scope="module")
def enr(spark):
    rows = [("a", -2.0, 0.01), ("b", 1.5, 0.01), ("c", -2.0, 0.2), ("d", None, None), ("e", -1.0, 0.05)]
    return spark.createDataFrame([(c, "D", 5.0, "P", n, f) for c, n, f in rows], ENR)


def questions(spark, *rows):
    return spark.createDataFrame(
        list(rows), "question_id string, question string, drug string, concentration double, target_pathway string, direction string, fdr_threshold double"
    )


def truth(items):
    return {r.cell_line for r in items.collect() if r.ground_truth}


@pytest.mark.parametrize("direction,want", [("activated", {"b"}), ("repressed", {"a"}), ("either", {"a", "b"})])
def test_directions(spark, enr, direction, want):
    items = Q.build_questions(questions(spark, ("q", "t", "D", 5.0, "P", direction, 0.05)), enr)
    assert items.count() == 5 and truth(items) == want


def test_unmatched_and_task_rows(spark, enr):
    asked = Q.with_question_id(questions(spark, ("q1", "one", "D", 5.0, "P", "either", 0.05), (None, "two", "D", 0.05, "P", "either", 0.05)))
    items = Q.build_questions(asked, enr)
    missing = Q.unmatched_questions(asked, items).collect()
    assert [r.question for r in missing] == ["two"] and len(missing[0].question_id) == 32
    rows = {r.question_text: (r.test_set_size, r.split) for r in Q.task_rows(asked, items, "eval").collect()}
    assert rows == {"one": (5, "eval"), "two": (0, "eval")}


def test_summary_and_mutation_groups(spark, enr):
    items = Q.build_questions(questions(spark, ("q", "t", "D", 5.0, "P", "repressed", 0.05)), enr)
    row = A.question_summary(items).first()
    assert (row.n_items, row.n_true, row.pct_true) == (5, 1, 20.0)
    cells = spark.createDataFrame([("a", "BRAF"), ("a", "KRAS"), ("b", "KRAS"), ("c", None)], "cell_name string, Driver_Gene_Symbol string")
    got = {r.mutation_group: (r.n_items, r.n_true) for r in A.truth_by_mutation(items, cells, "BRAF", "KRAS").collect()}
    assert got == {"BRAF mutant": (1, 1), "KRAS mutant": (2, 1), "neither": (3, 0)}


def tasks(spark, n=10):
    return spark.range(n).select(F.format_string("q_%03d", "id").alias("question_id"))


def members(df, split="train"):
    return sorted(r.question_id for r in df.where(F.col("split") == split).collect())


def test_split_sizes(spark):
    done = Q.split_tasks(tasks(spark), 0.6, 0.2)
    assert [len(members(done, s)) for s in ("train", "val", "test")] == [6, 2, 2]
    default = Q.split_tasks(tasks(spark))
    assert [len(members(default, s)) for s in ("train", "val", "test")] == [7, 1, 2]
    assert Q.split_tasks(tasks(spark, 0)).count() == 0


def test_split_depends_on_seed_only(spark):
    assert members(Q.split_tasks(tasks(spark), seed=42)) == members(Q.split_tasks(tasks(spark).repartition(3), seed=42))
    order = {s: [r.question_id for r in Q.split_tasks(tasks(spark), seed=s).orderBy("shuffle_position").collect()] for s in (42, 123)}
    assert order[42] != order[123]
