"""Question sets labelled from enrichment results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseframe.functions.frames import with_hash_position

# Fixed values.
DIRECTIONS = ("activated", "repressed", "either")


def ground_truth(direction: Column, nes: Column, fdr: Column, threshold: Column) -> Column:
    """Whether the pathway is significant in the direction asked for; missing statistics are not."""
    significant = fdr < threshold
    label = (
        F.when(direction == "activated", (nes > 0) & significant)
        .when(direction == "repressed", (nes < 0) & significant)
        .otherwise(significant)
    )
    return F.coalesce(label, F.lit(False))


def with_question_id(questions: DataFrame) -> DataFrame:
    """Given ids are kept; missing ones become the md5 of the text."""
    given = F.col("question_id") if "question_id" in questions.columns else F.lit(None).cast("string")
    return questions.withColumn("question_id", F.coalesce(given, F.md5("question")))


def build_questions(questions: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Labelled test items: every cell line with a result for the question's drug, dose and pathway.

    ``questions`` has question_id, drug, concentration, target_pathway,
    direction and fdr_threshold.
    """
    results = enrichment.select(
        "drug", "concentration", F.col("pathway").alias("target_pathway"), "cell_line", "nes", "fdr"
    )
    return questions.join(results, ["drug", "concentration", "target_pathway"]).withColumn(
        "ground_truth", ground_truth(F.col("direction"), F.col("nes"), F.col("fdr"), F.col("fdr_threshold"))
    )


def unmatched_questions(questions: DataFrame, items: DataFrame) -> DataFrame:
    """Questions without a single eligible cell line."""
    return questions.join(items.select("question_id").distinct(), "question_id", "left_anti")


def task_rows(questions: DataFrame, items: DataFrame, split: str = "test") -> DataFrame:
    """Task record per question with the size of its test set, zero included."""
    sizes = items.groupBy("question_id").agg(F.count(F.lit(1)).alias("_n"))
    return questions.join(sizes, "question_id", "left").select(
        "question_id",
        F.col("question").alias("question_text"),
        "target_pathway",
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("test_set_size"),
        F.lit(split).alias("split"),
    )


def split_tasks(tasks: DataFrame, train_frac: float = 0.7, val_frac: float = 0.15, seed: int = 42) -> DataFrame:
    """Seeded shuffle into train, val and test; the first two sizes are truncated products."""
    placed = with_hash_position(
        tasks, F.md5(F.concat(F.lit(f"{seed}:"), "question_id")), ["question_id"], "shuffle_position"
    )
    n = tasks.agg(F.count(F.lit(1))).scalar()
    train_end = F.floor(n * F.lit(float(train_frac)))
    val_end = train_end + F.floor(n * F.lit(float(val_frac)))
    split = (
        F.when(F.col("shuffle_position") < train_end, "train")
        .when(F.col("shuffle_position") < val_end, "val")
        .otherwise("test")
    )
    return placed.withColumn("split", split)
