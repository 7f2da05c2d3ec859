"""Set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_results(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def intersect_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct values of the only column that occur on both sides."""
    return left.intersect(right)


def intersection_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sizes of both sets and of their intersection, in one aggregation."""
    name = left.columns[0]
    tagged = left.select(F.col(name).alias("_v"), F.lit(1).alias("_side")).unionByName(
        right.select(F.col(right.columns[0]).alias("_v"), F.lit(2).alias("_side"))
    )
    sides = tagged.groupBy("_v").agg(F.bit_or("_side").alias("_in"))
    return sides.agg(
        F.count_if(F.col("_in").isin(1, 3)).alias("n_left"),
        F.count_if(F.col("_in").isin(2, 3)).alias("n_right"),
        F.count_if(F.col("_in") == 3).alias("n_both"),
    )


def remaining_files(all_files: DataFrame, index: DataFrame) -> DataFrame:
    """File numbers that an index of all files (``write_index``) does not name yet."""
    return all_files.select("file_num").subtract(index.select("file_num"))


def all_signature_genes(signatures: DataFrame) -> DataFrame:
    return signatures.select("gene").distinct()


def sample_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first n rows in a declared order, for a trial run."""
    return df.orderBy(*order_by).limit(n)
