"""Small frame helpers used by several operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN becomes null in double columns, so aggregates skip it."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    chosen = [c for c in doubles if cols is None or c in cols]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in chosen})


def spread(df: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """Hash-partition by ``keys`` into the session's number of shuffle partitions, or ``times`` as many.

    For steps that compute much per byte. The number is stated, so adaptive
    execution does not merge partitions by their size in bytes.
    """
    return df.repartition(times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_hash_position(df: DataFrame, hash_hex: Column, ties: Sequence[str], name: str) -> DataFrame:
    """Global 0-based position by a hex hash, without a one-task global sort.

    Rows are ranked within the 4096 buckets of the hash's first three digits;
    bucket offsets come from a table of at most 4096 counts.
    """
    hashed = df.withColumns({"_hash": hash_hex}).withColumn("_bucket", F.substring("_hash", 1, 3))
    # The only window without a partition key: its input is the bucket counts.
    offsets = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        "_bucket",
        (F.sum("_n").over(Window.partitionBy().orderBy("_bucket")) - F.col("_n")).alias("_before"),
    )
    inside = Window.partitionBy("_bucket").orderBy("_hash", *ties)
    return (
        hashed.join(offsets, "_bucket")
        .withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_hash", "_bucket", "_before")
    )
