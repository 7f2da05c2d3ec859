"""Literal rows for tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rows_table(spark: SparkSession, schema: T.StructType, rows: Sequence[tuple]) -> DataFrame:
    """A few literal rows as a table with a known small size."""
    records = F.array(
        *[
            F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)])
            for row in rows
        ]
    )
    return spark.range(1).select(F.inline(records))
