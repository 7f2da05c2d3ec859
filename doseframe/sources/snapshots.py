"""Tables that are replaced as a whole, with readers at any time.

A table is a folder of data folders, one per version, and a log of commits. A
version is written to a new data folder first; one row appended to the log makes
it the current one, and Spark's committer makes that row visible at once or not at
all. So a write that fails half-way leaves the old version in place, and readers
that have begun go on with the version they began with. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMITS = T.StructType([T.StructField("version", T.LongType()), T.StructField("folder", T.StringType())])


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The log: a row per version; empty if nothing was written yet."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{root}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def current(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Number and folder of the current version; 0 and None before the first."""
    last = commits(spark, root).agg(F.max(F.struct("version", "folder")).alias("last")).first()["last"]
    return (last["version"], last["folder"]) if last else (0, None)


def write_snapshot(df: DataFrame, root: str) -> int:
    """Make ``df`` the current version. Gives its number."""
    spark, folder = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{root}/data/{folder}")
    version = current(spark, root)[0] + 1
    row = spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.lit(folder).alias("folder"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return version


def read_snapshot(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The current version, or an earlier one by number; an empty table before the first."""
    if version is None:
        folder = current(spark, root)[1]
        if folder is None:
            return spark.createDataFrame([], schema)
    else:
        row = commits(spark, root).where(F.col("version") == version).first()
        if row is None:
            raise ValueError(f"no version {version} in {root}")
        folder = row["folder"]
    return spark.read.schema(schema).parquet(f"{root}/data/{folder}")
