"""Result tables: written through Spark's committer, read back with a fixed schema."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doseframe.schema import ENRICHMENT_SCHEMA, INDEX_SCHEMA, TREATMENT
from doseframe.sources.snapshots import read_snapshot, write_snapshot


def write_enrichment(df: DataFrame, path: str) -> None:
    """Replace exactly the treatments in ``df``; other treatments stay as they are.

    There is one folder per cell line, with rows sorted by drug. Cell lines in
    ``df`` are rewritten with their other treatments, the rest is not touched;
    the old folders are replaced when all new files are complete.
    """
    new = df.select(*ENRICHMENT_SCHEMA.fieldNames())
    old = read_enrichment(df.sparkSession, path)
    kept = old.join(new.select("cell_line").distinct(), "cell_line", "left_semi").join(
        new.select(*TREATMENT).distinct(), TREATMENT, "left_anti"
    )
    (
        new.unionByName(kept)
        .repartition("cell_line", "drug")
        .sortWithinPartitions("cell_line", "drug", "concentration")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("cell_line")
        .parquet(path)
    )


def read_enrichment(spark: SparkSession, path: str) -> DataFrame:
    """Stored results; an empty table when nothing was written yet.

    A filter on the cell line prunes folders, one on the drug row groups.
    """
    try:
        return spark.read.schema(ENRICHMENT_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENRICHMENT_SCHEMA)


def write_scores(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_index(entries: DataFrame, path: str) -> None:
    """One row per treatment and file that holds some of it.

    A new version takes the old one's place when it is complete; until then, and if the write fails, readers get the old one.
    """
    write_snapshot(entries.select(*TREATMENT, F.col("file_num").cast("int").alias("file_num")).distinct(), path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored index; an empty table when nothing was written yet."""
    return read_snapshot(spark, path, INDEX_SCHEMA)


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Write ``df`` to the new folder ``path`` in buckets by ``keys`` and read it back as a table that knows them.

    Operators that need rows together by ``keys`` then read without a shuffle. Each
    bucket is one file, as rows are dealt by the same hash before they are written.
    The table's name holds for the session; the files stay the caller's.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
