"""The differential-expression fact table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doseframe.functions.frames import nan_to_null
from doseframe.schema import DE_SCHEMA, DE_STATS


def file_number() -> Column:
    """Number in the file's name (``part-00003-...`` is 3), null if there is none; prunes files when filtered."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^\D*(\d+)", 1).try_cast("int")


def numbered(stored: DataFrame) -> Column:
    """The file number: of the folder (``file_num=3``) where facts were written by ``write_de``, else of the file's name."""
    return F.col("file_num").cast("int") if "file_num" in stored.columns else file_number()


def scan_de(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType = DE_SCHEMA,
    rename: Mapping[str, str] | None = None,
    stats: Sequence[str] = tuple(DE_STATS),
) -> DataFrame:
    """All files as one table, with ``file_num`` and NaN statistics as null.

    ``schema`` names the columns as stored; ``rename`` maps stored names to
    ours (for example a vendor's cell-line column to ``cell_line``).
    """
    paths = [path] if isinstance(path, str) else list(path)
    stored = spark.read.schema(schema).parquet(*paths)
    table = stored.withColumn("file_num", numbered(stored))
    if rename:
        table = table.withColumnsRenamed(dict(rename))
    return nan_to_null(table, stats)


def scan_de_file(
    spark: SparkSession,
    path: str,
    file_num: int,
    schema: T.StructType = DE_SCHEMA,
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """One file by number. The predicate is on the folder or on file metadata, so other files are never opened."""
    return scan_de(spark, path, schema, rename).where(F.col("file_num") == file_num)


def write_de(
    df: DataFrame,
    path: str,
    files: int,
    order: Sequence[str] = ("cell_line", "drug", "concentration", "gene_name"),
    row_group_bytes: int = 8 << 20,
    page_rows: int = 2000,
) -> None:
    """Write ``files`` files, file k holding the rows with ``file_num`` k in a folder of that number.

    The folder is a partition column, so files can also be chosen while a query runs.
    Rows are sorted by treatment and gene: filters on either skip row groups and,
    as pages are small, most pages of the rest. Bloom filters on the gene let whole
    row groups be skipped where the order does not help.
    """
    (
        df.repartitionById(files, F.col("file_num"))
        .sortWithinPartitions("file_num", *order)
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#gene_name", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .partitionBy("file_num")
        .parquet(path)
    )


def sql_over_de(spark: SparkSession, text: str, de: DataFrame) -> DataFrame:
    """User SQL in which ``{parquet}`` stands for the table."""
    return spark.sql(text, parquet=de)
