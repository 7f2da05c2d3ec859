"""Metadata tables, gene signatures and compound lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doseframe.functions.frames import nan_to_null
from doseframe.schema import COMPOUND_SCHEMA

METADATA_TABLES = ("gene_metadata", "drug_metadata", "cell_line_metadata", "sample_metadata")


def load_metadata(spark: SparkSession, root: str) -> Mapping[str, DataFrame]:
    """The four metadata tables below ``root``, read lazily."""
    return {name: nan_to_null(spark.read.parquet(f"{root}/{name}")) for name in METADATA_TABLES}


def load_signatures(spark: SparkSession, path: str, whole_document: bool = True) -> DataFrame:
    """JSON objects ``name -> [genes]`` as rows (signature, gene).

    One object per file, or one per line with ``whole_document=False``.
    """
    text = spark.read.text(path, wholetext=whole_document)
    kind = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
    return (
        text.select(F.explode(F.from_json("value", kind)).alias("signature", "genes"))
        .select("signature", F.explode("genes").alias("gene"))
    )


def scan_csv_compounds(spark: SparkSession, path: str, schema: T.StructType = COMPOUND_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, escape='"')
