"""Column names and schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# One treatment is one drug at one dose in one cell line. The raw dose is the
# key; the rounded dose is only a label (0.05 and 0.1 would share a label).
TREATMENT = ["cell_line", "drug", "concentration"]

DE_SCHEMA = T.StructType(
    [
        T.StructField("gene_name", T.StringType()),
        T.StructField("log2FoldChange", T.DoubleType()),
        T.StructField("padj", T.DoubleType()),
        T.StructField("baseMean", T.DoubleType()),
        T.StructField("drug", T.StringType()),
        T.StructField("concentration", T.DoubleType()),
        T.StructField("cell_line", T.StringType()),
    ]
)

# Statistics that may hold NaN in the files. The dose is left untouched so that
# dose filters still reach the parquet reader.
DE_STATS = ["log2FoldChange", "padj", "baseMean"]

ENRICHMENT_SCHEMA = T.StructType(
    [
        T.StructField("pathway", T.StringType()),
        T.StructField("nes", T.DoubleType()),
        T.StructField("pvalue", T.DoubleType()),
        T.StructField("fdr", T.DoubleType()),
        T.StructField("leading_edge", T.StringType()),
        T.StructField("cell_line", T.StringType()),
        T.StructField("drug", T.StringType()),
        T.StructField("concentration", T.DoubleType()),
    ]
)

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("cell_line", T.StringType()),
        T.StructField("drug", T.StringType()),
        T.StructField("concentration", T.DoubleType()),
        T.StructField("file_num", T.IntegerType()),
    ]
)

COMPOUND_SCHEMA = T.StructType(
    [
        T.StructField("DRUG_ID", T.LongType()),
        T.StructField("DRUG_NAME", T.StringType()),
        T.StructField("TARGET", T.StringType()),
        T.StructField("TARGET_PATHWAY", T.StringType()),
    ]
)
