"""Joins of scores, treatments and outside data. Join strategy is left to Spark."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doseframe.functions.columns import conc_key, normalise_name
from doseframe.operators.filters import select_existing_cols
from doseframe.schema import DE_SCHEMA, TREATMENT
from doseframe.sources.de import scan_de

# Cell lines in one word of a bitmap.
WORD_BITS = 64

DRUG_COLUMNS = ["drug", "moa-fine", "moa-broad", "targets"]
CELL_COLUMNS = ["cell_name", "Driver_Gene_Symbol", "Driver_ProtEffect_or_CdnaEffect", "Organ"]


def join_drug_meta(scores: DataFrame, drugs: DataFrame, cols: Sequence[str] = tuple(DRUG_COLUMNS)) -> DataFrame:
    return scores.join(select_existing_cols(drugs, cols), "drug", "left")


def join_cell_meta_fanout(scores: DataFrame, cells: DataFrame, cols: Sequence[str] = tuple(CELL_COLUMNS)) -> DataFrame:
    """One output row per driver mutation of the cell line."""
    meta = select_existing_cols(cells, cols)
    return scores.join(meta, scores["cell_line"] == meta["cell_name"], "left")


def first_per_cell_line(cells: DataFrame, order_col: str, cols: Sequence[str]) -> DataFrame:
    """First non-null value of each column per cell line, in the order of ``order_col``."""
    firsts = [
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order_col))).alias(c)
        for c in cols
        if c != "cell_name" and c in cells.columns
    ]
    return cells.groupBy("cell_name").agg(*firsts)


def join_cell_meta_first(
    scores: DataFrame,
    cells: DataFrame,
    order_col: str,
    cols: Sequence[str] = ("cell_name", "Organ", "Driver_Gene_Symbol"),
) -> DataFrame:
    meta = first_per_cell_line(cells, order_col, cols)
    return scores.join(meta, scores["cell_line"] == meta["cell_name"], "left")


def merge_signatures_outer(tables: Sequence[DataFrame], keys: Sequence[str] = ("drug", "cell_line")) -> DataFrame:
    """Full outer merge of one wide table per signature; the gene count is the first table's."""
    rest = [t.drop("n_genes") for t in tables[1:]]
    return reduce(lambda left, right: left.join(right, list(keys), "full_outer"), rest, tables[0])


def indexed_fetch(
    spark: SparkSession,
    path: str,
    index: DataFrame,
    keys: DataFrame,
    schema: T.StructType = DE_SCHEMA,
) -> DataFrame:
    """Rows of the requested treatments, read from the files the index names.

    ``index`` has every file of a treatment (``write_index``). The named files come
    from a subquery that Spark runs before the scan, whose partitions (``write_de``
    has a folder per file) it then prunes: nothing runs while the query is built, and
    files without a requested treatment stay closed. The subquery's result is at most
    as long as the table's list of files. Facts whose files are numbered by name only
    need a list known to the planner for that, which is collected.
    """
    wanted = keys.select(*TREATMENT).distinct()
    files = index.join(wanted, TREATMENT, "left_semi").select("file_num")
    facts = scan_de(spark, path, schema)
    if "file_num" in spark.read.schema(schema).parquet(path).columns:
        named = F.array_contains(files.agg(F.collect_set("file_num")).scalar(), F.col("file_num"))
    else:
        named = F.col("file_num").isin([r["file_num"] for r in files.distinct().collect()])
    return facts.where(named).join(wanted, TREATMENT, "left_semi")


def assemble_treatments(keys: DataFrame, drugs: DataFrame, cell_lines: DataFrame) -> DataFrame:
    """Attach the parsed drug and the nested cell-line record; unknown names drop out."""
    drug = drugs.select("drug", F.struct(*[c for c in drugs.columns]).alias("drug_info"))
    line = cell_lines.select("cell_line", F.struct(*[c for c in cell_lines.columns]).alias("cell_line_info"))
    return keys.join(drug, "drug").join(line, "cell_line")


def name_overlap(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """Names of both sides that agree once normalised; the last original by name stands for its side."""

    def side(df: DataFrame, col: str, out: str) -> DataFrame:
        return (
            df.where(F.col(col).isNotNull())
            .groupBy(normalise_name(col).alias("norm_name"))
            .agg(F.max(col).alias(out))
        )

    return side(left, left_col, "left_name").join(side(right, right_col, "right_name"), "norm_name")


def semi_join_response(response: DataFrame, drugs: DataFrame, cell_lines: DataFrame) -> DataFrame:
    """Dose-response rows of the given drugs (upper-cased) and cell lines (normalised)."""
    return (
        response.withColumns({"_drug": F.upper("DRUG_NAME"), "_cell": normalise_name("CELL_LINE_NAME")})
        .join(drugs.select(F.upper("drug").alias("_drug")).distinct(), "_drug", "left_semi")
        .join(cell_lines.select(normalise_name("cell_name").alias("_cell")).distinct(), "_cell", "left_semi")
        .drop("_drug", "_cell")
    )


def skip_cached(treatments: DataFrame, results: DataFrame) -> DataFrame:
    """Treatments without stored results."""
    return treatments.join(results.select(*TREATMENT).distinct(), TREATMENT, "left_anti")


def heldout_guard(requested: DataFrame, heldout: DataFrame) -> DataFrame:
    """Flag requests that hit the held-out set; doses are compared by their label."""
    key = ["drug", "cell_line", "_dose"]
    denied = heldout.withColumn("_dose", conc_key("concentration")).select(*key).distinct()
    return (
        requested.withColumn("_dose", conc_key("concentration"))
        .join(denied.withColumn("_denied", F.lit(True)), key, "left")
        .withColumn("restricted", F.coalesce("_denied", F.lit(False)))
        .drop("_denied", "_dose")
    )


def signature_coverage(signatures: DataFrame, genes: DataFrame, gene_col: str = "gene_symbol") -> DataFrame:
    """Genes of each signature that occur in the gene table."""
    known = genes.select(F.col(gene_col).alias("gene")).distinct().withColumn("_found", F.lit(1))
    return (
        signatures.join(known, "gene", "left")
        .groupBy("signature")
        .agg(F.count("_found").alias("n_found"), F.count(F.lit(1)).alias("n_total"))
    )


def treatment_grid(present: DataFrame, drugs: DataFrame, cell_lines: DataFrame) -> DataFrame:
    """Per drug: how many of all cell lines it could be paired with, how many it was, and which are missing.

    The grid itself is never built. Cell lines are numbered in order of name; the
    facts combine, before their shuffle, to a bitmap of tested lines per drug (words of
    64 lines), and the missing ones are the names whose bit is not set. The list of
    names is bounded by the vocabulary of cell lines.
    """
    names = cell_lines.where("cell_line IS NOT NULL").agg(F.array_sort(F.collect_set("cell_line")).alias("names"))
    numbered = names.select(F.posexplode("names").alias("i", "cell_line"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("i") % WORD_BITS)
    words = (
        present.select("drug", "cell_line")
        .join(numbered, "cell_line")
        .groupBy("drug", F.expr(f"i div {WORD_BITS}").cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
    )
    bitmaps = words.groupBy("drug").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_bits"), F.sum(F.bit_count("bits")).alias("_n")
    )

    def untested(name: Column, i: Column) -> Column:
        word = F.try_element_at("_bits", F.floor(i / WORD_BITS).cast("int"))
        return F.coalesce(F.call_function("shiftright", word, i % WORD_BITS).bitwiseAND(F.lit(1)) == 0, F.lit(True))

    listed = drugs.select("drug").distinct().join(bitmaps, "drug", "left").withColumn("_names", names.scalar())
    return listed.select(
        "drug",
        F.size("_names").cast("bigint").alias("n_potential"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_present"),
        F.filter("_names", untested).alias("missing"),
    ).withColumn("n_missing", F.size("missing").cast("bigint"))
