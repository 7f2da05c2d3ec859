"""Group-by operators. All use aggregates with a map-side step, so a hot key shrinks before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseframe.functions.columns import is_ensembl, pct_change
from doseframe.schema import TREATMENT


def signature_scores(de: DataFrame, signatures: DataFrame, by: Sequence[str] = ("drug", "cell_line")) -> DataFrame:
    """Mean fold change, lowest padj, gene count and percent change per group and signature.

    One pass over the facts scores all signatures; the result is long.
    """
    genes = signatures.select("signature", F.col("gene").alias("gene_name")).distinct()
    return (
        de.join(genes, "gene_name")
        .groupBy(*by, "signature")
        .agg(
            F.avg("log2FoldChange").alias("log2fc"),
            F.min("padj").alias("padj"),
            F.count("gene_name").alias("n_genes"),
        )
        .withColumn("pct_change", pct_change("log2fc"))
    )


def pathway_activity(de: DataFrame, signatures: DataFrame) -> DataFrame:
    """Signature scores per full treatment, dose included."""
    return signature_scores(de, signatures, ("drug", "cell_line", "concentration"))


def wide_scores(scores: DataFrame, names: Sequence[str], keys: Sequence[str] = ("drug", "cell_line")) -> DataFrame:
    """Long scores to one row per group; the gene count is the first signature's."""
    wide = scores.groupBy(*keys).pivot("signature", list(names)).agg(
        F.first("log2fc").alias("log2fc"),
        F.first("padj").alias("padj"),
        F.first("pct_change").alias("pct_change"),
        F.first("n_genes").alias("n_genes"),
    )
    measures = [f"{n}_{m}" for n in names for m in ("log2fc", "padj", "pct_change")]
    return wide.select(*keys, *measures, F.col(f"{names[0]}_n_genes").alias("n_genes"))


def treatment_index(de: DataFrame) -> DataFrame:
    """Each treatment with the lowest file number it occurs in."""
    return de.groupBy(*TREATMENT).agg(F.min("file_num").alias("file_num"))


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    counts = (
        df.where(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "value")
    )
    return counts.limit(n) if n else counts


def metadata_summary(drugs: DataFrame, cell_lines: DataFrame, genes: DataFrame) -> DataFrame:
    """Counts over the metadata tables as (metric, value) rows, one pass per table."""

    def counts(df: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
        wide = df.agg(*[m.cast("bigint").alias(k) for k, m in measures.items()])
        return wide.unpivot([], list(measures), "metric", "value")

    return (
        counts(
            drugs,
            {
                "drugs": F.count(F.lit(1)),
                "moa_broad": F.count_distinct("moa-broad"),
                "moa_fine": F.count_distinct("moa-fine"),
            },
        )
        .unionByName(
            counts(
                cell_lines,
                {
                    "cell_lines": F.count_distinct("cell_name"),
                    "driver_genes": F.count_distinct("Driver_Gene_Symbol"),
                    "cell_line_entries": F.count(F.lit(1)),
                },
            )
        )
        .unionByName(counts(genes, {"genes": F.count(F.lit(1))}))
    )


def organ_distribution(cell_lines: DataFrame, order_col: str) -> DataFrame:
    """Number of cell lines per organ, each counted under its first organ."""
    first = cell_lines.groupBy("cell_name").agg(
        F.min_by("Organ", F.when(F.col("Organ").isNotNull(), F.col(order_col))).alias("Organ")
    )
    return value_counts(first, "Organ").withColumnsRenamed({"value": "organ"})


def gene_name_breakdown(de: DataFrame, keys: Sequence[str] = tuple(TREATMENT)) -> DataFrame:
    """Rows with a symbol and rows with only an Ensembl id, with percentages."""
    counted = de.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_ensembl("gene_name")).alias("ensembl_only")
    )
    symbol = F.col("total") - F.col("ensembl_only")
    return counted.withColumns(
        {
            "has_symbol": symbol,
            "symbol_pct": 100 * symbol / F.col("total"),
            "ensembl_pct": 100 * F.col("ensembl_only") / F.col("total"),
        }
    )


def avg_lfc_by_treatment(de: DataFrame, gene: str | None = None) -> DataFrame:
    rows = de if gene is None else de.where(F.col("gene_name") == gene)
    return rows.groupBy("drug", "cell_line").agg(F.avg("log2FoldChange").alias("mean_lfc"))


def question_summary(items: DataFrame) -> DataFrame:
    n_true = F.count_if(F.col("ground_truth"))
    return items.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        n_true.alias("n_true"),
        (100 * n_true / F.count(F.lit(1))).alias("pct_true"),
    )


def truth_by_mutation(items: DataFrame, cell_lines: DataFrame, gene_a: str, gene_b: str) -> DataFrame:
    """Outcomes for cell lines with a mutation in one gene, in the other, or in neither.

    A cell line with both counts in both groups.
    """
    status = cell_lines.groupBy(F.col("cell_name").alias("cell_line")).agg(
        F.coalesce(F.bool_or(F.col("Driver_Gene_Symbol") == gene_a), F.lit(False)).alias("_a"),
        F.coalesce(F.bool_or(F.col("Driver_Gene_Symbol") == gene_b), F.lit(False)).alias("_b"),
    )
    a, b = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    groups = F.array_compact(
        F.array(
            F.when(a, F.lit(f"{gene_a} mutant")),
            F.when(b, F.lit(f"{gene_b} mutant")),
            F.when(~a & ~b, F.lit("neither")),
        )
    )
    return (
        items.join(status, "cell_line", "left")
        .select("question_id", "ground_truth", "nes", F.explode(groups).alias("mutation_group"))
        .groupBy("question_id", "mutation_group")
        .agg(
            F.count(F.lit(1)).alias("n_items"),
            F.count_if(F.col("ground_truth")).alias("n_true"),
            F.avg("nes").alias("mean_nes"),
        )
    )
