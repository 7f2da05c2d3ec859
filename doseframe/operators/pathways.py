"""Reading enrichment results: lookups and rankings per treatment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doseframe.functions.columns import matches
from doseframe.schema import TREATMENT


def _ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*TREATMENT).orderBy(*order, "pathway")))


def significant_pathways(enrichment: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Pathways below the FDR threshold with their place by absolute NES."""
    return _ranked(enrichment.where(F.col("fdr") < threshold), F.abs("nes").desc())


def pathway_exact(enrichment: DataFrame, pathway: str | DataFrame) -> DataFrame:
    """One pathway by exact name, or all those of a request table with a ``pathway`` column."""
    if isinstance(pathway, DataFrame):
        return enrichment.join(pathway.select("pathway").distinct(), "pathway", "left_semi")
    return enrichment.where(F.col("pathway") == pathway)


def pathway_partial(enrichment: DataFrame, pattern: str, literal: bool = False) -> DataFrame:
    """Per treatment the best partial match: the exact name (any case) if it is
    unique, else the first by name."""
    exact = (F.lower("pathway") == pattern.lower()).cast("int")
    hits = enrichment.where(matches(F.col("pathway"), pattern, literal))
    per_treatment = Window.partitionBy(*TREATMENT)
    prefer = F.when(F.sum(exact).over(per_treatment) == 1, exact).otherwise(0)
    n_matches = F.count(F.lit(1)).over(per_treatment)
    return (
        _ranked(hits.withColumns({"_prefer": prefer, "n_matches": n_matches}), F.col("_prefer").desc())
        .where("rank = 1")
        .drop("_prefer", "rank")
    )


def list_pathways(enrichment: DataFrame) -> DataFrame:
    return enrichment.select(*TREATMENT, "pathway").distinct().orderBy(*TREATMENT, "pathway")


def top_activated(enrichment: DataFrame, n: int = 10) -> DataFrame:
    return _ranked(enrichment.where("nes > 0"), F.col("nes").desc()).where(F.col("rank") <= n)


def top_repressed(enrichment: DataFrame, n: int = 10) -> DataFrame:
    return _ranked(enrichment.where("nes < 0"), F.col("nes").asc()).where(F.col("rank") <= n)


def sig_top_bottom(enrichment: DataFrame, threshold: float = 0.25, n: int = 5) -> DataFrame:
    """Below the threshold: the n strongest up and the n strongest down."""
    kept = enrichment.where(F.col("fdr") < threshold)
    up = top_activated(kept, n).withColumn("side", F.lit("up"))
    return up.unionByName(top_repressed(kept, n).withColumn("side", F.lit("down")))


def top_genes(de: DataFrame, n: int = 10) -> DataFrame:
    """Per treatment the n genes with the highest and the lowest fold change, symbols only."""
    genes = de.where(~F.coalesce(F.startswith("gene_name", F.lit("ENSG")), F.lit(False))).where(
        "log2FoldChange IS NOT NULL"
    )

    # Each row stands for both sides, so facts are read once; the rank limit is applied before the shuffle.
    sides = F.explode(F.array(F.lit("up"), F.lit("down"))).alias("side")
    signed = genes.select(*TREATMENT, "gene_name", "log2FoldChange", "padj", sides)
    height = F.when(F.col("side") == "up", -F.col("log2FoldChange")).otherwise(F.col("log2FoldChange"))
    place = Window.partitionBy(*TREATMENT, "side").orderBy(height, "gene_name", "padj")
    return signed.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)
