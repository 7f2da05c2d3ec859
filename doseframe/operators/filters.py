"""Filters, projections and listings over facts and metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doseframe.functions.columns import grams, is_ensembl, matches, within
from doseframe.schema import TREATMENT


def de_predicate(
    drug: str | None = None,
    concentration: float | None = None,
    cell_line: str | None = None,
    genes: Sequence[str] | None = None,
) -> Column:
    parts = [F.lit(True)]
    if drug is not None:
        parts.append(F.col("drug") == drug)
    if cell_line is not None:
        parts.append(F.col("cell_line") == cell_line)
    if concentration is not None:
        parts.append(within(F.col("concentration"), concentration))
    if genes is not None:
        parts.append(F.col("gene_name").isin(list(genes)))
    return reduce(and_, parts)


def fetch_de(
    de: DataFrame,
    drug: str | None = None,
    concentration: float | None = None,
    cell_line: str | None = None,
    genes: Sequence[str] | None = None,
    limit: int | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Rows of a treatment; every filter is optional. A limit needs an order to be repeatable."""
    rows = de.where(de_predicate(drug, concentration, cell_line, genes))
    if limit:
        if not order_by:
            raise ValueError("limit needs order_by")
        rows = rows.orderBy(*order_by).limit(limit)
    return rows


def conc_tolerance(de: DataFrame, target: float, eps: float = 0.001) -> DataFrame:
    return de.where(within(F.col("concentration"), target, eps))


def genes_in_list(de: DataFrame, genes: Sequence[str] | DataFrame, col: str = "gene_name") -> DataFrame:
    """Membership in a short literal list or in a one-column table."""
    if isinstance(genes, DataFrame):
        wanted = genes.select(F.col(genes.columns[0]).alias(col)).distinct()
        return de.join(wanted, col, "left_semi")
    return de.where(F.col(col).isin(list(genes)))


# Longest stretch of a name in the posting index; shorter ones serve requests that are shorter.
GRAM = 3


def postings(vocabulary: DataFrame, name_col: str) -> DataFrame:
    """Posting index of names: a row per name and distinct stretch of one to three characters, and one for the empty stretch."""
    parts = F.concat(F.array(F.lit("")), grams(F.col(name_col), range(1, GRAM + 1)))
    return vocabulary.where(F.col(name_col).isNotNull()).select(name_col, F.explode(parts).alias("_gram"))


def substring_matches(requested: DataFrame, vocabulary: DataFrame, request_col: str, name_col: str) -> DataFrame:
    """Pairs (request, name) where the name contains the request, ignoring case.

    Every stretch of a request is one of its names' too, so a request looks up the
    names under its rarest stretch of three characters only (the whole request if it
    is shorter) and those are verified. Index and lookup grow with the length of a
    name and not with its square.
    """
    index = postings(vocabulary, name_col)
    own = F.when(F.length(F.lower(request_col)) < GRAM, F.array(F.lower(request_col))).otherwise(grams(F.col(request_col), [GRAM]))
    asked = requested.select(request_col).distinct().select(request_col, F.explode(own).alias("_gram"))
    counts = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    # A stretch that no name has leaves the request without a match.
    rarest = (
        asked.join(counts, "_gram", "left")
        .groupBy(request_col)
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_rarest"))
        .where("_rarest.n > 0")
        .select(request_col, F.col("_rarest.gram").alias("_gram"))
    )
    hit = F.contains(F.lower(name_col), F.lower(request_col))
    return requested.select(request_col).join(rarest.join(index, "_gram").where(hit).drop("_gram"), request_col)


def validate_names(
    requested: DataFrame, vocabulary: DataFrame, request_col: str = "requested", name_col: str = "name", top: int = 5
) -> DataFrame:
    """Per requested name: whether it is known, and up to ``top`` similar names if not."""
    names = vocabulary.select(name_col).where(F.col(name_col).isNotNull()).distinct()
    asked = requested.select(request_col).distinct()
    known = asked.join(names.select(F.col(name_col).alias(request_col)), request_col, "left_semi")
    unknown = asked.join(names.select(F.col(name_col).alias(request_col)), request_col, "left_anti")
    first = Window.partitionBy(request_col).orderBy(name_col)
    similar = (
        substring_matches(unknown, names, request_col, name_col)
        .withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= top)
        .groupBy(request_col)
        .agg(F.array_sort(F.collect_list(name_col)).alias("similar"))
    )
    empty = F.array().cast("array<string>")
    return known.select(request_col, F.lit(True).alias("known"), empty.alias("similar")).unionByName(
        unknown.join(similar, request_col, "left").select(
            request_col, F.lit(False).alias("known"), F.coalesce("similar", empty).alias("similar")
        )
    )


def drugs_by_moa(drugs: DataFrame, moa: str, moa_type: str = "fine", literal: bool = False) -> DataFrame:
    return drugs.where(matches(F.col(f"`moa-{moa_type}`"), moa, literal))


def drugs_by_moa_fallback(drugs: DataFrame, moa: str, literal: bool = False) -> DataFrame:
    """Matches on the fine mechanism or, if there is none at all, on the broad one."""
    tier = F.when(matches(F.col("`moa-fine`"), moa, literal), F.lit(1)).when(
        matches(F.col("`moa-broad`"), moa, literal), F.lit(2)
    )
    hits = drugs.withColumn("tier", tier).where(F.col("tier").isNotNull())
    return hits.join(hits.agg(F.min("tier").alias("tier")), "tier", "left_semi")


# Column names of the cell-line table.
MUTATION_COLUMNS = [
    "cell_name",
    "Organ",
    "Driver_Gene_Symbol",
    "Driver_ProtEffect_or_CdnaEffect",
    "Driver_Mech_InferDM",
]


def cell_lines_by_mutation(cell_lines: DataFrame, gene: str) -> DataFrame:
    return cell_lines.where(F.col("Driver_Gene_Symbol") == gene).select(*MUTATION_COLUMNS).distinct()


def regex_or_filter(df: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Rows where any of the columns matches its pattern."""
    return df.where(reduce(or_, [matches(F.col(c), p) for c, p in patterns.items()]))


def has_stats() -> Column:
    return F.col("gene_name").isNotNull() & F.col("log2FoldChange").isNotNull() & F.col("padj").isNotNull()


def drop_unusable_genes(de: DataFrame) -> DataFrame:
    """Rows usable for ranking: no null statistic and an official gene symbol."""
    return de.where(has_stats() & ~is_ensembl("gene_name"))


def unusable_gene_counts(de: DataFrame, keys: Sequence[str] = tuple(TREATMENT)) -> DataFrame:
    """What ``drop_unusable_genes`` removes, per treatment."""
    return de.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~has_stats()).alias("n_null"),
        F.count_if(has_stats() & is_ensembl("gene_name")).alias("n_ensembl"),
        F.count_if(has_stats() & ~is_ensembl("gene_name")).alias("n_kept"),
    )


def select_existing_cols(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def coerce_numeric(df: DataFrame, numeric: Sequence[str], rename: Mapping[str, str] | None = None) -> DataFrame:
    """Rename columns, then parse the ``numeric`` ones to double; what does not parse becomes null."""
    renamed = df.withColumnsRenamed(dict(rename or {}))
    return renamed.withColumns({c: F.col(c).try_cast("double") for c in numeric})


# Result columns of a preranked enrichment run as they come, and our names.
# Column names of the enrichment test's result, and ours.
RESULT_COLUMNS = {
    "Term": "pathway",
    "NES": "nes",
    "NOM p-val": "pvalue",
    "FDR q-val": "fdr",
    "Lead_genes": "leading_edge",
}


def treatments_for_cell_line(index: DataFrame, cell_line: str) -> DataFrame:
    return index.where(F.col("cell_line") == cell_line).select("drug", "concentration").distinct()


def sample_treatments(samples: DataFrame, cell_line: str | None = None) -> DataFrame:
    rows = samples if cell_line is None else samples.where(F.col("cell_line") == cell_line)
    return rows.select("sample", "drug", "drugname_drugconc")


def list_vocab(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)
