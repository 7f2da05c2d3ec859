"""Enrichment jobs: from facts to stored results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseframe.functions.columns import is_ensembl
from doseframe.operators import enrichment as E
from doseframe.operators.filters import has_stats
from doseframe.operators.joins import skip_cached
from doseframe.operators.nulls import null_tails
from doseframe.operators.sets import union_results
from doseframe.schema import TREATMENT
from doseframe.sources.results import write_bucketed


@dataclass(frozen=True)
class Prerank:
    """Parameters of an enrichment run; the defaults are the usual ones. Without ``max_size`` no set is too large."""

    min_size: int = 15
    max_size: int | None = 500
    permutations: int = 1000
    seed: int = 42


def prerank_ranked(ranked: DataFrame, sets: DataFrame, params: Prerank = Prerank()) -> DataFrame:
    scored = E.scored_members(E.with_sets(ranked, sets, params.min_size, params.max_size))
    return E.public(E.significance(null_tails(scored, params.permutations, params.seed)))


def prerank(de: DataFrame, sets: DataFrame, row_key: str, params: Prerank = Prerank()) -> DataFrame:
    """Enrichment of every treatment in ``de``: one shuffle by treatment and gene, one by gene for the sets, one by treatment, and a count of set sizes."""
    ranked = E.rankable_genes(E.best_rows(de, row_key), sets, params.min_size, params.max_size)
    return prerank_ranked(ranked, sets, params)


def prerank_relational(
    de: DataFrame, sets: DataFrame, row_key: str, params: Prerank = Prerank()
) -> DataFrame:
    """The same results without Python, for few permutations."""
    ranked = E.rankable_genes(E.best_rows(de, row_key), sets, params.min_size, params.max_size)
    annotated = E.with_sets(ranked, sets, params.min_size, params.max_size)
    scores = E.score_sets(E.scored_members(annotated.where("kept")))
    nulls = E.null_scores(annotated, params.permutations, params.seed)
    return E.public(E.significance(E.null_tails_from_rows(scores, nulls)))


def enrich_cell_line(
    de: DataFrame,
    sets: DataFrame,
    row_key: str,
    cell_line: str,
    drugs: Sequence[str] | None = None,
    cached: DataFrame | None = None,
    params: Prerank = Prerank(),
) -> DataFrame:
    """All treatments of one cell line; stored results are reused and only the rest is computed."""
    wanted = F.col("cell_line") == cell_line
    if drugs is not None:
        wanted = wanted & F.col("drug").isin(list(drugs))
    todo = de.where(wanted)
    if cached is None:
        return prerank(todo, sets, row_key, params)
    stored = cached.where(wanted)
    return union_results([stored, prerank(skip_cached(todo, stored), sets, row_key, params)])


def index_and_enrich(
    de: DataFrame, sets: DataFrame, row_key: str, path: str, params: Prerank = Prerank(), buckets: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Treatment index and enrichment from one pass over the facts.

    The pass reduces the facts to one row per treatment and gene, which is
    written to ``path``, a new folder in shared storage that the caller owns, in
    ``buckets`` by treatment (the session's number of shuffle partitions by default).
    Each gene takes its sets along, so index, set sizes, ranking and scores all read the
    buckets as they are: none shuffles again.
    """
    usable = has_stats() & ~is_ensembl("gene_name")
    key = F.when(usable, F.col(row_key))
    reduced = E.keyed(de).groupBy(*E.KEY, F.upper("gene_name").alias("gene")).agg(
        F.min_by("log2FoldChange", key).alias("log2FoldChange"),
        F.min_by("padj", key).alias("padj"),
        F.min("file_num").alias("file_num"),
    )
    genes = write_bucketed(E.with_pathways(reduced, E.library(sets)), path, E.KEY, buckets)
    index = E.public(genes.groupBy(*E.KEY).agg(F.min("file_num").alias("file_num")))
    usable_genes = genes.where("gene IS NOT NULL AND log2FoldChange IS NOT NULL AND padj IS NOT NULL")
    ranked = E.rankable_genes(usable_genes, sets, params.min_size, params.max_size, spread_out=False)
    return index.select(*TREATMENT, "file_num"), prerank_ranked(ranked, sets, params)
