"""Preranked gene-set enrichment as joins, windows and group-bys.

A treatment is first reduced to one row per gene by an aggregate with a
map-side step. From there on a treatment is as large as the set of gene
symbols, however many fact rows it had, and every window below runs inside the
one hash partitioning by treatment. Operators here take and give frames keyed
by ``KEY``; ``public`` turns a result into ordinary treatment columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from doseframe.functions.columns import gene_code, permutation_key, rank_metric
from doseframe.functions.frames import spread
from doseframe.operators.filters import drop_unusable_genes

# Running sums are compared after rounding, so that equal peaks and troughs do
# not depend on the last digit of a float sum.
DIGITS = 10

# Inside this module the dose is a string: Spark normalises double keys anew in
# each operator, which hides that rows are already partitioned by treatment.
KEY = ["cell_line", "drug", "dose"]
SETS = [*KEY, "pathway"]

# Partitions by treatment, as a multiple of the session's shuffle partitions.
TREATMENT_SPREAD = 4


def keyed(df: DataFrame) -> DataFrame:
    """Replace the dose number by its text, which parses back to the same number."""
    return df.withColumn("dose", (F.col("concentration") + F.lit(0.0)).cast("string")).drop("concentration")


def public(df: DataFrame) -> DataFrame:
    """Back to the treatment columns all other operators use."""
    return df.withColumn("concentration", F.col("dose").cast("double")).drop("dose")


def best_rows(de: DataFrame, row_key: str) -> DataFrame:
    """One row per treatment and upper-cased gene symbol: that with the lowest ``row_key``.

    The key is a number, unique for a gene of a treatment (for example file and
    row number in one). Numbers and doubles have buffers of fixed width, so both
    sides of the shuffle aggregate by hash and no fact is sorted.
    """
    return (
        keyed(drop_unusable_genes(de))
        .groupBy(*KEY, F.upper("gene_name").alias("gene"))
        .agg(F.min_by("log2FoldChange", row_key).alias("log2FoldChange"), F.min_by("padj", row_key).alias("padj"))
    )


def rank_rows(best: DataFrame, spread_out: bool = True) -> DataFrame:
    """Position (from 0, highest metric first) and gene count within each treatment.

    Rows that already lie in buckets by treatment need not be spread again.
    """
    per_treatment = Window.partitionBy(*KEY)
    kept = [c for c in best.columns if c == "pathways"]
    scored = best.select(*KEY, "gene", *kept, rank_metric(F.col("log2FoldChange"), F.col("padj")).alias("metric"))
    # More partitions than usual, so that few treatments share a task.
    return (spread(scored, *KEY, times=TREATMENT_SPREAD) if spread_out else scored).withColumns(
        {
            "position": F.row_number().over(per_treatment.orderBy(F.col("metric").desc(), "gene")) - 1,
            "n_genes": F.count(F.lit(1)).over(per_treatment),
        }
    )


def ranked_genes(de: DataFrame, row_key: str) -> DataFrame:
    return rank_rows(best_rows(de, row_key))


def library(sets: DataFrame) -> DataFrame:
    return sets.select("pathway", F.upper("gene").alias("gene")).distinct()


def with_pathways(best: DataFrame, members: DataFrame) -> DataFrame:
    """``best`` with the sets of each gene as one array, null for genes in no set."""
    return best.join(members.groupBy("gene").agg(F.collect_list("pathway").alias("pathways")), "gene", "left")


def has_size(min_size: int, max_size: int | None) -> Column:
    """An allowed set size; without an upper limit every set of ``min_size`` genes or more has one."""
    return F.col("size") >= min_size if max_size is None else F.col("size").between(min_size, max_size)


def rankable_genes(best: DataFrame, sets: DataFrame, min_size: int = 15, max_size: int | None = 500, spread_out: bool = True) -> DataFrame:
    """The rows of ``rank_rows`` for treatments with at least one set of an allowed size; others have no result.

    Set sizes are counted before their shuffle, from names alone. The treatments to rank, one
    short row each, are broadcast, so the facts of all others are left out where they are read:
    they are never shuffled, sorted, joined with their sets or sent to Python.

    The sets of a gene (of those with an allowed size anywhere) come along as an array, so that
    genes meet their sets while they are still dealt by gene and stay with their treatment
    afterwards. Rows that have the array already are not joined again.
    """
    size = F.count("pathway")
    # Treatments with a null in their key stay, and ``with_sets`` counts their sets.
    wanted = has_size(min_size, max_size) | F.greatest(*[F.col(c).isNull() for c in KEY])
    has_sets = "pathways" in best.columns
    # Nulls go here, as they would below from one use of the sizes only, which would then be counted twice.
    named = library(sets).where("pathway IS NOT NULL")
    members = best.select(*KEY, F.explode("pathways").alias("pathway")) if has_sets else best.join(named, "gene")
    allowed = members.groupBy(*SETS).agg(size.alias("size")).where(wanted)
    treatments = allowed.select(*[F.col(c).alias(f"_{c}") for c in KEY]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
    chosen = best.join(F.broadcast(treatments), same, "left_semi")
    if not has_sets:
        chosen = with_pathways(chosen, named.join(allowed.select("pathway").distinct(), "pathway"))
    return rank_rows(chosen, spread_out)


def with_sets(ranked: DataFrame, sets: DataFrame, min_size: int = 15, max_size: int | None = 500) -> DataFrame:
    """All ranked genes, once per set they are in; ``kept`` marks sets whose overlap has an allowed size.

    The window is sorted as those of ``scored_members`` and the grouped map are, so one sort serves all of them.
    """
    if "pathways" in ranked.columns:
        named = ranked.withColumn("pathway", F.explode_outer("pathways")).drop("pathways")
    else:
        named = ranked.join(library(sets), "gene", "left")
    whole = Window.partitionBy(*SETS).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return named.withColumn("size", F.count("pathway").over(whole)).withColumn(
        "kept", F.col("pathway").isNotNull() & has_size(min_size, max_size)
    )


def set_membership(ranked: DataFrame, sets: DataFrame, min_size: int = 15, max_size: int | None = 500) -> DataFrame:
    """Ranked genes with each set they are in, for sets whose overlap with the ranking has an allowed size."""
    return with_sets(ranked, sets, min_size, max_size).where("kept").drop("kept")


def _grouped(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, WindowSpec]:
    """A window over ``keys`` that sorts by a hash of them first.

    Sorting compares one number instead of several strings; the keys
    themselves follow, so equal hashes do no harm.
    """
    return df.withColumn("_g", F.xxhash64(*keys)), Window.partitionBy("_g", *keys)


def _running_sums(hits: DataFrame, group: WindowSpec) -> DataFrame:
    """Running sum right after (``above``) and right before (``below``) each hit.

    Between hits the sum only falls, so its extremes are found at hits alone.
    Both are null when all hits weigh nothing or every gene is a hit.
    """
    ordered = group.orderBy("position")
    weighed = hits.withColumn("_w", F.abs("metric")).withColumns(
        {
            "_before": F.row_number().over(ordered) - 1,
            "_upto": F.sum("_w").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_total": F.sum("_w").over(group),
            "_hits": F.count(F.lit(1)).over(group),
        }
    )
    missed = F.try_divide(F.col("position") - F.col("_before"), F.col("n_genes") - F.col("_hits"))
    return weighed.withColumns(
        {
            "above": F.try_divide(F.col("_upto"), F.col("_total")) - missed,
            "below": F.try_divide(F.col("_upto") - F.col("_w"), F.col("_total")) - missed,
        }
    )


def _peak_or_trough(high: Column, low: Column) -> Column:
    return F.when(high >= -low, high).otherwise(low)


def scored_members(members: DataFrame) -> DataFrame:
    """Set members with their set's enrichment score and whether they are in its leading edge."""
    group = Window.partitionBy(*SETS)
    high = F.struct(F.round("above", DIGITS).alias("above"), (-F.col("position")).alias("p"))
    low = F.struct(F.round("below", DIGITS).alias("below"), F.col("position").alias("p"))
    sums = _running_sums(members, group).withColumns({"_high": F.max(high).over(group), "_low": F.min(low).over(group)})
    es = _peak_or_trough(F.col("_high.above"), F.col("_low.below"))
    in_edge = F.when(es > 0, F.col("position") <= -F.col("_high.p")).when(es < 0, F.col("position") >= F.col("_low.p"))
    return sums.select(*members.columns, es.alias("es"), F.coalesce(in_edge, F.lit(False)).alias("in_edge"))


def score_sets(scored: DataFrame) -> DataFrame:
    """Enrichment score, size and leading edge per treatment and set."""
    edge = F.array_sort(F.collect_list(F.when(F.col("in_edge"), F.struct("position", "gene"))))
    return scored.groupBy(*SETS).agg(
        F.first("size").alias("size"),
        F.first("es").alias("es"),
        F.array_join(F.transform(edge, lambda g: g.gene), ";").alias("leading_edge"),
    )


def enrichment_score(members: DataFrame) -> DataFrame:
    return score_sets(scored_members(members)).select(*SETS, "size", "es")


def leading_edge(members: DataFrame) -> DataFrame:
    return score_sets(scored_members(members)).select(*SETS, "leading_edge")


def permutation_base(seed: int) -> int:
    """First permutation number of a seed; permutations of one run are consecutive."""
    return seed * 100_000


def null_scores(annotated: DataFrame, permutations: int, seed: int = 42) -> DataFrame:
    """Score of every kept set under each gene permutation, as rows.

    Takes the rows of ``with_sets``. This form makes treatments x permutations
    x genes rows and suits few permutations; ``nulls.null_tails`` is the form
    for many. Rows never leave their treatment's partition: the weights by
    position join as one array per treatment.
    """
    genes = annotated.groupBy(*KEY, "gene", "position", "metric", "n_genes").agg(
        F.collect_list(F.when(F.col("kept"), F.col("pathway"))).alias("_pathways")
    )
    by_position = F.array_sort(F.collect_list(F.struct("position", "metric")))
    weights = genes.groupBy(*KEY).agg(F.transform(by_position, lambda g: g.metric).alias("_weights"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("permutation")
    number = F.col("permutation") + F.lit(permutation_base(seed)).cast("bigint")
    repeated = genes.select(*KEY, "gene", "n_genes", "_pathways", gene_code("gene").alias("_code"), numbers)
    repeated, group = _grouped(repeated, [*KEY, "permutation"])
    shuffled = (
        repeated.withColumn("_key", permutation_key(F.col("_code"), number))
        .withColumn("position", F.row_number().over(group.orderBy("_key", "gene")) - 1)
        .where(F.size("_pathways") > 0)
    )
    hits = shuffled.join(weights, KEY).select(
        *KEY,
        "permutation",
        "position",
        "n_genes",
        F.col("_weights")[F.col("position")].alias("metric"),
        F.explode("_pathways").alias("pathway"),
    )
    keys = [*SETS, "permutation"]
    hits, group = _grouped(hits, keys)
    return (
        _running_sums(hits, group)
        .groupBy(*keys)
        .agg(_peak_or_trough(F.round(F.max("above"), DIGITS), F.round(F.min("below"), DIGITS)).alias("null_es"))
    )


def normalised(score: Column, mean: Column) -> Column:
    return F.round(F.try_divide(score, mean), DIGITS)


def null_tails_from_rows(scores: DataFrame, nulls: DataFrame) -> DataFrame:
    """``scores`` with the null tail counts of each set and of all sets of the treatment.

    Observed and null scores go through the same windows, so null rows are
    read once and tails are cumulative counts, not a join of scores with nulls.
    """
    observed = scores.withColumns({"value": F.col("es"), "is_null": F.lit(0)})
    # A shuffle of the reduced rows, so that one task does not hold the sorts of both halves of the job.
    permuted = spread(nulls.select(*SETS, F.col("null_es").alias("value"), F.lit(1).alias("is_null")), *KEY)
    per_set = Window.partitionBy(*SETS)
    null, value, es = F.col("is_null") == 1, F.col("value"), F.col("_es")
    same = null & ((value >= 0) == (es >= 0))
    summarised = (
        observed.unionByName(permuted, allowMissingColumns=True)
        .where(value.isNotNull())
        .withColumns(
            {
                "_es": F.max("es").over(per_set),
                "_up": F.avg(F.when(null & (value >= 0), value)).over(per_set),
                "_down": F.avg(F.when(null & (value < 0), -value)).over(per_set),
            }
        )
        .withColumns(
            {
                "null_n": F.count(F.when(same, value)).over(per_set),
                "null_extreme": F.count(F.when(same & (F.abs(value) >= F.abs(es)), value)).over(per_set),
            }
        )
        .withColumn("null_mean", F.when(value >= 0, F.col("_up")).otherwise(F.col("_down")))
        .withColumn("_nes", normalised(value, F.col("null_mean")))
    )
    sign = Window.partitionBy(*KEY, F.col("_nes") >= 0)
    tail = sign.orderBy(F.abs("_nes").desc())
    pooled = summarised.withColumns({"pool_n": F.sum("is_null").over(sign), "pool_extreme": F.sum("is_null").over(tail)})
    counts = ["null_mean", "null_n", "null_extreme", "pool_n", "pool_extreme"]
    unscored = scores.where("es IS NULL")
    return pooled.where(~null).select(*scores.columns, *counts).unionByName(unscored, allowMissingColumns=True)


def nes_pvalue(tails: DataFrame) -> DataFrame:
    """Normalised score and nominal p-value; both null without a null score of the same sign."""
    return tails.withColumns(
        {
            "nes": normalised(F.col("es"), F.col("null_mean")),
            "pvalue": F.try_divide(F.col("null_extreme"), F.col("null_n")),
        }
    )


def fdr_qvalue(scored: DataFrame) -> DataFrame:
    """Share of the pooled null in the tail over the share of observed scores in it, at most 1."""
    sign = Window.partitionBy(*KEY, F.col("nes") >= 0)
    observed_share = F.try_divide(F.count("nes").over(sign.orderBy(F.abs("nes").desc())), F.count("nes").over(sign))
    null_share = F.try_divide(F.col("pool_extreme"), F.col("pool_n"))
    q = F.least(F.lit(1.0), null_share / F.col("_observed_share"))
    return (
        scored.withColumn("_observed_share", F.when(F.col("nes").isNotNull(), observed_share))
        .withColumn("fdr", F.when(F.col("nes").isNotNull(), q))
        .drop("_observed_share")
    )


def significance(tails: DataFrame) -> DataFrame:
    return fdr_qvalue(nes_pvalue(tails)).select(*SETS, "size", "es", "nes", "pvalue", "fdr", "leading_edge")
