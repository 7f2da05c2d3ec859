"""Nested metadata records and text cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doseframe.functions.columns import fixed
from doseframe.operators.filters import substring_matches
from doseframe.schema import TREATMENT


# The lines of the text cards.
DRUG_LINES = [
    "# %s",
    "- Mechanism (broad): %s",
    "- Mechanism (fine): %s",
    "- Targets: %s",
    "- Human approved: %s",
    "- Clinical trials: %s",
]
DRUG_CID_LINE = "- PubChem CID: %d"
CELL_LINE_LINES = ["# %s", "- Organ/tissue: %s", "- Driver mutations (%d):"]
NO_MUTATIONS_LINE = "  (no annotated driver mutations)"
EXPERIMENT_LINES = [
    "# Experiment Results: %s @ %suM in %s",
    "",
    "## Cell Line Context",
    "- Organ: %s",
    "- Driver mutations: %s",
    "",
    "## Drug Context",
    "- Mechanism: %s",
    "- Targets: %s",
    "",
    "## Pathway Activities",
    "Significant pathways (FDR < %s): %d",
    "",
    "### Top Activated Pathways (positive NES):",
]
REPRESSED_LINES = ["", "### Top Repressed Pathways (negative NES):"]
PATHWAY_LINE = "- %s: NES=%s, FDR=%s"
NO_PATHWAY_LINE = "(none)"
UNKNOWN, UNANNOTATED = "Unknown", "None annotated"
NOT_FOUND, WILDTYPE = "NOT FOUND", "wildtype"


def _yes(col: str) -> Column:
    return F.coalesce(F.lower(F.col(f"`{col}`")) == "yes", F.lit(False))


def parse_drugs(drugs: DataFrame, order_col: str) -> DataFrame:
    """Typed drug records; of several rows for a drug the last by ``order_col`` counts."""
    fields = [c for c in drugs.columns if c not in ("drug", order_col)]
    last = (
        drugs.groupBy("drug")
        .agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in fields]), F.col(order_col)).alias("_r"))
        .select("drug", "_r.*")
    )
    listed = F.nullif(F.col("targets"), F.lit("None"))
    return last.select(
        "drug",
        F.transform(F.split(listed, ","), lambda t: F.trim(t)).alias("targets"),
        F.col("`moa-broad`").alias("moa_broad"),
        F.col("`moa-fine`").alias("moa_fine"),
        _yes("human-approved").alias("human_approved"),
        _yes("clinical-trials").alias("clinical_trials"),
        F.col("canonical_smiles"),
        F.col("pubchem_cid").try_cast("bigint").alias("pubchem_cid"),
    )


def nest_cell_lines(cells: DataFrame, order_col: str) -> DataFrame:
    """One record per cell line with its distinct driver mutations, by their first place.

    Repeated rows are combined first, so a list is no longer than the curated
    mutation vocabulary; rows without a gene are left out of it.
    """
    fields = {
        "gene_symbol": "Driver_Gene_Symbol",
        "protein_effect": "Driver_ProtEffect_or_CdnaEffect",
        "var_type": "Driver_VarType",
        "var_zygosity": "Driver_VarZyg",
        "mechanism": "Driver_Mech_InferDM",
        "gene_type": "Driver_GeneType_DM",
    }
    distinct = cells.groupBy(F.col("cell_name").alias("cell_line"), *[F.col(c).alias(n) for n, c in fields.items()]).agg(
        F.min(order_col).alias("ord"), F.min_by("Organ", F.col(order_col)).alias("_organ")
    )
    named = F.when(F.col("gene_symbol").isNotNull(), F.struct("ord", *fields))
    return (
        distinct.groupBy("cell_line")
        .agg(
            F.min_by("_organ", "ord").alias("organ"),
            F.array_sort(F.collect_list(named)).alias("_m"),
        )
        .select("cell_line", "organ", F.transform("_m", lambda m: m.dropFields("ord")).alias("driver_mutations"))
    )


def has_mutation(gene: Column | str) -> Column:
    wanted = F.lit(gene) if isinstance(gene, str) else gene
    return F.exists("driver_mutations", lambda m: m.gene_symbol == wanted)


def mutation_arrays(nested: DataFrame, gene: str) -> DataFrame:
    """Whether a gene is mutated, and the oncogene and suppressor mutations."""
    return nested.withColumns(
        {
            "has_mutation": has_mutation(gene),
            "oncogenes": F.filter("driver_mutations", lambda m: m.gene_type == "Oncogene"),
            "tumor_suppressors": F.filter("driver_mutations", lambda m: m.gene_type == "Suppressor"),
        }
    )


def mutation_status(requested: DataFrame, cells: DataFrame, gene: str, order_col: str) -> DataFrame:
    """Per requested cell line (partial name): first effect in ``gene``, wildtype, or not found."""
    pairs = substring_matches(requested, cells.select("cell_name").distinct(), "requested", "cell_name")
    in_gene = F.col("Driver_Gene_Symbol") == gene
    found = (
        pairs.join(cells, "cell_name")
        .groupBy("requested")
        .agg(
            F.min_by("Driver_ProtEffect_or_CdnaEffect", F.when(in_gene, F.col(order_col))).alias("_effect"),
            F.count_if(in_gene).alias("_n"),
        )
    )
    status = (
        F.when(F.col("_n").isNull(), F.lit(NOT_FOUND))
        .when(F.col("_n") == 0, F.lit(WILDTYPE))
        .otherwise(F.coalesce("_effect", F.lit("")))
    )
    return requested.join(found, "requested", "left").select("requested", status.alias("status"))


def drug_lookup_status(requested: DataFrame, drugs: DataFrame, order_col: str) -> DataFrame:
    """Per requested drug (partial name): mechanism of the first match, or not found."""
    pairs = substring_matches(requested, drugs.select("drug").distinct(), "requested", "drug")
    found = (
        pairs.join(drugs, "drug")
        .groupBy("requested")
        .agg(F.min_by("moa-fine", F.col(order_col)).alias("_moa"), F.count(F.lit(1)).alias("_n"))
    )
    status = F.when(F.col("_n").isNull(), F.lit(NOT_FOUND)).otherwise(F.col("_moa"))
    return requested.join(found, "requested", "left").select("requested", status.alias("status"))


def _yes_no(flag: str) -> Column:
    return F.when(F.col(flag), F.lit("Yes")).otherwise(F.lit("No"))


def _targets(col: Column) -> Column:
    return F.coalesce(F.when(F.size(col) > 0, F.array_join(col, ", ")), F.lit(UNKNOWN))


def drug_report(drugs: DataFrame) -> DataFrame:
    """Text card per parsed drug."""
    card = F.format_string(
        "\n".join(DRUG_LINES),
        "drug",
        "moa_broad",
        "moa_fine",
        _targets(F.col("targets")),
        _yes_no("human_approved"),
        _yes_no("clinical_trials"),
    )
    cid = F.when(F.col("pubchem_cid") != 0, F.format_string(DRUG_CID_LINE, "pubchem_cid"))
    return drugs.select("drug", F.concat_ws("\n", card, cid).alias("report"))


def _mutation_line(m: Column) -> Column:
    effect = F.when(F.length(m.protein_effect) > 0, F.concat(F.lit(" ("), m.protein_effect, F.lit(")")))
    mechanism = F.when(F.length(m.mechanism) > 0, F.concat(F.lit(" ["), m.mechanism, F.lit("]")))
    return F.concat(
        F.lit("  - "),
        m.gene_symbol,
        F.coalesce(effect, F.lit("")),
        F.lit(": "),
        F.coalesce(m.var_type, F.lit(UNKNOWN)),
        F.coalesce(mechanism, F.lit("")),
        F.lit(" ("),
        F.coalesce(m.gene_type, F.lit(UNKNOWN)),
        F.lit(")"),
    )


def cell_line_report(nested: DataFrame) -> DataFrame:
    """Text card per nested cell line."""
    count = F.size("driver_mutations")
    head = F.format_string("\n".join(CELL_LINE_LINES), "cell_line", "organ", count)
    body = F.when(count == 0, F.lit(NO_MUTATIONS_LINE)).otherwise(
        F.array_join(F.transform("driver_mutations", _mutation_line), "\n")
    )
    return nested.select("cell_line", F.concat_ws("\n", head, body).alias("report"))


def experiment_report(enrichment: DataFrame, treatments: DataFrame, threshold: float = 0.05, top: int = 5) -> DataFrame:
    """Observation per assembled treatment: context, number of significant pathways, strongest up and down.

    A treatment without results gets an empty observation. Results are read once:
    a place among those of the same sign serves both lists.
    """
    sign = F.signum("nes").cast("int")
    place = Window.partitionBy(*TREATMENT, "_sign").orderBy(F.abs("nes").desc(), "pathway")
    ranked = enrichment.withColumn("_sign", sign).withColumn("rank", F.row_number().over(place))

    def strongest(side: int) -> Column:
        item = F.when((F.col("_sign") == side) & (F.col("rank") <= top), F.struct("rank", "pathway", "nes", "fdr"))
        return F.array_sort(F.collect_list(item))

    found = ranked.groupBy(*TREATMENT).agg(
        F.count_if(F.col("fdr") < threshold).alias("_n"), strongest(1).alias("top_activated"), strongest(-1).alias("top_repressed")
    )
    joined = treatments.join(found, TREATMENT, "left")

    def bullet(p: Column) -> Column:
        return F.format_string(PATHWAY_LINE, p.pathway, fixed(p.nes, 2), fixed(p.fdr, 3))

    def section(col: str) -> Column:
        return F.when(F.size(col) > 0, F.array_join(F.transform(col, bullet), "\n")).otherwise(F.lit(NO_PATHWAY_LINE))

    genes = F.array_join(F.transform("cell_line_info.driver_mutations", lambda m: m.gene_symbol), ", ")
    head = F.format_string(
        "\n".join(EXPERIMENT_LINES),
        "drug",
        F.col("concentration").cast("string"),
        "cell_line",
        "cell_line_info.organ",
        F.when(F.length(genes) > 0, genes).otherwise(UNANNOTATED),
        "drug_info.moa_fine",
        _targets(F.col("drug_info.targets")),
        F.lit(str(threshold)),
        F.col("significant_count"),
    )
    text = F.concat_ws("\n", head, section("top_activated"), F.lit("\n".join(REPRESSED_LINES)), section("top_repressed"))
    return joined.withColumn("significant_count", F.coalesce("_n", F.lit(0)).cast("bigint")).select(
        *TREATMENT,
        F.struct("significant_count", "top_activated", "top_repressed").alias("observation"),
        text.alias("report"),
    )
