"""One query per operator, over the whole of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings.tables import ALL_SETS, BUDGET, PARAMS, ROW_ORDER, SIGNATURES, THRESHOLD, Tables, gene_of, scratch
from doseframe.functions import columns as C
from doseframe.operators import aggregates as A
from doseframe.operators import enrichment as E
from doseframe.operators import episodes as P
from doseframe.operators import filters as S
from doseframe.operators import joins as J
from doseframe.operators import pathways as W
from doseframe.operators import questions as Q
from doseframe.operators import records as R
from doseframe.operators import sets as U
from doseframe.operators.nulls import null_tails
from doseframe.plans import enrich, scoring
from doseframe.schema import DE_SCHEMA, TREATMENT
from doseframe.sources import de as D
from doseframe.sources import metadata as M
from doseframe.sources import results as O
from doseframe.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

DE_COLUMNS = [*DE_SCHEMA.fieldNames(), "file_num"]


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    return build


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Floats to six decimals, since engines sum in different orders; mean
    fold changes to ten, as their exact values can end in a five at the seventh."""
    return df.withColumns({c: F.round(c, 10 if c.endswith(("log2fc", "mean_lfc")) else 6) for c in cols})


def joined(col: Column | str, sep: str = ",") -> Column:
    return F.array_join(col, sep)


def results(df: DataFrame) -> DataFrame:
    return rounded(df.select(*TREATMENT, "pathway", "nes", "pvalue", "fdr", "leading_edge"), "nes", "pvalue", "fdr")


def plain_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("-", "_") for c in df.columns])


# Scans, sources, sinks


@query
def scan_de(t: Tables) -> DataFrame:
    return D.scan_de(t.spark, t.de_store()).select(*DE_COLUMNS)


@query
def scan_de_file(t: Tables) -> DataFrame:
    return D.scan_de_file(t.spark, t.de_store(), 3).select(*DE_COLUMNS)


@query
def load_metadata(t: Tables) -> DataFrame:
    keys = {"gene_metadata": "gene_symbol", "drug_metadata": "drug", "cell_line_metadata": "cell_name", "sample_metadata": "sample"}
    loaded = M.load_metadata(t.spark, t.metadata_root())
    return U.union_results(
        [
            loaded[name].agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys")).withColumn("table_name", F.lit(name))
            for name, key in keys.items()
        ]
    )


@query
def load_signatures(t: Tables) -> DataFrame:
    return M.load_signatures(t.spark, t.signature_file(), whole_document=False)


@query
def scan_csv_compounds(t: Tables) -> DataFrame:
    return M.scan_csv_compounds(t.spark, t.compound_csv())


@query
def sql_over_de(t: Tables) -> DataFrame:
    text = """
        SELECT drug, cell_line, round(avg(log2FoldChange), 10) AS mean_lfc, count(*) AS n_rows
        FROM {parquet} WHERE padj < 0.05 GROUP BY drug, cell_line
    """
    return D.sql_over_de(t.spark, text, D.scan_de(t.spark, t.de_store()))


@query
def write_enrichment(t: Tables) -> DataFrame:
    path = scratch(t.spark, "write-enrichment")
    O.write_enrichment(t.enrichment(), path)
    # Replacing one cell line must leave the others alone.
    O.write_enrichment(t.enrichment().where("cell_line = 'BUILDING'"), path)
    return results(O.read_enrichment(t.spark, path))


@query
def read_enrichment(t: Tables) -> DataFrame:
    return results(O.read_enrichment(t.spark, t.enrichment_path()).where("drug = 'NATION_3'"))


@query
def write_scores(t: Tables) -> DataFrame:
    path = scratch(t.spark, "scores")
    O.write_scores(A.wide_scores(A.signature_scores(t.de(), t.signatures()), SIGNATURES), path)
    stored = t.spark.read.parquet(path)
    return rounded(stored, *[c for c in stored.columns if c.endswith(("log2fc", "padj", "pct_change"))])


@query
def write_index(t: Tables) -> DataFrame:
    path = scratch(t.spark, "index")
    O.write_index(t.de().select(*TREATMENT, "file_num"), path)
    return O.read_index(t.spark, path)


# Filters, projections, predicates


@query
def fetch_de(t: Tables) -> DataFrame:
    rows = S.fetch_de(t.de(), drug="NATION_3", concentration=0.05, cell_line="BUILDING")
    return rows.select(*DE_COLUMNS)


@query
def conc_tolerance(t: Tables) -> DataFrame:
    return S.conc_tolerance(t.de(), 0.0504).select(*DE_COLUMNS)


@query
def genes_in_list(t: Tables) -> DataFrame:
    wanted = t.signatures().where("signature = 'promo'").select("gene")
    return S.genes_in_list(t.de(), wanted).select(*DE_COLUMNS)


@query
def validate_names(t: Tables) -> DataFrame:
    drugs = t.drugs().select(F.col("drug").alias("name"))
    asked = (
        drugs.select(F.col("name").alias("requested"))
        .unionByName(drugs.select(F.lower("name").alias("requested")))
        .unionByName(t.cells().select(F.lower("cell_name").alias("requested")))
    )
    return S.validate_names(asked, drugs).withColumn("similar", joined("similar"))


@query
def drugs_by_moa(t: Tables) -> DataFrame:
    return plain_names(S.drugs_by_moa(t.drugs(), "CLASS 1").select("drug", "moa-fine"))


@query
def drugs_by_moa_fallback(t: Tables) -> DataFrame:
    return plain_names(S.drugs_by_moa_fallback(t.drugs(), "^asia$").select("drug", "moa-broad", "tier"))


@query
def cell_lines_by_mutation(t: Tables) -> DataFrame:
    return S.cell_lines_by_mutation(t.cells(), "NATION_3")


@query
def regex_or_filter(t: Tables) -> DataFrame:
    return S.regex_or_filter(t.compounds(), {"TARGET_PATHWAY": "econ|promo", "DRUG_NAME": "red|ring"})


@query
def drop_unusable_genes(t: Tables) -> DataFrame:
    kept = S.drop_unusable_genes(t.de()).groupBy(*TREATMENT).agg(F.count(F.lit(1)).alias("n_usable_rows"))
    return S.unusable_gene_counts(t.de()).join(kept, TREATMENT, "left")


@query
def select_existing_cols(t: Tables) -> DataFrame:
    return plain_names(S.select_existing_cols(t.drugs(), ["drug", "moa-fine", "not-there", "targets"]))


@query
def coerce_numeric(t: Tables) -> DataFrame:
    """Results as text with some unreadable numbers."""

    def text(col: str) -> Column:
        return F.when(F.length("leading_edge") % 5 == 0, F.lit("n/a")).otherwise(F.round(col, 6).cast("string"))

    raw = t.enrichment().select(
        *TREATMENT,
        F.col("pathway").alias("Term"),
        text("nes").alias("NES"),
        text("pvalue").alias("NOM p-val"),
        text("fdr").alias("FDR q-val"),
        F.col("leading_edge").alias("Lead_genes"),
    )
    return results(S.coerce_numeric(raw, ["nes", "pvalue", "fdr"], S.RESULT_COLUMNS))


@query
def treatments_for_cell_line(t: Tables) -> DataFrame:
    return S.treatments_for_cell_line(t.index(), "BUILDING")


@query
def sample_treatments(t: Tables) -> DataFrame:
    return S.sample_treatments(t.samples(), "BUILDING")


@query
def significant_pathways(t: Tables) -> DataFrame:
    ranked = W.significant_pathways(t.enrichment(), THRESHOLD)
    return rounded(ranked.select(*TREATMENT, "pathway", "nes", "fdr", "rank"), "nes", "fdr")


@query
def pathway_exact(t: Tables) -> DataFrame:
    return results(W.pathway_exact(t.enrichment(), "type:PROMO"))


@query
def pathway_request(t: Tables) -> DataFrame:
    """The bulk form: all pathways a table asks for."""
    asked = t.raw("part").select(F.concat(F.lit("brand:"), "p_brand").alias("pathway"))
    return results(W.pathway_exact(t.enrichment(), asked))


@query
def pathway_partial(t: Tables) -> DataFrame:
    found = W.pathway_partial(t.enrichment(), "type:[sl]")
    return rounded(found.select(*TREATMENT, "pathway", "nes", "n_matches"), "nes")


@query
def list_pathways(t: Tables) -> DataFrame:
    return W.list_pathways(t.enrichment())


@query
def list_vocab(t: Tables) -> DataFrame:
    drugs = S.list_vocab(t.de(), "drug").select(F.lit("drug").alias("kind"), F.col("drug").alias("name"))
    return drugs.unionByName(
        S.list_vocab(t.de(), "cell_line").select(F.lit("cell_line").alias("kind"), F.col("cell_line").alias("name"))
    )


# Joins


def wide(t: Tables) -> DataFrame:
    return A.wide_scores(A.signature_scores(t.de(), t.signatures()), SIGNATURES).select(
        "drug", "cell_line", F.round("economy_log2fc", 10).alias("economy_log2fc")
    )


@query
def join_drug_meta(t: Tables) -> DataFrame:
    return plain_names(J.join_drug_meta(wide(t), t.drugs()))


@query
def join_cell_meta_fanout(t: Tables) -> DataFrame:
    return J.join_cell_meta_fanout(wide(t), t.cells())


@query
def join_cell_meta_first(t: Tables) -> DataFrame:
    return J.join_cell_meta_first(wide(t), t.cells(), "ord")


@query
def merge_signatures_outer(t: Tables) -> DataFrame:
    # A signature of one gene has no score for many pairs, so the merge has gaps to fill.
    rare = t.raw("part").agg(F.min("p_partkey").alias("p_partkey")).select(F.lit("rare").alias("signature"), gene_of("p_partkey").alias("gene"))
    scores = A.signature_scores(t.de(), t.signatures().unionByName(rare))
    tables = [
        scores.where(F.col("signature") == s).select(
            "drug", "cell_line",
            F.round("log2fc", 10).alias(f"{s}_log2fc"),
            F.col("padj").alias(f"{s}_padj"),
            F.round("pct_change", 6).alias(f"{s}_pct_change"),
            "n_genes",
        )
        for s in [*SIGNATURES, "rare"]
    ]
    return J.merge_signatures_outer(tables)


@query
def indexed_fetch(t: Tables) -> DataFrame:
    keys = t.places().where("drug = 'NATION_3' AND cell_line = 'BUILDING'")
    return J.indexed_fetch(t.spark, t.de_store(), t.places(), keys).select(*DE_COLUMNS)


@query
def assemble_treatments(t: Tables) -> DataFrame:
    built = J.assemble_treatments(t.index().select(*TREATMENT), R.parse_drugs(t.drug_history(), "ord"), R.nest_cell_lines(t.cells(), "ord"))
    return built.select(
        *TREATMENT,
        F.col("drug_info.moa_fine").alias("moa_fine"),
        joined("drug_info.targets").alias("targets"),
        F.col("cell_line_info.organ").alias("organ"),
        F.size("cell_line_info.driver_mutations").cast("bigint").alias("n_mutations"),
    )


@query
def name_overlap(t: Tables) -> DataFrame:
    return J.name_overlap(t.compounds(), t.external_names(), "DRUG_NAME", "external_name")


@query
def semi_join_response(t: Tables) -> DataFrame:
    drugs = S.drugs_by_moa(t.drugs(), "class 1")
    lines = S.cell_lines_by_mutation(t.cells(), "NATION_3")
    return J.semi_join_response(t.response(), drugs, lines)


@query
def skip_cached(t: Tables) -> DataFrame:
    return J.skip_cached(t.index(), t.enrichment().where("cell_line = 'BUILDING'"))


@query
def heldout_guard(t: Tables) -> DataFrame:
    asked = t.log().where("action = 'experiment'").drop("restricted").withColumn(
        "concentration", F.col("concentration") + F.lit(0.004)
    )
    return J.heldout_guard(asked, t.heldout()).select("event_id", "drug", "cell_line", "restricted")


def ranked(t: Tables) -> DataFrame:
    return E.ranked_genes(t.de(), "row_key")


def rankable(t: Tables, params: enrich.Prerank | None = None) -> DataFrame:
    params = params or PARAMS
    return E.rankable_genes(E.best_rows(t.de(), "row_key"), t.sets(), params.min_size, params.max_size)


def members(t: Tables) -> DataFrame:
    return E.set_membership(rankable(t), t.sets(), PARAMS.min_size, PARAMS.max_size)


@query
def set_membership(t: Tables) -> DataFrame:
    return E.public(members(t)).select(*TREATMENT, "pathway", "gene", "size")


@query
def signature_coverage(t: Tables) -> DataFrame:
    """Signatures that name every part by symbol, also those known only by Ensembl id."""
    named = t.raw("part").select(
        F.lower("p_type").alias("signature"), F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene")
    )
    return J.signature_coverage(named, t.genes())


@query
def treatment_grid(t: Tables) -> DataFrame:
    # One line more than was ever tested.
    lines = t.cells().select(F.col("cell_name").alias("cell_line")).union(t.spark.range(1).select(F.lit("UNLISTED")))
    return J.treatment_grid(t.de(), t.drugs(), lines).withColumn("missing", joined("missing"))


# Aggregations


@query
def signature_scores(t: Tables) -> DataFrame:
    return rounded(A.signature_scores(t.de(), t.signatures()), "log2fc", "padj", "pct_change")


@query
def pathway_activity(t: Tables) -> DataFrame:
    return rounded(A.pathway_activity(t.de(), t.signatures()), "log2fc", "padj", "pct_change")


@query
def score_responses(t: Tables) -> DataFrame:
    """The whole scoring job, first mutation per cell line."""
    out = scoring.score_responses(t.de(), t.signatures(), SIGNATURES, t.drugs(), t.cells(), "ord")
    return plain_names(rounded(out, *[f"{s}_{m}" for s in SIGNATURES for m in ("log2fc", "padj", "pct_change")]))


@query
def treatment_index(t: Tables) -> DataFrame:
    return A.treatment_index(D.scan_de(t.spark, t.de_store()))


@query
def index_and_enrich(t: Tables) -> DataFrame:
    index, found = enrich.index_and_enrich(t.de(), t.sets(), "row_key", scratch(t.spark, "genes"), ALL_SETS)
    counts = found.groupBy(*TREATMENT).agg(
        F.count(F.lit(1)).alias("n_pathways"),
        F.count_if(F.col("fdr") < THRESHOLD).alias("n_significant"),
        F.round(F.max("nes"), 6).alias("top_nes"),
    )
    return index.join(counts, TREATMENT, "left")


@query
def value_counts(t: Tables) -> DataFrame:
    return A.value_counts(t.cells(), "Driver_Gene_Symbol", 20)


@query
def metadata_summary(t: Tables) -> DataFrame:
    return A.metadata_summary(t.drugs(), t.cells(), t.genes())


@query
def organ_distribution(t: Tables) -> DataFrame:
    return A.organ_distribution(t.cells(), "ord")


@query
def nest_cell_lines(t: Tables) -> DataFrame:
    def line(m: Column) -> Column:
        parts = [m.gene_symbol, m.protein_effect, m.var_type, m.var_zygosity, m.mechanism, m.gene_type]
        return F.concat_ws("|", *[F.coalesce(p, F.lit("-")) for p in parts])

    nested = R.nest_cell_lines(t.cells(), "ord")
    return nested.select("cell_line", "organ", joined(F.transform("driver_mutations", line)).alias("mutations"))


@query
def gene_name_breakdown(t: Tables) -> DataFrame:
    return rounded(A.gene_name_breakdown(t.de()), "symbol_pct", "ensembl_pct")


@query
def question_summary(t: Tables) -> DataFrame:
    return rounded(A.question_summary(t.items()), "pct_true")


@query
def truth_by_mutation(t: Tables) -> DataFrame:
    return rounded(A.truth_by_mutation(t.items(), t.cells(), "NATION_3", "NATION_5"), "mean_nes")


@query
def avg_lfc_by_treatment(t: Tables) -> DataFrame:
    return rounded(A.avg_lfc_by_treatment(t.de()), "mean_lfc")


@query
def avg_lfc_one_gene(t: Tables) -> DataFrame:
    """The documented form: one gene, whose name skips most pages of the files."""
    return rounded(A.avg_lfc_by_treatment(t.de(), gene="g7"), "mean_lfc")


@query
def avg_lfc_one_gene_sql(t: Tables) -> DataFrame:
    text = """
        SELECT drug, cell_line, round(avg(log2FoldChange), 10) AS mean_lfc
        FROM {parquet} WHERE gene_name = 'g11' GROUP BY drug, cell_line
    """
    return D.sql_over_de(t.spark, text, D.scan_de(t.spark, t.de_store()))


# Ranking and enrichment


@query
def top_activated(t: Tables) -> DataFrame:
    return rounded(W.top_activated(t.enrichment(), 3).select(*TREATMENT, "pathway", "nes", "rank"), "nes")


@query
def top_repressed(t: Tables) -> DataFrame:
    return rounded(W.top_repressed(t.enrichment(), 3).select(*TREATMENT, "pathway", "nes", "rank"), "nes")


@query
def top_genes(t: Tables) -> DataFrame:
    return W.top_genes(t.de(), 10)


@query
def sig_top_bottom(t: Tables) -> DataFrame:
    found = W.sig_top_bottom(t.enrichment(), THRESHOLD, 2)
    return rounded(found.select(*TREATMENT, "side", "rank", "pathway", "nes", "fdr"), "nes", "fdr")


@query
def sample_rows(t: Tables) -> DataFrame:
    return U.sample_rows(t.de(), 1000, ROW_ORDER).select(*DE_COLUMNS)


@query
def ranked_genes(t: Tables) -> DataFrame:
    return rounded(E.public(ranked(t)).select(*TREATMENT, "gene", "metric", "position", "n_genes"), "metric")


@query
def enrichment_score(t: Tables) -> DataFrame:
    return rounded(E.public(E.enrichment_score(members(t))), "es")


@query
def leading_edge(t: Tables) -> DataFrame:
    return E.public(E.leading_edge(members(t)))


def annotated(t: Tables, params: enrich.Prerank | None = None) -> DataFrame:
    params = params or PARAMS
    return E.with_sets(rankable(t, params), t.sets(), params.min_size, params.max_size)


@query
def null_scores(t: Tables) -> DataFrame:
    return rounded(E.public(E.null_scores(annotated(t), PARAMS.permutations, PARAMS.seed)), "null_es")


def tails(t: Tables, params: enrich.Prerank | None = None) -> DataFrame:
    params = params or PARAMS
    return null_tails(E.scored_members(annotated(t, params)), params.permutations, params.seed)


@query
def nes_pvalue(t: Tables) -> DataFrame:
    return rounded(E.public(E.nes_pvalue(tails(t, ALL_SETS))).select(*TREATMENT, "pathway", "nes", "pvalue"), "nes", "pvalue")


@query
def fdr_qvalue(t: Tables) -> DataFrame:
    return rounded(E.public(E.fdr_qvalue(E.nes_pvalue(tails(t)))).select(*TREATMENT, "pathway", "nes", "fdr"), "nes", "fdr")


@query
def enrich_cell_line(t: Tables) -> DataFrame:
    cached = t.enrichment().where("concentration = 5.0")
    return results(enrich.enrich_cell_line(t.de(), t.sets(), "row_key", "BUILDING", cached=cached, params=PARAMS))


@query
def prerank_scale(t: Tables) -> DataFrame:
    return results(enrich.prerank(t.de(), t.sets(), "row_key", ALL_SETS))


@query
def prerank_relational(t: Tables) -> DataFrame:
    return results(enrich.prerank_relational(t.de(), t.sets(), "row_key", PARAMS))


@query
def null_tail_counts(t: Tables) -> DataFrame:
    """The grouped-map null alone: null size and tail counts per set."""
    return E.public(tails(t)).select(*TREATMENT, "pathway", "null_n", "null_extreme", "pool_n", "pool_extreme")


# Set operations


@query
def union_results(t: Tables) -> DataFrame:
    stored = t.enrichment()
    return results(U.union_results([stored.where("cell_line = 'BUILDING'"), stored.where("cell_line <> 'BUILDING'")]))


@query
def intersect_names(t: Tables) -> DataFrame:
    ours = t.compounds().select(C.normalise_name("DRUG_NAME").alias("name"))
    theirs = t.external_names().select(C.normalise_name("external_name").alias("name"))
    return U.intersect_names(ours, theirs)


@query
def intersection_counts(t: Tables) -> DataFrame:
    return U.intersection_counts(t.drugs().select("drug"), S.cell_lines_by_mutation(t.cells(), "NATION_3").select(F.col("Driver_Gene_Symbol").alias("drug")))


@query
def remaining_files(t: Tables) -> DataFrame:
    """After a run that indexed the files with even numbers."""
    path = scratch(t.spark, "partial-index")
    O.write_index(t.de().where("file_num % 2 = 0"), path)
    return U.remaining_files(t.de(), O.read_index(t.spark, path))


@query
def all_signature_genes(t: Tables) -> DataFrame:
    return U.all_signature_genes(t.signatures())


# Scalar, array and record expressions


@query
def parse_drugs(t: Tables) -> DataFrame:
    return R.parse_drugs(t.drug_history(), "ord").withColumn("targets", joined("targets"))


@query
def round_conc(t: Tables) -> DataFrame:
    return t.de().select("concentration", C.conc_key("concentration").alias("conc_key")).distinct()


@query
def pct_change(t: Tables) -> DataFrame:
    distinct = t.de().select("log2FoldChange").distinct()
    return rounded(distinct.withColumn("pct_change", C.pct_change("log2FoldChange")), "pct_change")


@query
def normalise_names(t: Tables) -> DataFrame:
    return t.external_names().select("external_name", C.normalise_name("external_name").alias("norm_name")).distinct()


@query
def safe_key(t: Tables) -> DataFrame:
    return t.index().select(
        C.result_key(F.translate("drug", "_", "/"), F.col("concentration")).alias("result_key"),
        C.treatment_label("drug", "concentration", "cell_line").alias("label"),
    )


@query
def ic50_um(t: Tables) -> DataFrame:
    return t.response().select("LN_IC50", C.ic50_um("LN_IC50").alias("IC50_uM")).distinct()


@query
def mutation_arrays(t: Tables) -> DataFrame:
    found = R.mutation_arrays(R.nest_cell_lines(t.cells(), "ord"), "NATION_3")

    def effects(col: str) -> Column:
        return joined(F.transform(col, lambda m: F.concat_ws(":", m.gene_symbol, m.protein_effect)))

    return found.select(
        "cell_line", "has_mutation", effects("oncogenes").alias("oncogenes"), effects("tumor_suppressors").alias("tumor_suppressors")
    )


@query
def kras_status(t: Tables) -> DataFrame:
    cells = t.cells()
    asked = cells.select(F.lower(F.substring("cell_name", 1, 4)).alias("requested")).unionByName(
        t.drugs().select(F.col("drug").alias("requested"))
    )
    return R.mutation_status(asked.distinct(), cells, "NATION_3", "ord")


@query
def drug_lookup_status(t: Tables) -> DataFrame:
    asked = t.drugs().select(F.lower("drug").alias("requested")).unionByName(t.raw("region").select(F.col("r_name").alias("requested")))
    return R.drug_lookup_status(asked, t.drugs(), "ord")


@query
def drug_report(t: Tables) -> DataFrame:
    return R.drug_report(R.parse_drugs(t.drug_history(), "ord"))


@query
def cell_line_report(t: Tables) -> DataFrame:
    return R.cell_line_report(R.nest_cell_lines(t.cells(), "ord"))


@query
def experiment_report(t: Tables) -> DataFrame:
    built = J.assemble_treatments(t.index().select(*TREATMENT), R.parse_drugs(t.drugs(), "ord"), R.nest_cell_lines(t.cells(), "ord"))
    found = R.experiment_report(t.enrichment(), built, THRESHOLD)
    return found.select(*TREATMENT, "observation.significant_count", "report")


# Questions, task sets, episode scoring


@query
def ground_truth(t: Tables) -> DataFrame:
    each = t.enrichment().withColumn("direction", F.explode(F.array(*[F.lit(d) for d in Q.DIRECTIONS])))
    label = Q.ground_truth(F.col("direction"), F.col("nes"), F.col("fdr"), F.lit(THRESHOLD))
    return each.select(*TREATMENT, "pathway", "direction", label.alias("ground_truth"))


@query
def build_questions(t: Tables) -> DataFrame:
    items = t.items().select("question_id", "direction", "cell_line", "ground_truth", "nes", "fdr")
    return rounded(items, "nes", "fdr")


@query
def unmatched_questions(t: Tables) -> DataFrame:
    return Q.unmatched_questions(t.questions(), t.items()).select("question_id", "drug", "concentration", "target_pathway")


@query
def task_rows(t: Tables) -> DataFrame:
    return Q.task_rows(t.questions(), t.items())


@query
def split_tasks(t: Tables) -> DataFrame:
    return Q.split_tasks(Q.task_rows(t.questions(), t.items())).select("question_id", "shuffle_position", "split")


def outcomes(df: DataFrame) -> DataFrame:
    return df.select("episode", "event_id", "action", "accepted", "reason", "step", "experiments_run", "done", "found")


@query
def replay_episodes(t: Tables) -> DataFrame:
    return outcomes(P.replay_episodes(t.log(), BUDGET))


@query
def step_scores(t: Tables) -> DataFrame:
    return rounded(P.step_scores(t.accepted()), "step_score")


@query
def trajectory(t: Tables) -> DataFrame:
    def line(s: Column) -> Column:
        def text(c: Column) -> Column:
            return F.coalesce(c.cast("string"), F.lit("-"))

        return F.concat_ws(
            "|", text(s.step), text(s.hypothesis), text(s.hypothesis_score), text(s.experiment.drug),
            text(s.experiment.concentration), text(s.experiment.cell_line), text(s.interpretation), text(s.interpretation_score),
        )

    return P.trajectory(t.accepted()).select(
        "episode", "learned_knowledge", "knowledge_version", joined(F.transform("trajectory", line), ";").alias("trajectory")
    )


@query
def episode_progress(t: Tables) -> DataFrame:
    return rounded(P.episode_progress(t.predictions(), ("question_id",)), "accuracy", "s_progress")


def episode_results(t: Tables) -> DataFrame:
    replay = P.replay_episodes(t.log(), BUDGET, carry=["score"])
    return P.episode_score(replay, progress=P.episode_progress(t.episode_predictions()), lam=10.0)


@query
def episode_score(t: Tables) -> DataFrame:
    return rounded(
        episode_results(t), "s_process", "s_process_sum", "s_progress", "s_episode", "s_episode_sum", "total_reward"
    )


@query
def evaluation_summary(t: Tables) -> DataFrame:
    return rounded(P.evaluation_summary(episode_results(t)), "mean_s_process", "mean_s_progress", "mean_s_episode")


# Streaming


def stream(t: Tables, name: str) -> DataFrame:
    """One of the driver's files as a stream."""
    return (
        t.spark.readStream.schema(t.raw(name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.dir)
    )


@query
def stream_signature_filter(t: Tables) -> DataFrame:
    out, checkpoint = scratch(t.spark, "stream-filter"), scratch(t.spark, "stream-filter-checkpoint")
    jobs.stream_signature_filter(
        t.de_from(stream(t, "lineitem")).select(*DE_COLUMNS), t.signatures(), out, checkpoint
    )
    return t.spark.read.parquet(out)


@query
def stream_first_seen(t: Tables) -> DataFrame:
    out, checkpoint = scratch(t.spark, "stream-index"), scratch(t.spark, "stream-index-checkpoint")
    jobs.stream_first_seen(t.de_from(stream(t, "lineitem")), out, checkpoint)
    return jobs.read_first_seen(t.spark, out)


@query
def stream_replay(t: Tables) -> DataFrame:
    t.spark.conf.set(jobs.STATE_STORE, jobs.ROCKSDB)
    out, checkpoint = scratch(t.spark, "stream-replay"), scratch(t.spark, "stream-replay-checkpoint")
    jobs.stream_replay(t.log_from(stream(t, "events")), out, checkpoint, BUDGET)
    return outcomes(t.spark.read.parquet(out))
