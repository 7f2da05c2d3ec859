"""SQL for DuckDB that states the expected result of each query from the driver's tables alone."""

from __future__ import annotations

import re

from bindings.tables import ALL_SETS, BUDGET, CELL_LINES, LEAST_FILES, PARAMS, ROWS_IN_FILE, SIGNATURES, THRESHOLD
from doseframe.functions.columns import MIX_A, MIX_B, MIX_PRIME, MIX_STEP
from doseframe.operators.enrichment import permutation_base
from doseframe.operators.episodes import default_turns

TRT = "cell_line, drug, concentration"
KEY = f"{TRT}, pathway"
ROW_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
DE_COLS = 'gene_name, log2FoldChange, padj, baseMean, drug, concentration, cell_line, file_num'


def gene(key: str) -> str:
    return f"CASE WHEN {key} % 3 = 0 THEN 'ENSG' || lpad({key}::VARCHAR, 11, '0') ELSE 'g' || {key} END"


def moa_class() -> str:
    return "r_name || ' class ' || (n_nationkey % 3)"


# Views over the driver's tables and over each other, by name.
VIEWS = {
    "de": f"""
        SELECT {gene('l_partkey')} AS gene_name,
               (CAST(round(l_extendedprice * 100) AS BIGINT) % 2001 - 1000)::DOUBLE / 250.0::DOUBLE AS log2FoldChange,
               CASE WHEN (l_orderkey * 31 + l_linenumber * 17) % 97 = 0 THEN NULL
                    WHEN (l_orderkey * 31 + l_linenumber * 17) % 89 = 0 THEN 0.0::DOUBLE
                    ELSE ((l_orderkey * 7919 + l_linenumber * 104729) % 10000 + 1)::DOUBLE / 10000.0::DOUBLE END AS padj,
               l_quantity AS baseMean, n_name AS drug,
               CASE WHEN l_linestatus = 'F' THEN 0.05::DOUBLE ELSE 5.0::DOUBLE END AS concentration,
               c_mktsegment AS cell_line,
               ((('0x' || substr(md5(c_mktsegment || '/' || n_name), 1, 6))::BIGINT + l_linenumber % 2)
                % (SELECT greatest({LEAST_FILES}, count(*) // {ROWS_IN_FILE}) FROM lineitem))::INTEGER AS file_num,
               {ROW_ORDER}
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "targets": """
        SELECT n_nationkey, string_agg(t, ', ' ORDER BY t) AS targets
        FROM (SELECT DISTINCT s_nationkey AS n_nationkey, 'T' || (s_suppkey % 50) AS t FROM supplier) GROUP BY n_nationkey""",
    "drugs": f"""
        SELECT n_name AS drug, coalesce(targets, 'None') AS targets, r_name AS moa_broad, {moa_class()} AS moa_fine,
               n_nationkey % 2 = 0 AS human_approved, n_nationkey % 3 = 0 AS clinical_trials,
               CASE WHEN n_nationkey % 4 <> 0 THEN 'C' || n_nationkey END AS canonical_smiles,
               CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey::BIGINT * 1000 END AS pubchem_cid, n_nationkey AS ord
        FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN targets USING (n_nationkey)""",
    "cells": """
        SELECT cell_name, Organ, gene, effect,
               CASE n % 4 WHEN 0 THEN 'Missense' WHEN 1 THEN 'Frameshift' WHEN 2 THEN 'Stopgain' ELSE 'Deletion' END AS var_type,
               CASE WHEN n % 5 <> 0 THEN CASE WHEN n % 2 = 0 THEN 'Het' ELSE 'Hom' END END AS zyg,
               CASE n % 4 WHEN 0 THEN 'GoF' WHEN 1 THEN 'LoF' END AS mech,
               CASE WHEN n % 2 = 0 THEN 'Oncogene' ELSE 'Suppressor' END AS gene_type, min(c_custkey) AS ord
        FROM (SELECT c_mktsegment AS cell_name, lower(c_mktsegment) AS Organ, c_custkey % 20 AS n, c_custkey,
                     CASE WHEN c_custkey % 7 <> 0 THEN n_name END AS gene, 'p.G' || (c_custkey % 20) || 'V' AS effect
              FROM customer JOIN nation ON c_nationkey = n_nationkey)
        GROUP BY cell_name, Organ, gene, effect, n""",
    "samples": """
        SELECT 'smp_' || o_orderkey AS sample, n_name AS drug,
               n_name || '_' || CASE WHEN o_orderstatus = 'F' THEN '0.05' ELSE '5.0' END AS drugname_drugconc, c_mktsegment AS cell_line
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "sets": f"""
        SELECT 'type:' || p_type AS pathway, upper({gene('p_partkey')}) AS gene FROM part
        UNION ALL SELECT 'brand:' || p_brand, upper({gene('p_partkey')}) FROM part""",
    "signatures": f"SELECT lower(p_type) AS signature, {gene('p_partkey')} AS gene FROM part",
    "external": "SELECT replace(upper(p_name), ' ', '-') || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '-EXT' END AS external_name FROM part",
    "index_": f"SELECT {TRT}, min(file_num) AS file_num FROM de GROUP BY {TRT}",
    "scores": """
        SELECT d.drug, d.cell_line, s.signature, avg(log2FoldChange) AS log2fc, min(padj) AS padj, count(*) AS n_genes,
               (pow(2.0, avg(log2FoldChange)) - 1) * 100 AS pct_change
        FROM de d JOIN signatures s ON d.gene_name = s.gene GROUP BY d.drug, d.cell_line, s.signature""",
    "usable": """
        SELECT * FROM de WHERE log2FoldChange IS NOT NULL AND padj IS NOT NULL AND gene_name NOT LIKE 'ENSG%'""",
    "ranked": f"""
        SELECT *, row_number() OVER (PARTITION BY {TRT} ORDER BY metric DESC, gene) - 1 AS position,
               count(*) OVER (PARTITION BY {TRT}) AS n_genes
        FROM (SELECT {TRT}, upper(gene_name) AS gene,
                     sign(log2FoldChange) * -log10(greatest(padj, 1e-300)) + 0.0 AS metric
              FROM usable
              QUALIFY row_number() OVER (PARTITION BY {TRT}, upper(gene_name) ORDER BY {ROW_ORDER}) = 1)""",
    "members": f"""
        SELECT r.*, s.pathway, count(*) OVER (PARTITION BY r.cell_line, r.drug, r.concentration, s.pathway) AS size
        FROM ranked r JOIN sets s USING (gene)
        QUALIFY size BETWEEN {PARAMS.min_size} AND {PARAMS.max_size}""",
    "sums": f"""
        SELECT *, round(upto / nullif(total, 0) - missed, 10) AS above, round((upto - w) / nullif(total, 0) - missed, 10) AS below
        FROM (SELECT *, (position - before)::DOUBLE / nullif(n_genes - hits, 0) AS missed
              FROM (SELECT *, abs(metric) AS w, row_number() OVER o - 1 AS before, sum(abs(metric)) OVER o AS upto,
                           sum(abs(metric)) OVER g AS total, count(*) OVER g AS hits
                    FROM members WINDOW g AS (PARTITION BY {KEY}),
                         o AS (PARTITION BY {KEY} ORDER BY position ROWS UNBOUNDED PRECEDING)))""",
    "extremes": f"""
        SELECT {KEY}, any_value(size) AS size, max(above) AS high, min(below) AS low,
               CASE WHEN max(above) >= -min(below) THEN max(above) ELSE min(below) END AS es FROM sums GROUP BY {KEY}""",
    "bounds": f"""
        SELECT s.cell_line, s.drug, s.concentration, s.pathway, e.es,
               min(position) FILTER (above = high) AS peak, min(position) FILTER (below = low) AS trough
        FROM sums s JOIN extremes e USING ({KEY}) GROUP BY s.cell_line, s.drug, s.concentration, s.pathway, e.es""",
    "edges": f"""
        SELECT {KEY}, coalesce(string_agg(gene, ';' ORDER BY position)
                 FILTER ((es > 0 AND position <= peak) OR (es < 0 AND position >= trough)), '') AS leading_edge
        FROM sums JOIN bounds USING ({KEY}) GROUP BY {KEY}""",
    "mixed": f"""
        SELECT gene, permutation, xor(z, z >> 15) AS shuffle_key
        FROM (SELECT gene, permutation, xor(y, y >> 12) * {MIX_B} % {MIX_PRIME} AS z
        FROM (SELECT gene, permutation, xor(x, x >> 15) * {MIX_A} % {MIX_PRIME} AS y
        FROM (SELECT gene, p.permutation,
                     (('0x' || substr(md5(gene), 1, 8))::BIGINT + ({permutation_base(PARAMS.seed)} + p.permutation) * {MIX_STEP}) % {MIX_PRIME} AS x
              FROM (SELECT DISTINCT gene FROM ranked), (SELECT unnest(range({PARAMS.permutations})) AS permutation) p)))""",
    "shuffled": f"""
        SELECT {TRT}, r.gene, permutation, n_genes,
               row_number() OVER (PARTITION BY {TRT}, permutation ORDER BY shuffle_key, r.gene) - 1 AS position
        FROM ranked r JOIN mixed USING (gene)""",
    "null_hits": f"""
        SELECT h.cell_line, h.drug, h.concentration, m.pathway, h.permutation, h.position, h.n_genes, abs(w.metric) AS w
        FROM shuffled h JOIN members m USING ({TRT}, gene)
        JOIN ranked w ON w.cell_line = h.cell_line AND w.drug = h.drug AND w.concentration = h.concentration AND w.position = h.position""",
    "nulls": f"""
        SELECT {KEY}, permutation, CASE WHEN max(above) >= -min(below) THEN max(above) ELSE min(below) END AS null_es
        FROM (SELECT {KEY}, permutation, round(upto / nullif(total, 0) - missed, 10) AS above,
                     round((upto - w) / nullif(total, 0) - missed, 10) AS below
              FROM (SELECT *, (position - before)::DOUBLE / nullif(n_genes - hits, 0) AS missed
                    FROM (SELECT *, row_number() OVER o - 1 AS before, sum(w) OVER o AS upto, sum(w) OVER g AS total, count(*) OVER g AS hits
                          FROM null_hits WINDOW g AS (PARTITION BY {KEY}, permutation),
                               o AS (PARTITION BY {KEY}, permutation ORDER BY position ROWS UNBOUNDED PRECEDING))))
        GROUP BY {KEY}, permutation""",
    "summary": f"""
        SELECT {KEY}, any_value(es) AS es, any_value(size) AS size,
               avg(null_es) FILTER (null_es >= 0) AS up, avg(-null_es) FILTER (null_es < 0) AS down,
               count(*) FILTER ((null_es >= 0) = (es >= 0)) AS null_n,
               count(*) FILTER ((null_es >= 0) = (es >= 0) AND abs(null_es) >= abs(es)) AS null_extreme
        FROM extremes JOIN nulls USING ({KEY}) GROUP BY {KEY}""",
    "normal": f"""
        SELECT *, round(es / CASE WHEN es >= 0 THEN up ELSE down END, 10) AS nes, null_extreme::DOUBLE / nullif(null_n, 0) AS pvalue
        FROM summary""",
    "null_nes": f"""
        SELECT {TRT}, round(null_es / CASE WHEN null_es >= 0 THEN up ELSE down END, 10) AS value
        FROM nulls JOIN summary USING ({KEY})""",
    "pool": f"""
        SELECT {TRT}, pathway, nes,
               sum(is_null) OVER (PARTITION BY {TRT}, nes >= 0) AS pool_n,
               sum(is_null) OVER (PARTITION BY {TRT}, nes >= 0 ORDER BY abs(nes) DESC) AS pool_extreme,
               sum(1 - is_null) OVER (PARTITION BY {TRT}, nes >= 0) AS obs_n,
               sum(1 - is_null) OVER (PARTITION BY {TRT}, nes >= 0 ORDER BY abs(nes) DESC) AS obs_extreme, is_null
        FROM (SELECT {TRT}, pathway, nes, 0 AS is_null FROM normal WHERE nes IS NOT NULL
              UNION ALL SELECT {TRT}, NULL, value, 1 FROM null_nes WHERE value IS NOT NULL)""",
    "enr": f"""
        SELECT n.cell_line, n.drug, n.concentration, n.pathway, n.size, n.es, n.nes, n.pvalue, n.null_n, n.null_extreme,
               p.pool_n, p.pool_extreme, e.leading_edge,
               CASE WHEN n.nes IS NOT NULL THEN least(1.0::DOUBLE,
                 (p.pool_extreme::DOUBLE / nullif(p.pool_n, 0)) / (p.obs_extreme::DOUBLE / p.obs_n)) END AS fdr
        FROM normal n JOIN edges e USING ({KEY})
        LEFT JOIN (SELECT * FROM pool WHERE is_null = 0) p USING ({KEY})""",
    "questions": f"""
        SELECT md5(question) AS question_id, question, drug, concentration, target_pathway, direction, {THRESHOLD}::DOUBLE AS fdr_threshold
        FROM (SELECT *, 'What determines if a cell line shows ' || target_pathway || ' ' || direction || ' by ' || drug || ' at '
                        || concentration::VARCHAR || 'uM?' AS question
              FROM (SELECT DISTINCT drug, concentration, 'type:' || p_type AS target_pathway FROM de JOIN part ON l_partkey = p_partkey),
                   (SELECT unnest(['activated', 'repressed', 'either']) AS direction))""",
    "items": """
        SELECT q.*, e.cell_line, e.nes, e.fdr, coalesce(e.fdr < q.fdr_threshold AND CASE q.direction
                 WHEN 'activated' THEN e.nes > 0 WHEN 'repressed' THEN e.nes < 0 ELSE TRUE END, FALSE) AS ground_truth
        FROM questions q JOIN enr e ON e.drug = q.drug AND e.concentration = q.concentration AND e.pathway = q.target_pathway""",
    "log": f"""
        SELECT user_id AS episode, ts, event_id,
               CASE event_type WHEN 'signup' THEN 'hypothesis' WHEN 'click' THEN 'experiment' WHEN 'view' THEN 'interpretation'
                    WHEN 'purchase' THEN 'knowledge' ELSE 'lookup' END AS action,
               'NATION_' || (event_id % 27) AS drug, CASE WHEN event_id % 2 = 0 THEN 0.05::DOUBLE ELSE 5.0::DOUBLE END AS concentration,
               ({CELL_LINES})[event_id // 27 % 6 + 1] AS cell_line,
               event_type = 'purchase' AND event_id % 50 = 0 AS declares_done,
               (event_id % 101)::DOUBLE / 100.0::DOUBLE AS score, 'note ' || event_id AS note
        FROM events""",
    "guarded": """
        SELECT l.*, (drug, cell_line, concentration) IN (SELECT (drug, cell_line, concentration) FROM de
                      WHERE cell_line = 'BUILDING' AND concentration = 5.0) AS restricted,
               drug IN (SELECT n_name FROM nation) AND cell_line IN (SELECT cell_name FROM cells) AS known_names,
               row_number() OVER (PARTITION BY episode ORDER BY ts, event_id) AS turn FROM log l""",
    # One state of the protocol per action: phase 0 nothing pending, 1 hypothesis, 2 experiment.
    "played": f"""
        SELECT episode, 0::BIGINT AS turn, 0 AS phase, 0 AS step, 0 AS used, FALSE AS ended,
               NULL::BIGINT AS event_id, NULL::VARCHAR AS action, NULL::VARCHAR AS reason, FALSE AS was_over
        FROM (SELECT DISTINCT episode FROM log)
        UNION ALL
        SELECT episode, turn,
               CASE WHEN reason IS NOT NULL THEN phase WHEN action = 'hypothesis' THEN 1 WHEN action = 'experiment' THEN 2
                    WHEN action = 'interpretation' THEN 0 ELSE phase END,
               step + (reason IS NULL AND action = 'hypothesis')::INTEGER, used + (reason IS NULL AND action = 'experiment')::INTEGER,
               ended OR (reason IS NULL AND action = 'experiment' AND used + 1 >= {BUDGET})
                     OR (reason IS NULL AND action = 'knowledge' AND declares_done),
               event_id, action, reason, ended OR turn > {default_turns(BUDGET)}
        FROM (SELECT p.episode, g.turn, p.phase, p.step, p.used, p.ended, g.event_id, g.action, g.declares_done,
                     CASE WHEN p.ended OR g.turn > {default_turns(BUDGET)} THEN 'episode_over'
                          WHEN g.action = 'hypothesis' AND p.phase <> 0 THEN 'hypothesis_pending'
                          WHEN g.action = 'experiment' AND p.phase = 0 THEN 'no_hypothesis'
                          WHEN g.action = 'experiment' AND g.restricted THEN 'held_out'
                          WHEN g.action = 'experiment' AND NOT g.known_names THEN 'unknown_name'
                          WHEN g.action = 'interpretation' AND p.phase <> 2 THEN 'no_experiment' END AS reason
              FROM played p JOIN guarded g ON g.episode = p.episode AND g.turn = p.turn + 1)""",
    "replay": """
        SELECT p.episode, p.event_id, p.action, reason IS NULL AS accepted, reason, CASE WHEN NOT was_over THEN step END AS step,
               CASE WHEN NOT was_over THEN used END AS experiments_run, ended OR was_over AS done,
               CASE WHEN reason IS NULL AND p.action = 'experiment' THEN r.drug IS NOT NULL END AS found
        FROM played p JOIN log l ON l.episode = p.episode AND l.event_id = p.event_id
        LEFT JOIN (SELECT DISTINCT drug, cell_line, concentration FROM members) r
          ON r.drug = l.drug AND r.cell_line = l.cell_line AND r.concentration = l.concentration WHERE turn > 0""",
    "accepted": """
        SELECT r.episode, r.event_id, r.action, r.step, r.experiments_run, l.ts, l.drug, l.concentration, l.cell_line, l.score, l.note
        FROM replay r JOIN log l ON r.event_id = l.event_id AND r.episode = l.episode WHERE r.accepted""",
    "steps": """
        SELECT episode, step, max(note) FILTER (action = 'hypothesis') AS hypothesis, max(score) FILTER (action = 'hypothesis') AS hs,
               arg_max(drug || '|' || concentration::VARCHAR || '|' || cell_line, (ts, event_id)) FILTER (action = 'experiment') AS experiment,
               max(note) FILTER (action = 'interpretation') AS interpretation, max(score) FILTER (action = 'interpretation') AS iscore
        FROM accepted WHERE action IN ('hypothesis', 'experiment', 'interpretation') GROUP BY episode, step""",
    "eprogress": """
        SELECT episode, arg_max(accuracy, t) - arg_min(accuracy, t) AS s_progress
        FROM (SELECT user_id AS episode, event_id % 5 AS t, avg(((event_id % 3 = 0) = (event_id % 2 = 0))::INTEGER) AS accuracy
              FROM events GROUP BY user_id, event_id % 5) GROUP BY episode""",
    "escores": """
        SELECT r.episode, steps_completed, experiments_run, coalesce(m, 0) AS s_process, coalesce(s, 0) AS s_process_sum, s_progress,
               coalesce(m, 0) + 10.0::DOUBLE * s_progress AS s_episode, coalesce(s, 0) + 10.0::DOUBLE * s_progress AS s_episode_sum,
               CASE WHEN declared THEN 1.0::DOUBLE ELSE coalesce(s, 0) END AS total_reward
        FROM (SELECT episode, max(coalesce(step, 0)) AS steps_completed, max(coalesce(experiments_run, 0)) AS experiments_run,
                     bool_or(accepted AND action = 'knowledge' AND done) AS declared FROM replay GROUP BY episode) r
        LEFT JOIN (SELECT episode, avg((hs + iscore) / 2) AS m, sum((hs + iscore) / 2) AS s FROM steps
                   WHERE iscore IS NOT NULL GROUP BY episode) USING (episode)
        JOIN eprogress USING (episode)""",
}
RECURSIVE = {"played"}

# The queries that score sets of any size, and their view of the members.
ANY_SIZE = {"index_and_enrich", "nes_pvalue", "prerank_scale"}
ANY_MEMBERS = f"""
        SELECT r.*, s.pathway, count(*) OVER (PARTITION BY r.cell_line, r.drug, r.concentration, s.pathway) AS size
        FROM ranked r JOIN sets s USING (gene)
        QUALIFY size >= {ALL_SETS.min_size}"""


def sql(body: str, given: dict[str, str] = VIEWS) -> str:
    """Prefix ``body`` with the views it uses, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"[A-Za-z_]+", text):
            if name in given and name not in needed and name not in open_views:
                open_views.append(name)
                visit(given[name])
                needed.append(name)

    open_views: list[str] = []
    visit(body)
    views = ",\n".join(f"{n} AS ({given[n]})" for n in needed)
    recursive = "RECURSIVE " if RECURSIVE & set(needed) else ""
    return f"WITH {recursive}{views}\n{body}" if views else body


def rnd(*cols: str) -> str:
    # Adding 0.0 clears a negative zero.
    return ", ".join(f"round({c}, {10 if c == 'log2fc' else 6}) + 0.0 AS {c}" for c in cols)


RESULT = f"SELECT {KEY}, {rnd('nes', 'pvalue', 'fdr')}, leading_edge FROM enr"


def wide(names: list[str], source: str = "scores") -> str:
    cols = ", ".join(
        f"round(any_value(log2fc) FILTER (signature = '{n}'), 10) AS {n}_log2fc, "
        f"round(any_value(padj) FILTER (signature = '{n}'), 6) AS {n}_padj, "
        f"round(any_value(pct_change) FILTER (signature = '{n}'), 6) AS {n}_pct_change"
        for n in names
    )
    return (
        f"SELECT drug, cell_line, {cols}, any_value(n_genes) FILTER (signature = '{names[0]}') AS n_genes "
        f"FROM {source} GROUP BY drug, cell_line"
    )


ECONOMY = "SELECT drug, cell_line, round(log2fc, 10) AS economy_log2fc FROM scores WHERE signature = 'economy'"
FIRST_CELL = "SELECT cell_name, arg_min(Organ, ord) AS Organ, arg_min(gene, ord) FILTER (gene IS NOT NULL) AS Driver_Gene_Symbol FROM cells GROUP BY cell_name"
COMPOUNDS = "SELECT p_partkey AS DRUG_ID, p_name AS DRUG_NAME, p_brand AS TARGET, p_type AS TARGET_PATHWAY FROM part"
NORM = "replace(replace(upper({0}), '-', ''), ' ', '')"
MUTATION_TEXT = "concat_ws('|', gene, coalesce(effect, '-'), coalesce(var_type, '-'), coalesce(zyg, '-'), coalesce(mech, '-'), coalesce(gene_type, '-'))"


def top(side: str, order: str, n: int, where: str) -> str:
    return f"""SELECT {TRT}, {side} pathway, nes, fdr, row_number() OVER (PARTITION BY {TRT} ORDER BY {order}, pathway) AS rank
        FROM enr WHERE {where} QUALIFY rank <= {n}"""


def top_gene(side: str, order: str) -> str:
    return f"""SELECT {TRT}, gene_name, log2FoldChange, padj, '{side}' AS side,
          row_number() OVER (PARTITION BY {TRT} ORDER BY log2FoldChange {order}, gene_name, padj NULLS FIRST) AS rank
        FROM de WHERE gene_name NOT LIKE 'ENSG%' AND log2FoldChange IS NOT NULL QUALIFY rank <= 10"""


BULLET = "'- ' || pathway || ': NES=' || format('{:.2f}', nes) || ', FDR=' || format('{:.3f}', fdr)"


def bullets(where: str, order: str) -> str:
    return f"""(SELECT {TRT}, string_agg(line, chr(10) ORDER BY rank) AS lines
        FROM (SELECT {TRT}, {BULLET} AS line, row_number() OVER (PARTITION BY {TRT} ORDER BY nes {order}, pathway) AS rank
              FROM enr WHERE {where} QUALIFY rank <= 5) GROUP BY {TRT})"""


BODIES = {
    "scan_de": f"SELECT {DE_COLS} FROM de",
    "scan_de_file": f"SELECT {DE_COLS} FROM de WHERE file_num = 3",
    "load_metadata": """
        SELECT 'gene_metadata' AS table_name, count(*) AS n_rows, count(*) AS n_keys FROM part
        UNION ALL SELECT 'drug_metadata', count(*), count(DISTINCT drug) FROM drugs
        UNION ALL SELECT 'cell_line_metadata', count(*), count(DISTINCT cell_name) FROM cells
        UNION ALL SELECT 'sample_metadata', count(*), count(DISTINCT sample) FROM samples""",
    "load_signatures": "SELECT signature, gene FROM signatures",
    "scan_csv_compounds": COMPOUNDS,
    "sql_over_de": "SELECT drug, cell_line, round(avg(log2FoldChange), 10) + 0.0 AS mean_lfc, count(*) AS n_rows FROM de WHERE padj < 0.05 GROUP BY drug, cell_line",
    "write_enrichment": RESULT,
    "read_enrichment": f"{RESULT} WHERE drug = 'NATION_3'",
    "write_scores": wide(SIGNATURES),
    "write_index": f"SELECT DISTINCT {TRT}, file_num FROM de",
    "fetch_de": f"SELECT {DE_COLS} FROM de WHERE drug = 'NATION_3' AND abs(concentration - 0.05) < 0.001 AND cell_line = 'BUILDING'",
    "conc_tolerance": f"SELECT {DE_COLS} FROM de WHERE abs(concentration - 0.0504) < 0.001",
    "genes_in_list": f"SELECT {DE_COLS} FROM de WHERE gene_name IN (SELECT gene FROM signatures WHERE signature = 'promo')",
    "validate_names": """
        SELECT requested, requested IN (SELECT drug FROM drugs) AS known,
               CASE WHEN requested IN (SELECT drug FROM drugs) THEN '' ELSE coalesce((SELECT string_agg(drug, ',' ORDER BY drug)
                 FROM (SELECT drug FROM drugs WHERE contains(lower(drug), lower(requested)) ORDER BY drug LIMIT 5)), '') END AS similar
        FROM (SELECT drug AS requested FROM drugs UNION SELECT lower(drug) FROM drugs UNION SELECT lower(cell_name) FROM cells)""",
    "drugs_by_moa": "SELECT drug, moa_fine FROM drugs WHERE regexp_matches(moa_fine, 'CLASS 1', 'i')",
    "drugs_by_moa_fallback": """
        SELECT drug, moa_broad, tier FROM (SELECT *, CASE WHEN regexp_matches(moa_fine, '^asia$', 'i') THEN 1
               WHEN regexp_matches(moa_broad, '^asia$', 'i') THEN 2 END AS tier FROM drugs)
        WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER ()""",
    "cell_lines_by_mutation": """
        SELECT DISTINCT cell_name, Organ, gene AS Driver_Gene_Symbol, effect AS Driver_ProtEffect_or_CdnaEffect, mech AS Driver_Mech_InferDM
        FROM cells WHERE gene = 'NATION_3'""",
    "regex_or_filter": f"""
        SELECT * FROM ({COMPOUNDS}) WHERE regexp_matches(TARGET_PATHWAY, 'econ|promo', 'i') OR regexp_matches(DRUG_NAME, 'red|ring', 'i')""",
    "drop_unusable_genes": f"""
        SELECT {TRT}, count(*) AS n_rows, count(*) FILTER (padj IS NULL) AS n_null,
               count(*) FILTER (padj IS NOT NULL AND gene_name LIKE 'ENSG%') AS n_ensembl,
               count(*) FILTER (padj IS NOT NULL AND gene_name NOT LIKE 'ENSG%') AS n_kept,
               nullif(count(*) FILTER (padj IS NOT NULL AND gene_name NOT LIKE 'ENSG%'), 0) AS n_usable_rows
        FROM de GROUP BY {TRT}""",
    "select_existing_cols": "SELECT drug, moa_fine, targets FROM drugs",
    "coerce_numeric": f"""
        SELECT {KEY}, leading_edge,
               CASE WHEN length(leading_edge) % 5 <> 0 THEN round(nes, 6) END AS nes,
               CASE WHEN length(leading_edge) % 5 <> 0 THEN round(pvalue, 6) END AS pvalue,
               CASE WHEN length(leading_edge) % 5 <> 0 THEN round(fdr, 6) END AS fdr FROM enr""",
    "treatments_for_cell_line": "SELECT DISTINCT drug, concentration FROM de WHERE cell_line = 'BUILDING'",
    "sample_treatments": "SELECT sample, drug, drugname_drugconc FROM samples WHERE cell_line = 'BUILDING'",
    "significant_pathways": f"""
        SELECT {KEY}, {rnd('nes', 'fdr')}, row_number() OVER (PARTITION BY {TRT} ORDER BY abs(enr.nes) DESC, pathway) AS rank
        FROM enr WHERE enr.fdr < {THRESHOLD}""",
    "pathway_exact": f"{RESULT} WHERE pathway = 'type:PROMO'",
    "pathway_request": f"{RESULT} WHERE starts_with(pathway, 'brand:')",
    "pathway_partial": f"""
        SELECT {KEY}, round(enr.nes, 6) AS nes, count(*) OVER (PARTITION BY {TRT}) AS n_matches FROM enr
        WHERE regexp_matches(pathway, 'type:[sl]', 'i') QUALIFY row_number() OVER (PARTITION BY {TRT} ORDER BY pathway) = 1""",
    "list_pathways": f"SELECT DISTINCT {KEY} FROM members",
    "list_vocab": "SELECT DISTINCT 'drug' AS kind, drug AS name FROM de UNION SELECT DISTINCT 'cell_line', cell_line FROM de",
    "join_drug_meta": f"SELECT s.*, d.moa_fine, d.moa_broad, d.targets FROM ({ECONOMY}) s LEFT JOIN drugs d USING (drug)",
    "join_cell_meta_fanout": f"""
        SELECT s.*, c.cell_name, c.gene AS Driver_Gene_Symbol, c.effect AS Driver_ProtEffect_or_CdnaEffect, c.Organ
        FROM ({ECONOMY}) s LEFT JOIN cells c ON s.cell_line = c.cell_name""",
    "join_cell_meta_first": f"SELECT s.*, c.cell_name, c.Organ, c.Driver_Gene_Symbol FROM ({ECONOMY}) s LEFT JOIN ({FIRST_CELL}) c ON s.cell_line = c.cell_name",
    "merge_signatures_outer": wide([*SIGNATURES, "rare"], f"""(
        SELECT d.drug, d.cell_line, s.signature, avg(log2FoldChange) AS log2fc, min(padj) AS padj, count(*) AS n_genes,
               (pow(2.0, avg(log2FoldChange)) - 1) * 100 AS pct_change
        FROM de d JOIN (SELECT signature, gene FROM signatures
                        UNION ALL SELECT 'rare', {gene('p_partkey')} FROM (SELECT min(p_partkey) AS p_partkey FROM part)) s
        ON d.gene_name = s.gene GROUP BY d.drug, d.cell_line, s.signature)"""),
    "indexed_fetch": f"SELECT {DE_COLS} FROM de WHERE drug = 'NATION_3' AND cell_line = 'BUILDING'",
    "assemble_treatments": f"""
        SELECT {TRT}, moa_fine, replace(targets, ', ', ',') AS targets, organ, n_mutations
        FROM index_ JOIN drugs USING (drug)
        JOIN (SELECT cell_name AS cell_line, arg_min(Organ, ord) AS organ, count(gene) AS n_mutations FROM cells GROUP BY cell_name) USING (cell_line)""",
    "name_overlap": f"""
        SELECT norm_name, left_name, right_name
        FROM (SELECT {NORM.format('p_name')} AS norm_name, max(p_name) AS left_name FROM part GROUP BY 1)
        JOIN (SELECT {NORM.format('external_name')} AS norm_name, max(external_name) AS right_name FROM external GROUP BY 1) USING (norm_name)""",
    "semi_join_response": """
        SELECT drug AS DRUG_NAME, lower(cell_line) AS CELL_LINE_NAME, log2FoldChange AS LN_IC50, l_orderkey, l_linenumber FROM de
        WHERE drug IN (SELECT drug FROM drugs WHERE moa_fine LIKE '%class 1%') AND cell_line IN (SELECT cell_name FROM cells WHERE gene = 'NATION_3')""",
    "skip_cached": f"SELECT {TRT}, file_num FROM index_ WHERE ({TRT}) NOT IN (SELECT ({TRT}) FROM members WHERE cell_line = 'BUILDING')",
    "heldout_guard": "SELECT event_id, drug, cell_line, restricted FROM guarded WHERE action = 'experiment'",
    "set_membership": f"SELECT {KEY}, gene, size FROM members",
    "signature_coverage": """
        SELECT lower(p_type) AS signature, count(*) FILTER (p_partkey % 3 <> 0) AS n_found, count(*) AS n_total FROM part GROUP BY 1""",
    "treatment_grid": """
        SELECT drug, n_potential, coalesce(n, 0) AS n_present, n_potential - coalesce(n, 0) AS n_missing,
             coalesce((SELECT string_agg(l.cell_line, ',' ORDER BY l.cell_line)
                       FROM (SELECT DISTINCT cell_name AS cell_line FROM cells UNION SELECT 'UNLISTED') l
                       WHERE NOT EXISTS (SELECT 1 FROM de WHERE de.drug = drugs.drug AND de.cell_line = l.cell_line)), '') AS missing
        FROM drugs LEFT JOIN (SELECT drug, count(DISTINCT cell_line) AS n FROM de WHERE cell_line IN (SELECT cell_name FROM cells) GROUP BY drug) USING (drug),
             (SELECT count(DISTINCT cell_name) + 1 AS n_potential FROM cells)""",
    "signature_scores": f"SELECT drug, cell_line, signature, n_genes, {rnd('log2fc', 'padj', 'pct_change')} FROM scores",
    "pathway_activity": """
        SELECT d.drug, d.cell_line, d.concentration, s.signature, round(avg(log2FoldChange), 10) + 0.0 AS log2fc, round(min(padj), 6) AS padj,
               count(*) AS n_genes, round((pow(2.0, avg(log2FoldChange)) - 1) * 100, 6) AS pct_change
        FROM de d JOIN signatures s ON d.gene_name = s.gene GROUP BY d.drug, d.cell_line, d.concentration, s.signature""",
    "score_responses": f"""
        SELECT w.*, d.moa_fine, d.moa_broad, d.targets, c.cell_name, c.Organ, c.Driver_Gene_Symbol
        FROM ({wide(SIGNATURES)}) w LEFT JOIN drugs d USING (drug) LEFT JOIN ({FIRST_CELL}) c ON w.cell_line = c.cell_name""",
    "treatment_index": f"SELECT {TRT}, file_num FROM index_",
    "index_and_enrich": f"""
        SELECT {TRT}, file_num, n_pathways, n_significant, top_nes FROM index_
        LEFT JOIN (SELECT {TRT}, count(*) AS n_pathways, count(*) FILTER (fdr < {THRESHOLD}) AS n_significant, round(max(nes), 6) AS top_nes
                   FROM enr GROUP BY {TRT}) USING ({TRT})""",
    "value_counts": "SELECT gene AS value, count(*) AS n FROM cells WHERE gene IS NOT NULL GROUP BY gene ORDER BY n DESC, value LIMIT 20",
    "metadata_summary": """
        SELECT 'drugs' AS metric, count(*) AS value FROM drugs UNION ALL SELECT 'moa_broad', count(DISTINCT moa_broad) FROM drugs
        UNION ALL SELECT 'moa_fine', count(DISTINCT moa_fine) FROM drugs UNION ALL SELECT 'cell_lines', count(DISTINCT cell_name) FROM cells
        UNION ALL SELECT 'driver_genes', count(DISTINCT gene) FROM cells UNION ALL SELECT 'cell_line_entries', count(*) FROM cells
        UNION ALL SELECT 'genes', count(*) FROM part""",
    "organ_distribution": "SELECT Organ AS organ, count(*) AS n FROM (SELECT cell_name, arg_min(Organ, ord) AS Organ FROM cells GROUP BY cell_name) GROUP BY 1",
    "nest_cell_lines": f"""
        SELECT cell_name AS cell_line, arg_min(Organ, ord) AS organ,
               coalesce(string_agg({MUTATION_TEXT}, ',' ORDER BY ord) FILTER (gene IS NOT NULL), '') AS mutations FROM cells GROUP BY cell_name""",
    "gene_name_breakdown": f"""
        SELECT {TRT}, count(*) AS total, count(*) FILTER (gene_name LIKE 'ENSG%') AS ensembl_only,
               count(*) FILTER (gene_name NOT LIKE 'ENSG%') AS has_symbol,
               round(100.0::DOUBLE * count(*) FILTER (gene_name NOT LIKE 'ENSG%') / count(*), 6) AS symbol_pct,
               round(100.0::DOUBLE * count(*) FILTER (gene_name LIKE 'ENSG%') / count(*), 6) AS ensembl_pct
        FROM de GROUP BY {TRT}""",
    "question_summary": """
        SELECT question_id, count(*) AS n_items, count(*) FILTER (ground_truth) AS n_true,
               round(100.0::DOUBLE * count(*) FILTER (ground_truth) / count(*), 6) AS pct_true FROM items GROUP BY question_id""",
    "truth_by_mutation": """
        SELECT question_id, mutation_group, count(*) AS n_items, count(*) FILTER (ground_truth) AS n_true, round(avg(nes), 6) AS mean_nes
        FROM (SELECT i.*, unnest(CASE WHEN a AND b THEN ['NATION_3 mutant', 'NATION_5 mutant'] WHEN a THEN ['NATION_3 mutant']
                     WHEN b THEN ['NATION_5 mutant'] ELSE ['neither'] END) AS mutation_group
              FROM (SELECT items.*, cell_line IN (SELECT cell_name FROM cells WHERE gene = 'NATION_3') AS a,
                           cell_line IN (SELECT cell_name FROM cells WHERE gene = 'NATION_5') AS b FROM items) i)
        GROUP BY question_id, mutation_group""",
    "avg_lfc_by_treatment": "SELECT drug, cell_line, round(avg(log2FoldChange), 10) + 0.0 AS mean_lfc FROM de GROUP BY drug, cell_line",
    "avg_lfc_one_gene": """
        SELECT drug, cell_line, round(avg(log2FoldChange), 10) + 0.0 AS mean_lfc FROM de WHERE gene_name = 'g7' GROUP BY drug, cell_line""",
    "avg_lfc_one_gene_sql": """
        SELECT drug, cell_line, round(avg(log2FoldChange), 10) + 0.0 AS mean_lfc FROM de WHERE gene_name = 'g11' GROUP BY drug, cell_line""",
    "top_activated": f"SELECT {KEY}, round(nes, 6) AS nes, rank FROM ({top('', 'nes DESC', 3, 'nes > 0')})",
    "top_repressed": f"SELECT {KEY}, round(nes, 6) AS nes, rank FROM ({top('', 'nes', 3, 'nes < 0')})",
    "top_genes": f"{top_gene('up', 'DESC')} UNION ALL {top_gene('down', 'ASC')}",
    "sig_top_bottom": f"""
        SELECT {KEY}, side, rank, {rnd('nes', 'fdr')} FROM (
          {top("'up' AS side,", 'nes DESC', 2, f'nes > 0 AND fdr < {THRESHOLD}')}
          UNION ALL {top("'down' AS side,", 'nes', 2, f'nes < 0 AND fdr < {THRESHOLD}')})""",
    "sample_rows": f"SELECT {DE_COLS} FROM (SELECT * FROM de ORDER BY {ROW_ORDER} LIMIT 1000)",
    "ranked_genes": f"SELECT {TRT}, gene, round(metric, 6) AS metric, position, n_genes FROM ranked",
    "enrichment_score": f"SELECT {KEY}, size, round(es, 6) AS es FROM extremes",
    "leading_edge": f"SELECT {KEY}, leading_edge FROM edges",
    "null_scores": f"SELECT {KEY}, permutation, round(null_es, 6) AS null_es FROM nulls",
    "nes_pvalue": f"SELECT {KEY}, {rnd('nes', 'pvalue')} FROM normal",
    "fdr_qvalue": f"SELECT {KEY}, {rnd('nes', 'fdr')} FROM enr",
    "enrich_cell_line": f"{RESULT} WHERE cell_line = 'BUILDING'",
    "prerank_scale": RESULT,
    "prerank_relational": RESULT,
    "null_tail_counts": f"SELECT {KEY}, null_n, null_extreme, pool_n::BIGINT AS pool_n, pool_extreme::BIGINT AS pool_extreme FROM enr",
    "union_results": RESULT,
    "intersect_names": f"SELECT {NORM.format('p_name')} AS name FROM part INTERSECT SELECT {NORM.format('external_name')} FROM external",
    "intersection_counts": """
        SELECT (SELECT count(DISTINCT drug) FROM drugs) AS n_left, (SELECT count(DISTINCT gene) FROM cells WHERE gene = 'NATION_3') AS n_right,
               (SELECT count(DISTINCT drug) FROM drugs WHERE drug IN (SELECT gene FROM cells WHERE gene = 'NATION_3')) AS n_both""",
    "remaining_files": "SELECT DISTINCT file_num FROM de WHERE file_num % 2 = 1",
    "all_signature_genes": "SELECT DISTINCT gene FROM signatures",
    "parse_drugs": """
        SELECT drug, CASE WHEN targets <> 'None' THEN replace(targets, ', ', ',') END AS targets, moa_broad, moa_fine, human_approved,
               clinical_trials, canonical_smiles, pubchem_cid FROM drugs""",
    "round_conc": "SELECT DISTINCT concentration, round(concentration, 1) AS conc_key FROM de",
    "pct_change": "SELECT DISTINCT log2FoldChange, round((pow(2.0, log2FoldChange) - 1) * 100, 6) AS pct_change FROM de",
    "normalise_names": f"SELECT DISTINCT external_name, {NORM.format('external_name')} AS norm_name FROM external",
    "safe_key": """
        SELECT drug || '_' || round(concentration, 1)::VARCHAR AS result_key, drug || '_' || concentration::VARCHAR || 'uM_' || cell_line AS label FROM index_""",
    "ic50_um": 'SELECT DISTINCT log2FoldChange AS LN_IC50, round(exp(log2FoldChange), 4) AS "IC50_uM" FROM de',
    "mutation_arrays": """
        SELECT cell_name AS cell_line, coalesce(bool_or(gene = 'NATION_3'), FALSE) AS has_mutation,
               coalesce(string_agg(gene || ':' || effect, ',' ORDER BY ord) FILTER (gene IS NOT NULL AND gene_type = 'Oncogene'), '') AS oncogenes,
               coalesce(string_agg(gene || ':' || effect, ',' ORDER BY ord) FILTER (gene IS NOT NULL AND gene_type = 'Suppressor'), '') AS tumor_suppressors
        FROM cells GROUP BY cell_name""",
    "kras_status": """
        SELECT requested, CASE WHEN count(cell_name) = 0 THEN 'NOT FOUND' WHEN count(*) FILTER (gene = 'NATION_3') = 0 THEN 'wildtype'
               ELSE arg_min(effect, ord) FILTER (gene = 'NATION_3') END AS status
        FROM (SELECT DISTINCT lower(substr(cell_name, 1, 4)) AS requested FROM cells UNION SELECT drug FROM drugs)
        LEFT JOIN cells ON contains(lower(cell_name), lower(requested)) GROUP BY requested""",
    "drug_lookup_status": """
        SELECT requested, CASE WHEN count(drug) = 0 THEN 'NOT FOUND' ELSE arg_min(moa_fine, ord) END AS status
        FROM (SELECT lower(n_name) AS requested FROM nation UNION ALL SELECT r_name FROM region)
        LEFT JOIN drugs ON contains(lower(drug), lower(requested)) GROUP BY requested""",
    "drug_report": """
        SELECT drug, concat_ws(chr(10), '# ' || drug, '- Mechanism (broad): ' || moa_broad, '- Mechanism (fine): ' || moa_fine,
                 '- Targets: ' || CASE WHEN targets = 'None' THEN 'Unknown' ELSE targets END,
                 '- Human approved: ' || CASE WHEN human_approved THEN 'Yes' ELSE 'No' END,
                 '- Clinical trials: ' || CASE WHEN clinical_trials THEN 'Yes' ELSE 'No' END,
                 CASE WHEN pubchem_cid <> 0 THEN '- PubChem CID: ' || pubchem_cid END) AS report FROM drugs""",
    "cell_line_report": """
        SELECT cell_name AS cell_line, concat_ws(chr(10), '# ' || cell_name, '- Organ/tissue: ' || arg_min(Organ, ord),
                 '- Driver mutations (' || count(gene) || '):',
                 coalesce(string_agg('  - ' || gene || coalesce(' (' || effect || ')', '') || ': ' || var_type || coalesce(' [' || mech || ']', '')
                                     || ' (' || gene_type || ')', chr(10) ORDER BY ord) FILTER (gene IS NOT NULL),
                          '  (no annotated driver mutations)')) AS report
        FROM cells GROUP BY cell_name""",
    "experiment_report": f"""
        SELECT {TRT}, coalesce(n, 0) AS significant_count,
               concat_ws(chr(10), '# Experiment Results: ' || drug || ' @ ' || concentration::VARCHAR || 'uM in ' || cell_line, '',
                 '## Cell Line Context', '- Organ: ' || organ, '- Driver mutations: ' || coalesce(muts, 'None annotated'), '',
                 '## Drug Context', '- Mechanism: ' || moa_fine, '- Targets: ' || CASE WHEN targets = 'None' THEN 'Unknown' ELSE targets END, '',
                 '## Pathway Activities', 'Significant pathways (FDR < {THRESHOLD}): ' || coalesce(n, 0), '',
                 '### Top Activated Pathways (positive NES):', coalesce(u.lines, '(none)'), '',
                 '### Top Repressed Pathways (negative NES):', coalesce(d.lines, '(none)')) AS report
        FROM index_ JOIN drugs USING (drug)
        JOIN (SELECT cell_name AS cell_line, arg_min(Organ, ord) AS organ, string_agg(gene, ', ' ORDER BY ord) FILTER (gene IS NOT NULL) AS muts
              FROM cells GROUP BY cell_name) USING (cell_line)
        LEFT JOIN (SELECT {TRT}, count(*) AS n FROM enr WHERE fdr < {THRESHOLD} GROUP BY {TRT}) USING ({TRT})
        LEFT JOIN {bullets('nes > 0', 'DESC')} u USING ({TRT}) LEFT JOIN {bullets('nes < 0', 'ASC')} d USING ({TRT})""",
    "ground_truth": f"""
        SELECT {KEY}, direction, coalesce(fdr < {THRESHOLD} AND CASE direction WHEN 'activated' THEN nes > 0 WHEN 'repressed' THEN nes < 0 ELSE TRUE END, FALSE) AS ground_truth
        FROM enr, (SELECT unnest(['activated', 'repressed', 'either']) AS direction)""",
    "build_questions": f"SELECT question_id, direction, cell_line, ground_truth, {rnd('nes', 'fdr')} FROM items",
    "unmatched_questions": """
        SELECT question_id, drug, concentration, target_pathway FROM questions
        WHERE (drug, concentration, target_pathway) NOT IN (SELECT (drug, concentration, pathway) FROM members)""",
    "task_rows": """
        SELECT question_id, question AS question_text, target_pathway, coalesce(n, 0) AS test_set_size, 'test' AS split
        FROM questions LEFT JOIN (SELECT question_id, count(*) AS n FROM items GROUP BY question_id) USING (question_id)""",
    "split_tasks": """
        SELECT question_id, position AS shuffle_position,
               CASE WHEN position < floor(n * 0.7::DOUBLE) THEN 'train' WHEN position < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT question_id, row_number() OVER (ORDER BY md5('42:' || question_id), question_id) - 1 AS position, count(*) OVER () AS n FROM questions)""",
    "replay_episodes": "SELECT episode, event_id, action, accepted, reason, step, experiments_run, done, found FROM replay",
    "step_scores": """
        SELECT episode, step, hs AS hypothesis_score, iscore AS interpretation_score, round((hs + iscore) / 2, 6) AS step_score
        FROM steps WHERE iscore IS NOT NULL""",
    "trajectory": """
        SELECT episode, learned_knowledge, knowledge_version, trajectory
        FROM (SELECT episode, arg_max(note, (ts, event_id)) FILTER (action = 'knowledge') AS learned_knowledge,
                     arg_max(step, (ts, event_id)) FILTER (action = 'knowledge') AS knowledge_version FROM accepted GROUP BY episode)
        LEFT JOIN (SELECT episode, string_agg(concat_ws('|', step, hypothesis, CASE WHEN iscore IS NOT NULL THEN hs::VARCHAR ELSE '-' END,
                     coalesce(experiment, '-|-|-'), coalesce(interpretation, '-'), coalesce(iscore::VARCHAR, '-')), ';' ORDER BY step) AS trajectory
                   FROM steps GROUP BY episode) USING (episode)""",
    "episode_progress": """
        SELECT question_id, t, round(accuracy, 6) AS accuracy,
               round(first_value(accuracy) OVER (PARTITION BY question_id ORDER BY t DESC) - first_value(accuracy) OVER (PARTITION BY question_id ORDER BY t), 6) AS s_progress
        FROM (SELECT question_id, t, avg((((length(cell_line) + length(target_pathway) + t) % 2 = 1) = ground_truth)::INTEGER) AS accuracy
              FROM items, (SELECT unnest(range(5))::INTEGER AS t) GROUP BY question_id, t)""",
    "episode_score": f"""
        SELECT episode, steps_completed, experiments_run, {rnd('s_process', 's_process_sum', 's_progress', 's_episode', 's_episode_sum', 'total_reward')} FROM escores""",
    "evaluation_summary": """
        SELECT round(avg(s_process), 6) AS mean_s_process, round(avg(s_progress), 6) AS mean_s_progress, round(avg(s_episode), 6) AS mean_s_episode,
               count(*) AS total_episodes, sum(experiments_run)::BIGINT AS total_experiments FROM escores""",
    "stream_signature_filter": f"""
        SELECT {DE_COLS}, signature FROM de JOIN signatures ON gene_name = gene""",
    "stream_first_seen": f"SELECT {TRT}, file_num FROM index_",
    "stream_replay": "SELECT episode, event_id, action, accepted, reason, step, experiments_run, done, found FROM replay",
}

ORACLES = {name: sql(body, VIEWS | {"members": ANY_MEMBERS} if name in ANY_SIZE else VIEWS) for name, body in BODIES.items()}
