"""Enrichment against a plain running-sum implementation on small random data."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doseframe.operators import enrichment as E
from doseframe.operators import nulls as N
from doseframe.plans.enrich import Prerank, enrich_cell_line, index_and_enrich, prerank, prerank_relational

DE = "gene_name string, log2FoldChange double, padj double, drug string, concentration double, cell_line string, ord int, file_num int"
PARAMS = Prerank(min_size=3, max_size=12, permutations=30)


def scores_at(positions, weights):
    """Scores of sets given by the ranks of their genes, one set a row."""
    return N.Stretches(list(positions), weights).scores(np.arange(len(weights))[None, :])[0]


def permuted_positions(codes, numbers):
    return np.argsort(N.permuted_order(codes, numbers), axis=1)


def full_running_sum(weights, is_hit):
    """The score by walking the whole ranking, gene by gene."""
    total, n_miss = weights[is_hit].sum(), (~is_hit).sum()
    if total == 0 or n_miss == 0:
        return None
    walk = np.cumsum(np.where(is_hit, weights / total, -1.0 / n_miss))
    high, low = max(round(walk.max(), 10), 0.0), min(round(walk.min(), 10), 0.0)
    return high if high >= -low else low


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_scores_at_hits_equal_full_walk(data):
    n = data.draw(st.integers(3, 30))
    weights = np.array(data.draw(st.lists(st.floats(0, 5).map(lambda x: round(x, 3)), min_size=n, max_size=n)))
    hits = np.array(sorted(data.draw(st.sets(st.integers(0, n - 1), min_size=1, max_size=n))))
    mask = np.zeros(n, bool)
    mask[hits] = True
    want = full_running_sum(weights, mask)
    got = scores_at(hits[None, :], weights)[0]
    if want is None:
        assert math.isnan(got)
    else:
        # At an exact tie of peak and trough the last digit of a float sum decides the sign.
        assert abs(got - want) < 1e-9 or abs(abs(got) - abs(want)) < 1e-9


@pytest.fixture(scope="module")
def facts(spark):
    """Three treatments; one of them holds most of the rows, many of them repeats."""
    rng = np.random.default_rng(7)
    rows = []
    for drug, conc, line, repeat in [("d1", 0.05, "c1", 1), ("d1", 5.0, "c1", 40), ("d2", 5.0, "c2", 1)]:
        for g in range(60):
            for k in range(repeat if g < 30 else 1):
                name = f"ENSG{g}" if g % 10 == 9 else f"g{g}"
                padj = None if g % 17 == 16 else float(rng.integers(0, 100)) / 100
                rows.append((name, float(rng.normal()), padj, drug, conc, line, len(rows), g % 3))
    return spark.createDataFrame(rows, DE)


@pytest.fixture(scope="module")
def sets(spark):
    rng = np.random.default_rng(11)
    rows = [(f"s{i}", f"G{g}") for i, k in enumerate([2, 3, 5, 8, 12, 20]) for g in rng.choice(60, k, replace=False)]
    return spark.createDataFrame(rows, "pathway string, gene string")


def brute_ranking(facts):
    pdf = facts.toPandas().sort_values("ord").dropna(subset=["gene_name", "log2FoldChange", "padj"])
    pdf = pdf[~pdf.gene_name.str.startswith("ENSG")]
    pdf["gene"] = pdf.gene_name.str.upper()
    out = {}
    for key, g in pdf.groupby(["cell_line", "drug", "concentration"]):
        g = g.drop_duplicates("gene")
        metric = np.sign(g.log2FoldChange) * -np.log10(g.padj.clip(lower=1e-300)) + 0.0
        out[key] = g.assign(metric=metric).sort_values(["metric", "gene"], ascending=[False, True])[["gene", "metric"]]
    return out


def test_ranking(facts):
    got = E.public(E.ranked_genes(facts, "ord")).toPandas()
    for key, want in brute_ranking(facts).items():
        mine = got[(got.cell_line == key[0]) & (got.drug == key[1]) & (got.concentration == key[2])].sort_values("position")
        assert list(mine.gene) == list(want.gene)
        assert np.allclose(mine.metric, want.metric)
        assert (mine.n_genes == len(want)).all()
        assert list(mine.position) == list(range(len(want)))


def brute(facts, sets, params):
    """Scores, permutation nulls and statistics in plain numpy, walking the whole ranking each time."""
    members = sets.toPandas().groupby("pathway").gene.agg(set)
    rows = []
    for key, ranking in brute_ranking(facts).items():
        genes, weights = ranking.gene.to_numpy(), ranking.metric.abs().to_numpy()
        names = np.sort(genes)
        codes = np.array([int(__import__("hashlib").md5(g.encode()).hexdigest()[:8], 16) for g in names])
        shuffles = permuted_positions(codes, E.permutation_base(params.seed) + np.arange(params.permutations))
        found = []
        for name, wanted in members.items():
            hit = np.isin(genes, list(wanted))
            if not params.min_size <= hit.sum() <= params.max_size:
                continue
            null = []
            for positions in shuffles:
                mask = np.zeros(len(genes), bool)
                mask[positions[np.isin(names, list(wanted))]] = True
                null.append(full_running_sum(weights, mask))
            found.append((name, full_running_sum(weights, hit), np.array(null), hit.sum()))
        stats = []
        for name, es, null, size in found:
            same = null[(null >= 0) == (es >= 0)]
            up, down = null[null >= 0], null[null < 0]
            scale = np.where(null >= 0, up.mean() if len(up) else np.nan, -down.mean() if len(down) else np.nan)
            nes = round(es / abs(same.mean()), 10) if len(same) else None
            p = (abs(same) >= abs(es)).mean() if len(same) else None
            stats.append((name, es, nes, p, np.round(null / scale, 10), size))
        pool = np.concatenate([s[4] for s in stats])
        observed = np.array([s[2] for s in stats if s[2] is not None])
        for name, es, nes, p, _, size in stats:
            fdr = None
            if nes is not None:
                side = (lambda v: v[(v >= 0) == (nes >= 0)])
                fdr = min(1.0, (abs(side(pool)) >= abs(nes)).mean() / (abs(side(observed)) >= abs(nes)).mean())
            rows.append((*key, name, nes, p, fdr))
    return {r[:4]: r[4:] for r in rows}


@pytest.mark.parametrize("run", [prerank, prerank_relational])
def test_prerank_equals_brute_force(facts, sets, run):
    got = {(r.cell_line, r.drug, r.concentration, r.pathway): (r.nes, r.pvalue, r.fdr) for r in run(facts, sets, "ord", PARAMS).collect()}
    want = brute(facts, sets, PARAMS)
    assert set(got) == set(want) and len(got) > 5
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-9), key


def test_leading_edge(spark):
    ranked = spark.createDataFrame(
        [("c", "d", "5.0", f"G{i}", float(5 - i), i, 10) for i in range(10)],
        "cell_line string, drug string, dose string, gene string, metric double, position int, n_genes long",
    )
    sets = spark.createDataFrame([("up", "g0"), ("up", "g1"), ("up", "g9"), ("down", "g1"), ("down", "g8"), ("down", "g9")], "pathway string, gene string")
    got = {r.pathway: r for r in E.score_sets(E.scored_members(E.set_membership(ranked, sets, 1, 10))).collect()}
    assert got["up"].leading_edge == "G0;G1" and got["up"].es > 0
    assert got["down"].leading_edge == "G8;G9" and got["down"].es < 0


def test_score_is_null_without_weight_or_misses(spark):
    schema = "cell_line string, drug string, dose string, gene string, metric double, position int, n_genes long"
    ranked = spark.createDataFrame([("c", "d", "5.0", f"G{i}", 0.0, i, 4) for i in range(4)], schema)
    weightless = spark.createDataFrame([("s", "g0"), ("s", "g1")], "pathway string, gene string")
    everything = spark.createDataFrame([("s", f"g{i}") for i in range(4)], "pathway string, gene string")
    for sets in (weightless, everything):
        assert E.enrichment_score(E.set_membership(ranked, sets, 1, 10)).first().es is None


def test_orders_follow_the_stated_key():
    """The key spelled out with whole numbers, also for equal codes and a single gene."""
    rng = np.random.default_rng(5)
    for codes in (rng.integers(0, 2**32, 500), np.array([7, 7, 7, 2**32 - 1, 0]), np.array([12])):
        for number in (0, 4_200_000, 99_999_999):
            keys = []
            for i, c in enumerate(codes.tolist()):
                x = (c + number * 1000003) % 2147483647
                x = (x ^ x >> 15) * 739982445 % 2147483647
                x = (x ^ x >> 12) * 695872825 % 2147483647
                keys.append((x ^ x >> 15, i))
            assert N.permuted_order(codes, np.array([number]))[0].tolist() == [i for _, i in sorted(keys)]


def test_stretches_do_not_depend_on_each_other(monkeypatch):
    """Scores of a set alone, beside heavy sets, and in blocks of any size."""
    rng = np.random.default_rng(8)
    n = 400
    weights, codes = np.concatenate([[300.0] * 5, rng.exponential(1e-3, n - 5)]), rng.integers(0, 2**32, n)
    sets = [rng.choice(n, k, replace=False) for k in (3, 50, 7, 200, 1, n)]
    together = N.Stretches(sets, weights).null_scores(codes, 5, 40)
    alone = np.concatenate([N.Stretches([s], weights).null_scores(codes, 5, 40) for s in sets])
    assert np.isnan(together[-1]).all() and np.allclose(together[:-1], alone[:-1], atol=1e-10)
    monkeypatch.setattr(N, "BLOCK_CELLS", 1)
    assert np.array_equal(N.Stretches(sets, weights).null_scores(codes, 5, 40), together, equal_nan=True)
    order = N.permuted_order(codes, np.array([5]))[0]
    rank = np.argsort(order)
    for i, s in enumerate(sets[:-1]):
        assert abs(together[i, 0] - full_running_sum(weights, np.isin(np.arange(n), rank[s]))) < 1e-9


def test_permutations_are_uniform():
    """Every gene lands in every tenth of the ranking about equally often, and pairs are not tied together."""
    codes = np.array([int(__import__("hashlib").md5(f"G{i}".encode()).hexdigest()[:8], 16) for i in range(200)])
    positions = permuted_positions(codes, E.permutation_base(42) + np.arange(2000))
    assert (np.sort(positions, axis=1) == np.arange(200)).all()
    counts = np.stack([(positions // 20 == k).sum(axis=0) for k in range(10)])
    chi = ((counts - 200) ** 2 / 200).sum(axis=0)
    assert chi.mean() < 11 and chi.max() < 45
    correlation = np.corrcoef(positions[:, :50].T)
    assert np.abs(correlation[~np.eye(50, dtype=bool)]).max() < 0.12


def test_null_scores_look_like_random_sets():
    rng = np.random.default_rng(3)
    weights = np.sort(rng.exponential(size=300))[::-1]
    codes = rng.integers(0, 2**32, 300)
    ours = scores_at(permuted_positions(codes, np.arange(4000))[:, :20], weights)
    drawn = scores_at(np.stack([rng.choice(300, 20, replace=False) for _ in range(4000)]), weights)
    for q in (0.05, 0.25, 0.5, 0.75, 0.95):
        assert abs(np.quantile(ours, q) - np.quantile(drawn, q)) < 0.05


def keys(df):
    return {tuple(r) for r in df.select("cell_line", "drug", "concentration").distinct().collect()}


def results(df):
    cols = ["cell_line", "drug", "concentration", "pathway", "nes", "pvalue", "fdr", "leading_edge"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_cached_results_are_reused(facts, sets):
    everything = prerank(facts, sets, "ord", PARAMS)
    cached = everything.where("concentration = 5.0").withColumn("leading_edge", F.lit("stored"))
    got = enrich_cell_line(facts, sets, "ord", "c1", cached=cached, params=PARAMS)
    assert keys(got) == {("c1", "d1", 0.05), ("c1", "d1", 5.0)}
    assert {r.leading_edge for r in got.where("concentration = 5.0").collect()} == {"stored"}
    assert results(got.where("concentration = 0.05")) == results(everything.where("concentration = 0.05"))
    assert enrich_cell_line(facts, sets, "ord", "c1", drugs=["nope"], params=PARAMS).count() == 0


def test_index_and_enrich_equals_both_jobs(facts, sets, tmp_path):
    index, found = index_and_enrich(facts, sets, "ord", str(tmp_path / "genes"), PARAMS)
    assert {(r.cell_line, r.drug, r.concentration, r.file_num) for r in index.collect()} == {
        ("c1", "d1", 0.05, 0), ("c1", "d1", 5.0, 0), ("c2", "d2", 5.0, 0)
    }
    assert results(found) == results(prerank(facts, sets, "ord", PARAMS))


def test_index_keeps_treatments_without_usable_genes(spark, sets, tmp_path):
    rows = [("ENSG1", 1.0, 0.1, "d", 0.05, "c", 1, 7), ("ENSG1", 1.0, 0.1, "d", 0.1, "c", 2, 8)]
    index, found = index_and_enrich(spark.createDataFrame(rows, DE), sets, "ord", str(tmp_path / "genes"), PARAMS)
    # Two doses that share a label stay apart.
    assert {(r.concentration, r.file_num) for r in index.collect()} == {(0.05, 7), (0.1, 8)}
    assert found.count() == 0


def test_enrichment_shuffles_twice(facts, sets):
    """One shuffle of facts by gene, one by treatment; the rest of the job stays in place."""
    scored = N.null_tails(E.scored_members(E.with_sets(E.ranked_genes(facts, "ord"), F.broadcast(sets), 3, 12)), 5)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    on_treatment = [l for l in plan.splitlines() if "Exchange hashpartitioning(cell_line" in l]
    assert len(on_treatment) == 2, plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_intermediate_is_read_without_another_shuffle(facts, sets, tmp_path):
    """Index and enrichment start from one table in buckets by treatment."""
    index, found = index_and_enrich(facts, F.broadcast(sets), "ord", str(tmp_path / "genes"), PARAMS, buckets=3)
    assert "Exchange" not in plan_of(index)
    # The significance windows pool by sign of the score, which is another key.
    before = plan_of(found).split("FlatMapGroupsInArrow")[1]
    assert "Exchange hashpartitioning(cell_line" not in before and "SelectedBucketsCount: 3 out of 3" in before
    assert index.count() == 3 and results(found) == results(prerank(facts, sets, "ord", PARAMS))


def test_sets_without_a_score_stay_in_both_modes(spark):
    """A set of weightless genes and one of all genes, next to ordinary ones."""
    rows = [(f"g{g}", float(g - 10), 1.0 if g < 4 else 0.01 + g / 100, "d", 5.0, "c", g, 0) for g in range(20)]
    rows += [(f"g{g}", 1.0, 1.0, "e", 5.0, "c", 100 + g, 0) for g in range(6)]
    members = {"flat": range(4), "all": range(20), "mixed": range(2, 9), "high": range(12, 18)}
    sets = spark.createDataFrame([(p, f"g{g}") for p, gs in members.items() for g in gs], "pathway string, gene string")
    facts = spark.createDataFrame(rows, DE)
    params = Prerank(min_size=3, max_size=30, permutations=25)
    one, other = prerank(facts, sets, "ord", params), prerank_relational(facts, sets, "ord", params)
    assert results(one) == results(other)
    got = {(r.drug, r.pathway): (r.nes, r.pvalue, r.fdr) for r in one.collect()}
    assert got["d", "flat"] == got["d", "all"] == got["e", "flat"] == (None, None, None)
    assert None not in got["d", "high"] and set(p for d, p in got if d == "d") == set(members)
    # A treatment with no score at all has rows too, and so is not computed again.
    again = enrich_cell_line(facts, sets, "ord", "c", cached=one.withColumn("leading_edge", F.lit("stored")), params=params)
    assert {r.leading_edge for r in again.collect()} == {"stored"}


def test_facts_are_reduced_by_hash(facts, sets):
    from doseframe.operators.enrichment import best_rows

    plan = best_rows(facts, "ord")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2


def test_treatments_without_an_allowed_set_are_dropped_before_ranking(spark, monkeypatch):
    """A set of each treatment is too large, too small or allowed; null keys stay, with their results."""
    sizes = {("big", "c"): 30, ("small", "c"): 2, ("right", "c"): 6, (None, "c"): 6, ("none", None): 30}
    rows = [
        (f"g{g}", float(g % 7 - 3), (g % 9 + 1) / 10, drug, 5.0, line, g, 0)
        for (drug, line), n in sizes.items()
        for g in [*range(n), *range(100, 110)]
    ]
    facts = spark.createDataFrame(rows, DE)
    sets = spark.createDataFrame([("s", f"G{g}") for g in range(30)] + [(None, "G100")], "pathway string, gene string")
    whole = E.significance(N.null_tails(E.scored_members(E.with_sets(E.ranked_genes(facts, "ord"), sets, 3, 12)), 30))
    seen = set()

    def watched(scored, *args):
        seen.update((r.drug, r.cell_line) for r in scored.select("drug", "cell_line").distinct().collect())
        return N.null_tails(scored, *args)

    monkeypatch.setattr("doseframe.plans.enrich.null_tails", watched)
    found = results(prerank(facts, sets, "ord", PARAMS))
    assert seen == {("right", "c"), (None, "c"), ("none", None)}
    assert found == results(E.public(whole)) and len(found) == 2


def test_facts_of_treatments_without_an_allowed_set_are_not_shuffled(facts, sets):
    """The treatments to rank are broadcast and meet the facts below the aggregate, so before any shuffle of them."""
    lines = E.rankable_genes(E.best_rows(facts, "ord"), sets, 3, 12)._jdf.queryExecution().executedPlan().toString().splitlines()
    (join,) = [i for i, line in enumerate(lines) if "LeftSemi" in line]
    assert "BroadcastHashJoin" in lines[join]
    first = next(i for i, line in enumerate(lines) if "partial_min_by" in line)
    shuffles = [i for i, line in enumerate(lines[:join]) if "Exchange" in line]
    assert first < join and shuffles and max(shuffles) < first


class Rows:
    """Just the inputs that the enrichment queries ask for."""

    def __init__(self, facts, sets):
        self.facts, self.library = facts, sets

    def de(self):
        return self.facts.withColumnRenamed("ord", "row_key")

    def sets(self):
        return self.library


def test_significance_queries_make_no_row_per_permutation(facts, sets, monkeypatch):
    """The tails of ``nes_pvalue`` and ``fdr_qvalue`` come from the grouped map, with the results of the null's rows."""
    from bindings import queries as B

    monkeypatch.setattr(B, "PARAMS", PARAMS)
    tails = B.tails(Rows(facts, sets))
    assert "FlatMapGroupsInArrow" in plan_of(tails) and "permutation#" not in plan_of(tails)
    assert results(E.public(E.significance(tails))) == results(prerank_relational(facts, sets, "ord", PARAMS))


def test_rows_stay_with_their_treatment_without_broadcasts(spark, facts, sets):
    """However large the library, sets meet genes before these are dealt by treatment; two sorts follow, and no shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = E.rankable_genes(E.best_rows(facts, "ord"), sets, 3, 12)
        plan = plan_of(N.null_tails(E.scored_members(E.with_sets(ranked, sets, 3, 12)), 5))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32m")
    stage, dealt = plan.split("FlatMapGroupsInArrow")[1].split("Exchange", 1)
    assert dealt.lstrip().startswith("hashpartitioning(cell_line") and "pathway" not in dealt.split(")")[0]
    assert "Join" not in stage and stage.count("Sort [") == 2, stage


def test_buckets_hold_the_sets_of_their_genes(spark, facts, sets, tmp_path):
    """Without broadcasts, too, ranking and scores read the buckets as they are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, found = index_and_enrich(facts, sets, "ord", str(tmp_path / "genes"), PARAMS, buckets=3)
        above = plan_of(found).split("FlatMapGroupsInArrow")[1].split("BroadcastExchange")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32m")
    assert "Exchange" not in above and "SortMergeJoin" not in above, above
    assert results(found) == results(prerank(facts, sets, "ord", PARAMS))
