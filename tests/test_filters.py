import random

import pytest
from pyspark.sql import functions as F

from doseframe.operators import filters as S
from doseframe.operators import joins as J
from doseframe.operators import pathways as W
from doseframe.operators import records as R
from doseframe.operators import sets as U

DE = "gene_name string, log2FoldChange double, padj double, drug string, concentration double, cell_line string"
ENR = "cell_line string, drug string, concentration double, pathway string, nes double, fdr double"


@pytest.fixture(scope="module")
def de(spark):
    return spark.createDataFrame(
        [
            ("A", 1.0, 0.01, "O'Brien", 0.05, "c1"),
            ("B", -1.0, 0.02, "O'Brien", 5.0, "c1"),
            ("ENSG1", 2.0, 0.03, "d2", 0.05, "c2"),
            ("C", None, 0.04, "d2", 0.05, "c2"),
            ("D", 3.0, None, "d2", 0.05, "c2"),
            (None, 3.0, 0.5, "d2", 0.05, "c2"),
        ],
        DE,
    )


def test_fetch_filters_are_optional_and_quotes_are_safe(de):
    assert S.fetch_de(de).count() == 6
    assert S.fetch_de(de, drug="O'Brien").count() == 2
    assert S.fetch_de(de, drug="O'Brien", concentration=0.0504).count() == 1
    assert S.fetch_de(de, genes=["A", "C"], cell_line="c2").count() == 1
    assert S.fetch_de(de, genes=[]).count() == 0


def test_fetch_limit_needs_an_order(de):
    assert [r.gene_name for r in S.fetch_de(de, limit=2, order_by=["gene_name"], genes=["A", "B", "C"]).collect()] == ["A", "B"]
    assert S.fetch_de(de, limit=0).count() == 6
    with pytest.raises(ValueError):
        S.fetch_de(de, limit=2)


def test_genes_in_list_and_table_agree(spark, de):
    genes = spark.createDataFrame([("A",), ("A",), ("B",)], "gene string")
    assert S.genes_in_list(de, genes).count() == S.genes_in_list(de, ["A", "B"]).count() == 2


def test_validate_names(spark):
    vocab = spark.createDataFrame([(f"Drug{i}",) for i in range(8)] + [("Other",)], "name string")
    asked = spark.createDataFrame([("Drug1",), ("drug",), ("THE",), ("zzz",)], "requested string")
    got = {r.requested: (r.known, r.similar) for r in S.validate_names(asked, vocab).collect()}
    assert got == {
        "Drug1": (True, []),
        "drug": (False, [f"Drug{i}" for i in range(5)]),
        "THE": (False, ["Other"]),
        "zzz": (False, []),
    }


def test_moa_fallback(spark):
    drugs = spark.createDataFrame(
        [("a", "MEK inhibitor", "inhibitor"), ("b", "unclear", "MEK-like"), ("c", None, None)], "drug string, `moa-fine` string, `moa-broad` string"
    )
    assert [r.drug for r in S.drugs_by_moa_fallback(drugs, "mek").collect()] == ["a"]
    assert [r.drug for r in S.drugs_by_moa_fallback(drugs, "like").collect()] == ["b"]
    assert S.drugs_by_moa_fallback(drugs, "none").count() == 0
    assert [r.drug for r in S.drugs_by_moa(drugs, "INHIB", "broad").collect()] == ["a"]


def test_unusable_genes(de):
    assert [r.gene_name for r in S.drop_unusable_genes(de).orderBy("gene_name").collect()] == ["A", "B"]
    row = S.unusable_gene_counts(de, ["cell_line"]).where("cell_line = 'c2'").first()
    assert (row.n_rows, row.n_null, row.n_ensembl, row.n_kept) == (4, 3, 1, 0)


def test_coerce_numeric(spark):
    raw = spark.createDataFrame([("p", "1.5", "x", "0.1", "G")], "Term string, NES string, `NOM p-val` string, `FDR q-val` string, Lead_genes string")
    got = S.coerce_numeric(raw, ["nes", "pvalue", "fdr"], S.RESULT_COLUMNS).first()
    assert (got.pathway, got.nes, got.pvalue, got.fdr, got.leading_edge) == ("p", 1.5, None, 0.1, "G")


def test_select_existing(spark):
    assert S.select_existing_cols(spark.range(1), ["id", "x"]).columns == ["id"]


@pytest.fixture(scope="module")
def enr(spark):
    """Three pathways as in the demonstration, with a tie added."""
    t = ("c", "d", 5.0)
    return spark.createDataFrame(
        [(*t, "MAPK signaling", -2.5, 0.001), (*t, "Cell cycle", -1.8, 0.01), (*t, "Apoptosis", 1.2, 0.03), (*t, "Autophagy", 1.2, 0.2), (*t, "Null", None, None)],
        ENR,
    )


def names(df, order="rank"):
    return [r.pathway for r in df.orderBy(order).collect()]


def test_rankings(enr):
    assert names(W.significant_pathways(enr, 0.05)) == ["MAPK signaling", "Cell cycle", "Apoptosis"]
    assert names(W.top_activated(enr, 1)) == ["Apoptosis"]
    assert names(W.top_repressed(enr, 5)) == ["MAPK signaling", "Cell cycle"]
    sides = W.sig_top_bottom(enr, 0.25, 1)
    assert {(r.side, r.pathway) for r in sides.collect()} == {("up", "Apoptosis"), ("down", "MAPK signaling")}


def test_partial_lookup_prefers_unique_exact_name(spark):
    rows = [("c", "d", 5.0, p, 1.0, 0.1) for p in ("Apoptosis", "apoptosis late", "Zeta", "zeta")]
    enr = spark.createDataFrame(rows, ENR)
    assert W.pathway_partial(enr, "APOPTOSIS").first().pathway == "Apoptosis"
    assert W.pathway_partial(enr, "late").first().pathway == "apoptosis late"
    # Two exact names: the first match by name.
    assert W.pathway_partial(enr, "zeta").first().pathway == "Zeta"
    assert W.pathway_partial(enr, "none").count() == 0


def test_exact_lookup_by_table(spark, enr):
    wanted = spark.createDataFrame([("Apoptosis",), ("Missing",)], "pathway string")
    assert [r.pathway for r in W.pathway_exact(enr, wanted).collect()] == ["Apoptosis"]


CELLS = (
    "cell_name string, Organ string, Driver_Gene_Symbol string, Driver_ProtEffect_or_CdnaEffect string, Driver_VarType string, "
    "Driver_VarZyg string, Driver_Mech_InferDM string, Driver_GeneType_DM string, ord int"
)


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(
        [
            ("SW620", "bowel", "TP53", "p.R273H", "Missense", "Hom", "LoF", "Suppressor", 2),
            ("SW620", "bowel", "KRAS", "p.G12V", "Missense", "Hom", "GoF", "Oncogene", 1),
            ("HT29", None, None, None, None, None, None, None, 3),
            ("HT29", "colon", "BRAF", None, "Missense", None, None, "Oncogene", 4),
            ("Empty", "skin", None, None, None, None, None, None, 5),
        ],
        CELLS,
    )


def test_nested_cell_lines(cells):
    nested = {r.cell_line: r for r in R.mutation_arrays(R.nest_cell_lines(cells, "ord"), "KRAS").collect()}
    assert [m.gene_symbol for m in nested["SW620"].driver_mutations] == ["KRAS", "TP53"]
    assert nested["SW620"].has_mutation and not nested["HT29"].has_mutation
    assert [m.gene_symbol for m in nested["SW620"].tumor_suppressors] == ["TP53"]
    # The organ is the first row's, even when it is null.
    assert nested["HT29"].organ is None and len(nested["HT29"].driver_mutations) == 1
    assert nested["Empty"].driver_mutations == []


def test_cell_line_report(cells):
    text = {r.cell_line: r.report for r in R.cell_line_report(R.nest_cell_lines(cells, "ord")).collect()}
    assert text["SW620"].split("\n") == [
        "# SW620", "- Organ/tissue: bowel", "- Driver mutations (2):",
        "  - KRAS (p.G12V): Missense [GoF] (Oncogene)", "  - TP53 (p.R273H): Missense [LoF] (Suppressor)",
    ]
    assert text["Empty"].endswith("(no annotated driver mutations)")


def test_mutation_status(spark, cells):
    asked = spark.createDataFrame([("sw620",), ("HT29",), ("Caco2",)], "requested string")
    got = {r.requested: r.status for r in R.mutation_status(asked, cells, "KRAS", "ord").collect()}
    assert got == {"sw620": "p.G12V", "HT29": "wildtype", "Caco2": "NOT FOUND"}


def test_first_per_cell_line_takes_first_non_null(cells):
    got = {r.cell_name: r for r in J.first_per_cell_line(cells, "ord", ["Organ", "Driver_Gene_Symbol"]).collect()}
    assert got["HT29"].Organ == "colon" and got["HT29"].Driver_Gene_Symbol == "BRAF"
    assert got["SW620"].Driver_Gene_Symbol == "KRAS"


def test_fanout_multiplies_scores(spark, cells):
    scores = spark.createDataFrame([("d", "SW620", 1.0), ("d", "unknown", 2.0)], "drug string, cell_line string, s double")
    assert J.join_cell_meta_fanout(scores, cells).count() == 3
    assert J.join_cell_meta_first(scores, cells, "ord").count() == 2


DRUGS = (
    "drug string, targets string, `moa-broad` string, `moa-fine` string, `human-approved` string, `clinical-trials` string, "
    "canonical_smiles string, pubchem_cid double, ord int"
)


def test_parse_drugs_and_report(spark):
    raw = spark.createDataFrame(
        [
            ("T", "None", "old", "old", None, None, None, None, 1),
            ("T", "MEK1, MEK2", "inhibitor", "MEK inhibitor", "YES", "no", None, 11707110.0, 2),
            ("U", "None", "unclear", "unclear", None, None, None, float("nan"), 3),
        ],
        DRUGS,
    )
    from doseframe.functions.frames import nan_to_null

    parsed = R.parse_drugs(nan_to_null(raw), "ord")
    got = {r.drug: r for r in parsed.collect()}
    assert got["T"].targets == ["MEK1", "MEK2"] and got["T"].human_approved and not got["T"].clinical_trials
    assert got["T"].pubchem_cid == 11707110
    assert got["U"].targets is None and got["U"].pubchem_cid is None and got["U"].human_approved is False
    report = {r.drug: r.report for r in R.drug_report(parsed).collect()}
    assert report["T"].split("\n") == [
        "# T", "- Mechanism (broad): inhibitor", "- Mechanism (fine): MEK inhibitor", "- Targets: MEK1, MEK2",
        "- Human approved: Yes", "- Clinical trials: No", "- PubChem CID: 11707110",
    ]
    assert "Targets: Unknown" in report["U"] and "PubChem" not in report["U"]


def test_heldout_guard_compares_dose_labels(spark):
    held = spark.createDataFrame([("D", 5.0, "C")], "drug string, concentration double, cell_line string")
    asked = spark.createDataFrame([(1, "D", 5.04, "C"), (2, "D", 5.2, "C"), (3, "D", 5.0, "X")], "n int, drug string, concentration double, cell_line string")
    assert {r.n: r.restricted for r in J.heldout_guard(asked, held).collect()} == {1: True, 2: False, 3: False}


def test_treatment_grid_counts_without_the_grid(spark):
    drugs = spark.createDataFrame([("a",), ("b",)], "drug string")
    lines = spark.createDataFrame([("x",), ("y",), ("y",)], "cell_line string")
    seen = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "elsewhere")], "drug string, cell_line string")
    grid = J.treatment_grid(seen, drugs, lines)
    assert {r.drug: (r.n_potential, r.n_present, r.n_missing, r.missing) for r in grid.collect()} == {
        "a": (2, 1, 1, ["y"]), "b": (2, 0, 2, ["x", "y"])
    }
    plan = grid._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_treatment_grid_over_several_words(spark):
    """200 lines, every third tested by one drug, all by another; null lines and no lines at all."""
    drugs = spark.createDataFrame([("third",), ("all",), ("none",)], "drug string")
    names = [f"line {i:03d}" for i in range(200)]
    lines = spark.createDataFrame([(n,) for n in names] + [(None,)], "cell_line string")
    seen = spark.createDataFrame([("third", n) for n in names[::3]] + [("all", n) for n in names] * 2 + [("all", None)], "drug string, cell_line string")
    got = {r.drug: r for r in J.treatment_grid(seen, drugs, lines).collect()}
    assert got["third"].missing == [n for i, n in enumerate(names) if i % 3] and got["third"].n_present == 67
    assert got["all"].missing == [] and got["none"].missing == names and got["all"].n_present == 200
    assert {r.n_potential for r in J.treatment_grid(seen, drugs, lines.limit(0)).collect()} == {0}


def test_names_are_found_by_their_rarest_stretch(spark):
    """Against plain containment, with short, long, empty, accented and absent requests."""
    rng = random.Random(2)
    names = ["".join(rng.choice("abcÄé-1 ") for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["Xy" * 5000, None]
    asked = ["", "a", "ab", "É", "bÄ", *[n[1:5].upper() for n in names[:30]], "xYx" , "yx" * 4000, "q" * 10_000, "abq", None]
    vocabulary = spark.createDataFrame([(n,) for n in names], "name string")
    got = S.substring_matches(spark.createDataFrame([(a,) for a in asked], "requested string"), vocabulary, "requested", "name")
    want = sorted((a, n) for a in asked for n in names if a is not None and n is not None and a.lower() in n.lower())
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_posting_index_grows_with_the_length_of_names(spark):
    long = spark.createDataFrame([("".join(chr(97 + i * i % 26) for i in range(10_000)),)], "name string")
    assert S.postings(long, "name").count() <= 3 * 10_000 + 1


def test_sets(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "v string")
    b = spark.createDataFrame([("y",), ("z",)], "v string")
    assert [r.v for r in U.intersect_names(a, b).collect()] == ["y"]
    assert tuple(U.intersection_counts(a, b).first()) == (2, 2, 1)
    files = spark.createDataFrame([(i,) for i in range(5)], "file_num int")
    done = files.where("file_num IN (1, 3)")
    assert {r.file_num for r in U.remaining_files(files, done).collect()} == {0, 2, 4}
    assert [r.id for r in U.sample_rows(spark.range(10), 2, [F.col("id").desc()]).collect()] == [9, 8]
