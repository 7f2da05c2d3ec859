import json

import pytest
from pyspark.sql import functions as F

from literals import rows_table
from doseframe.operators import aggregates as A
from doseframe.operators import joins as J
from doseframe.operators import sets as U
from doseframe.schema import DE_SCHEMA, ENRICHMENT_SCHEMA, INDEX_SCHEMA
from doseframe.session import scratch_path
from doseframe.sources import de as D
from doseframe.sources import metadata as M
from doseframe.sources import results as O
from doseframe.sources.snapshots import read_snapshot
from doseframe.streaming import jobs

NAN = float("nan")


def fact(gene, lfc, padj, drug, conc, line, file_num):
    return (gene, lfc, padj, 1.0, drug, conc, line, file_num)


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        fact("A", 1.0, NAN, "d1", 0.05, "c1", 0),
        fact("B", 2.0, 0.1, "d1", 0.05, "c1", 0),
        fact("A", 3.0, 0.2, "d2", 5.0, "c1", 1),
        fact("A", 4.0, 0.3, "d2", 5.0, "c2", 2),
        fact("A", 5.0, 0.3, "d2", 5.0, "c1", 2),
    ]
    return spark.createDataFrame(rows, D.T.StructType([*DE_SCHEMA.fields, D.T.StructField("file_num", D.T.IntegerType())]))


@pytest.fixture(scope="module")
def store(spark, facts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("de") / "facts")
    D.write_de(facts, path, 4)
    return path


@pytest.fixture(scope="module")
def named_store(spark, facts, tmp_path_factory):
    """Files numbered by their names alone."""
    path = str(tmp_path_factory.mktemp("named") / "facts")
    facts.repartitionById(4, F.col("file_num")).drop("file_num").write.parquet(path)
    return path


def scan_metric(df, name):
    """A number that the scan of ``df`` counts while the query runs."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "AdaptiveSparkPlan" in plan.nodeName() else plan
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        node = node.plan() if "QueryStage" in node.nodeName() else node
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply(name).value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("layout", ["store", "named_store"])
def test_scan_gives_file_numbers_and_null_for_nan(spark, layout, request):
    path = request.getfixturevalue(layout)
    got = {(r.gene_name, r.file_num, r.padj) for r in D.scan_de(spark, path).where("drug = 'd1'").collect()}
    assert got == {("A", 0, None), ("B", 0, 0.1)}


@pytest.mark.parametrize("layout", ["store", "named_store"])
def test_scan_one_file_opens_one_file(spark, layout, request):
    one = D.scan_de_file(spark, request.getfixturevalue(layout), 2)
    assert {r.cell_line for r in one.collect()} == {"c1", "c2"}
    # All rows of other files stay unread.
    assert scan_metric(one, "numOutputRows") == [2]


def test_files_are_chosen_while_the_query_runs(spark, store, facts):
    """Building the query runs nothing, and running it opens the files of the requested treatment only."""
    index = facts.select("cell_line", "drug", "concentration", "file_num")
    failing = index.withColumn("file_num", F.when(F.col("drug").isNotNull(), F.raise_error(F.lit("ran"))).cast("int"))
    J.indexed_fetch(spark, store, failing, failing.where("drug = 'd1'"))
    got = J.indexed_fetch(spark, store, index, index.where("drug = 'd1'"))
    # The scan of the facts is the only one of files.
    assert len(got.collect()) == 2 and scan_metric(got, "numFiles") == [1]
    assert scan_metric(J.indexed_fetch(spark, store, index, index.where("drug = 'd2'")), "numFiles") == [2]
    assert J.indexed_fetch(spark, store, index, index.where("drug = 'none'")).collect() == []


def test_one_gene_reads_a_fraction_of_the_pages(spark, tmp_path):
    """Three treatments of 20,000 genes: a gene costs one page of each, one that is nowhere nothing."""
    rows = spark.range(60_000).selectExpr(
        "concat('g', id % 20000) gene_name", "cast(id as double) log2FoldChange", "0.1D padj", "1D baseMean",
        "concat('d', id div 20000) drug", "5D concentration", "'c' cell_line", "0 file_num",
    )
    D.write_de(rows, str(tmp_path / "sorted"), 1)
    de = D.scan_de(spark, str(tmp_path / "sorted"))
    one = A.avg_lfc_by_treatment(de, gene="g777")
    assert {r.drug: r.mean_lfc for r in one.collect()} == {"d0": 777.0, "d1": 20777.0, "d2": 40777.0}
    assert scan_metric(de.where("gene_name = 'g777'"), "numOutputRows")[0] <= 3 * 2000
    # In an order that does not help, Bloom filters skip the row groups without the gene.
    D.write_de(rows.withColumn("gene_name", F.md5("gene_name")), str(tmp_path / "unsorted"), 1, order=("log2FoldChange",), row_group_bytes=1 << 16, page_rows=500)
    other = D.scan_de(spark, str(tmp_path / "unsorted"))
    assert scan_metric(other.where(F.col("gene_name") == F.md5(F.lit("g20001"))), "numOutputRows")[0] < 6000
    assert other.where(F.col("gene_name") == F.md5(F.lit("g5"))).count() == 3


def test_index_survives_a_failed_write(spark, store, tmp_path):
    path = str(tmp_path / "index")
    assert O.read_index(spark, path).collect() == []
    O.write_index(D.scan_de(spark, store).where("drug = 'd1'"), path)
    before = O.read_index(spark, path)
    bad = D.scan_de(spark, store).withColumn("file_num", F.when(F.col("cell_line") == "c2", F.raise_error(F.lit("lost"))).otherwise(F.col("file_num")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        O.write_index(bad, path)
    assert {r.drug for r in O.read_index(spark, path).collect()} == {"d1"}
    O.write_index(D.scan_de(spark, store), path)
    assert {r.drug for r in O.read_index(spark, path).collect()} == {"d1", "d2"}
    # Who had begun with the old version goes on with it, and it can be asked for.
    assert {r.drug for r in before.collect()} == {"d1"}
    assert {r.drug for r in read_snapshot(spark, path, INDEX_SCHEMA, version=1).collect()} == {"d1"}
    with pytest.raises(ValueError):
        read_snapshot(spark, path, INDEX_SCHEMA, version=9)


def test_rename_on_scan(spark, facts, tmp_path):
    path = str(tmp_path / "other")
    facts.drop("file_num").withColumnRenamed("cell_line", "line").write.parquet(path)
    schema = D.T.StructType([D.T.StructField("line" if f.name == "cell_line" else f.name, f.dataType) for f in DE_SCHEMA])
    assert "cell_line" in D.scan_de(spark, path, schema, {"line": "cell_line"}).columns


def test_filters_reach_the_reader(spark, store):
    from doseframe.operators.filters import fetch_de

    rows = fetch_de(D.scan_de(spark, store), drug="d1", concentration=0.05, cell_line="c1").select("gene_name")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    assert all(f in pushed for f in ("EqualTo(drug,d1)", "GreaterThan(concentration", "LessThan(concentration"))
    assert "padj" not in plan[plan.index("ReadSchema"):]


def test_a_file_without_a_number(spark, facts, tmp_path):
    path = tmp_path / "plain"
    facts.drop("file_num").coalesce(1).write.parquet(str(path))
    for file in path.glob("part-*.parquet"):
        file.rename(path / "facts.parquet")
    assert {r.file_num for r in D.scan_de(spark, str(path)).collect()} == {None}


@pytest.mark.parametrize("layout", ["store", "named_store"])
def test_indexed_fetch_from_the_stored_index(spark, layout, request, tmp_path):
    """All rows of treatments that are split over files, and no file that has none."""
    store = request.getfixturevalue(layout)
    O.write_index(D.scan_de(spark, store), str(tmp_path / "index"))
    index = O.read_index(spark, str(tmp_path / "index"))
    for where in ("drug = 'd1'", "drug = 'd2'", "cell_line = 'c2'", "drug = 'none'"):
        got = J.indexed_fetch(spark, store, index, index.where(where))
        want = D.scan_de(spark, store).where(where).select(*got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        named = {r.file_num for r in index.where(where).collect()}
        assert {r.file_num for r in got.collect()} <= named and len(named) < 3
    assert not U.remaining_files(D.scan_de(spark, store), index).collect()


def test_indexed_fetch_reads_small_doses(spark, store):
    index = D.scan_de(spark, store).select("cell_line", "drug", "concentration", "file_num").distinct()
    keys = rows_table(spark, D.T.StructType([DE_SCHEMA["cell_line"], DE_SCHEMA["drug"], DE_SCHEMA["concentration"]]), [("c1", "d1", 0.05), ("c2", "d2", 5.0)])
    got = J.indexed_fetch(spark, store, index, keys)
    assert sorted((r.gene_name, r.drug) for r in got.collect()) == [("A", "d1"), ("A", "d2"), ("B", "d1")]


def test_user_sql(spark, store):
    got = D.sql_over_de(spark, "SELECT drug, avg(log2FoldChange) AS m FROM {parquet} GROUP BY drug", D.scan_de(spark, store))
    assert {r.drug: r.m for r in got.collect()} == {"d1": 1.5, "d2": 4.0}


def test_signature_documents(spark, tmp_path):
    names = {"up": ["A", "B"], "down": ["C"]}
    (tmp_path / "s.json").write_text(json.dumps(names, indent=2))
    got = M.load_signatures(spark, str(tmp_path / "s.json"))
    assert {(r.signature, r.gene) for r in got.collect()} == {("up", "A"), ("up", "B"), ("down", "C")}


def test_csv_compounds(spark, tmp_path):
    (tmp_path / "c.csv").write_text('DRUG_ID,DRUG_NAME,TARGET,TARGET_PATHWAY\n1,"a, ""b""",T,P\n')
    assert tuple(M.scan_csv_compounds(spark, str(tmp_path / "c.csv")).first()) == (1, 'a, "b"', "T", "P")


def test_results_replace_only_their_treatments(spark, tmp_path):
    path = str(tmp_path / "enr")
    assert O.read_enrichment(spark, path).count() == 0
    row = lambda drug, conc, nes: ("P", nes, 0.1, 0.1, "A;B", "c/1", drug, conc)
    O.write_enrichment(spark.createDataFrame([row("a/b", 0.05, 1.0), row("a b", 0.05, 2.0), row("a/b", 0.1, 3.0)], ENRICHMENT_SCHEMA), path)
    O.write_enrichment(spark.createDataFrame([row("", 0.05, 4.0)], ENRICHMENT_SCHEMA), path)
    O.write_enrichment(spark.createDataFrame([row("a/b", 0.05, 9.0)], ENRICHMENT_SCHEMA), path)
    got = {(r.drug, r.concentration): r.nes for r in O.read_enrichment(spark, path).collect()}
    assert got == {("a/b", 0.05): 9.0, ("a b", 0.05): 2.0, ("a/b", 0.1): 3.0, ("", 0.05): 4.0}
    assert len(list((tmp_path / "enr").glob("cell_line=*"))) == 1


def test_index_keeps_all_files_and_gives_the_lowest(spark, facts, tmp_path):
    O.write_index(facts.select("cell_line", "drug", "concentration", "file_num"), str(tmp_path / "i"))
    stored = O.read_index(spark, str(tmp_path / "i"))
    want = {tuple(r) for r in facts.select("cell_line", "drug", "concentration", "file_num").collect()}
    assert {tuple(r) for r in stored.select("cell_line", "drug", "concentration", "file_num").collect()} == want
    got = {(r.cell_line, r.drug): r.file_num for r in A.treatment_index(stored).collect()}
    assert got == {("c1", "d1"): 0, ("c1", "d2"): 1, ("c2", "d2"): 2}


def test_scores_skip_null_padj(spark, facts):
    sig = spark.createDataFrame([("s", "A"), ("s", "B"), ("s", "A"), ("t", "Z")], "signature string, gene string")
    de = facts.withColumn("padj", F.nanvl("padj", F.lit(None)))
    got = A.signature_scores(de, sig).where("drug = 'd1'").first()
    assert (got.log2fc, got.padj, got.n_genes) == (1.5, 0.1, 2)
    wide = A.wide_scores(A.signature_scores(de, sig), ["s", "t"])
    assert {r.t_log2fc for r in wide.collect()} == {None} and "n_genes" in wide.columns


def test_scratch_is_fresh_and_below_the_named_folder(spark):
    a, b = scratch_path(spark, "x", "/shared/folder"), scratch_path(spark, "x", "/shared/folder")
    root = spark.conf.get("spark.checkpoint.dir", None)
    assert a != b and a.startswith((root or "/shared/folder").rstrip("/"))
    if not root:
        with pytest.raises(ValueError):
            scratch_path(spark, "x")


def test_streams_resume(spark, facts, tmp_path):
    source = str(tmp_path / "in")
    sig = spark.createDataFrame([("s", "A")], "signature string, gene string")
    stream = lambda: spark.readStream.schema(facts.schema).parquet(source)
    seen = []
    for part in (facts.where("file_num = 2"), facts.where("file_num < 2")):
        part.write.mode("append").parquet(source)
        jobs.stream_signature_filter(stream(), sig, str(tmp_path / "kept"), str(tmp_path / "kept-checkpoint"))
        jobs.stream_first_seen(stream(), str(tmp_path / "index"), str(tmp_path / "index-checkpoint"))
        index = jobs.read_first_seen(spark, str(tmp_path / "index"))
        seen.append({(r.cell_line, r.drug): r.file_num for r in index.collect()})
    jobs.compact_first_seen(spark, str(tmp_path / "index"), str(tmp_path / "compact"))
    assert jobs.read_first_seen(spark, str(tmp_path / "compact")).count() == len(seen[-1])
    # The second batch wrote the treatments it changed, not the whole index.
    assert spark.read.parquet(str(tmp_path / "index" / "batch=1")).count() == 2
    assert seen == [{("c1", "d2"): 2, ("c2", "d2"): 2}, {("c1", "d1"): 0, ("c1", "d2"): 1, ("c2", "d2"): 2}]
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 4
