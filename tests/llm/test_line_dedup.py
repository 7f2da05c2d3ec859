import hashlib

from compare import actual, connect, differences, expected
from doseframe.llm.line_dedup import DIVISOR, MOST_LINES, dedup_lines
from doseframe.llm.oracles import ORACLES
from doseframe.llm.queries import QUERIES


def chunks(text):
    """(first line, last line) of the chunks of a text."""
    lines = (text or "").split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    out = []
    for i in range(len(lines) - 1):
        rolling = [(31 * a + b) % 65521 % DIVISOR for a, b in zip(hashes[i : i + MOST_LINES], hashes[i + 1 : i + MOST_LINES])]
        ends = [i + 1 + n for n, r in enumerate(rolling) if r != 1 and lines[i + 1 + n].strip(" ")]
        if rolling[0] != 0 and lines[i].strip(" ") and ends:
            out.append((i, ends[0]))
    return out


def brute(docs):
    def place(doc, text):
        return (doc is not None, doc or 0, hashlib.md5((text or "").encode()).hexdigest())

    first, out = {}, []
    for doc, text in docs:
        lines = (text or "").split("\n")
        for at, end in chunks(text):
            body = tuple(lines[at : end + 1])
            here = (*place(doc, text), at, end)
            first[body] = min(first.get(body, here), here)
    for doc, text in docs:
        lines, gone = (text or "").split("\n"), set()
        for at, end in chunks(text):
            *where, _, last = first[tuple(lines[at : end + 1])]
            if tuple(where) != place(doc, text) or at > last:
                gone |= set(range(at, end + 1))
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((doc, kept if gone else text, len(lines) if text else 0, len(gone)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in df.collect()), key=str)


def test_matches_brute_force(table):
    common = "\n".join(f"shared line {i}" for i in range(40))
    docs = [(i, f"own {i}\n{common}\nend {i}\n" + "\n".join(f"x{i} {j}" for j in range(i))) for i in range(20)]
    docs += [(50, common), (51, common + "\n" + common), (52, "one line"), (53, ""), (54, None), (55, "\n\n\n\n\n\n\n\n"), (None, common), (3, docs[3][1])]
    docs += [(60, "\n".join(f"long {i % 50}" for i in range(20_000)))]
    assert found(dedup_lines(table(docs))) == brute(docs)


def test_repeated_passages_are_found_in_other_text(table):
    """Runs of two and more lines between own lines: nearly all lines of later occurrences go, nothing else does."""
    docs, expected = [], 0
    for n in range(2, 8):
        for p in range(60):
            passage = [f"passage {n} {p} line {i}" for i in range(n)]
            for copy in range(2):
                own = [f"own {n} {p} {copy} {i}" for i in range(6)]
                docs.append((len(docs), "\n".join([*own[:3], *passage, *own[3:]])))
            expected += n
    rows = found(dedup_lines(table(docs)))
    kept = {line for _, text, _, _ in rows for line in text.split("\n")}
    assert kept == {line for _, text in docs for line in text.split("\n")}
    assert expected >= sum(lost for *_, lost in rows) >= 0.93 * expected


def test_blank_lines_alone_and_overlaps_are_no_repeats(table):
    docs = [(1, "a\n\n\n\nb"), (2, "c\n\n\n\nd"), (3, "x\n" * 3 + "x"), (4, "  \n  \n  ")]
    rows = found(dedup_lines(table(docs)))
    assert rows == brute(docs) and [lost for *_, lost in rows if lost] in ([], [2])


def test_ids_of_text_and_clashing_columns_keep_their_values(spark):
    docs = spark.createDataFrame([("a", "x1\nx2\nx3\nx4", 7, 8, 9), ("b", "x1\nx2\nx3\nx4", 4, 5, 6)], "doc_id string, text string, _id int, _key int, `_gone` int")
    out = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert [tuple(out[i])[2:5] for i in "ab"] == [(7, 8, 9), (4, 5, 6)]
    assert out["a"].n_removed == 0 and out["b"].n_removed >= 2


def test_no_rows_and_clashing_columns(table):
    assert found(dedup_lines(table([]))) == []
    docs = table([(1, "a\nb\nc")]).withColumnRenamed("lang", "N_Lines").withColumnRenamed("source", "_key2")
    assert dedup_lines(docs).columns == ["doc_id", "text", "_key2", "n_chars", "n_lines", "n_removed"]


def test_main_path_has_no_python(spark):
    plan = dedup_lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Cartesian" not in plan


def test_texts_are_shuffled_once_beside_the_chunks_that_stay(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dedup_lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
        out.collect()
        assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    name = "op10_line_dedup"
    assert differences(actual(QUERIES[name](spark, sf)), expected(connect(sf), ORACLES[name])) == []
