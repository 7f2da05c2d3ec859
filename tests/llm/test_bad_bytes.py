"""Texts that are not valid UTF-8: no operator fails, and good texts beside them keep their results."""

import pytest
from pyspark.sql import functions as F

from doseframe.llm import bpe, decontaminate, order_minhash, phrases, secrets
from doseframe.llm.queries import vocabulary

GOOD = "a plain text with password=abcdefgh1 in it"
BAD = bytes.fromhex("6162ff20c328") + b" token=abcdefgh1"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(1, bytearray(BAD)), (2, bytearray(GOOD.encode())), (3, None)], "doc_id long, raw binary")
    return rows.select("doc_id", F.col("raw").cast("string").alias("text"))


def results(frame, column):
    return {r.doc_id: r[column] for r in frame.select("doc_id", column).collect()}


def test_secrets(docs):
    base = results(secrets.find_secrets(docs), "base")
    replaced = BAD.decode(errors="replace")
    assert [(s.start, s.end) for s in base[1]] == [(replaced.index("token"), len(replaced))] and len(base[2]) == 1 and base[3] == []


def test_fingerprints(docs):
    found = results(order_minhash.fingerprints(docs), "fingerprint")
    assert len({*found.values()}) == 3


def test_bpe(docs):
    found = results(bpe.encode(docs, vocabulary()), "ids")
    same = docs.withColumn("text", F.lit(BAD.decode(errors="replace")))
    assert found[1] == results(bpe.encode(same, vocabulary()), "ids")[1] and found[3] == b""


def test_phrases_keep_the_bytes(docs):
    kept = phrases.remove_repeats(docs).select("doc_id", F.hex(F.col("text").cast("binary")).alias("t"), F.hex(F.col("kept").cast("binary")).alias("k"))
    found = {r.doc_id: (r.t, r.k) for r in kept.collect()}
    assert found[1] == (BAD.hex().upper(), BAD.hex().upper()) and found[3] == (None, "")


def test_decontamination(spark, docs):
    items = spark.createDataFrame([("q", GOOD)], "item_id string, text string")
    found = results(decontaminate.remove_spans(docs, items), "text")
    assert set(found) == {1, 2, 3} and "password" not in found[2]
