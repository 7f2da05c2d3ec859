"""Phrase mining against brute force and SQL."""

import random
import re
from collections import Counter

import pytest
from compare import actual, connect, differences, expected
from pyspark.sql import functions as F

from doseframe.llm import collocations as col
from doseframe.llm.oracles import ORACLES
from doseframe.llm.queries import QUERIES


def brute(rows, top, least):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_of = []
        for p, a in candidates.items():
            if any(100 * f3 >= 50 * a for q, f3 in candidates.items() if len(q) > len(p) and p in (q[:2], q[1:])):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows_of.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def random_rows(seed, n, words):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(n):
        picked = rng.choices(words, weights, k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for w in picked)
        rows.append((rng.choice(["en", "en", "de", None, ""]), text + (" New York City" * rng.randint(0, 2))))
    return rows


@pytest.mark.parametrize("top,least", [(1, 2), (7, 2), (40, 3), (5000, 2)])
def test_matches_brute_force_whatever_the_number_of_waves(spark, top, least, monkeypatch):
    monkeypatch.setattr(col, "STEP", 1)
    monkeypatch.setattr(col, "GROWTH", 2)
    words = ["the", "of", "Ünder", "a", "new", "york", "x-1", "zoë", "it's", "b", "c", "d", "日本", "e", "f", "g"]
    rows = random_rows(top, 120, words) + [(None, None), ("en", ""), ("en", " . ,"), ("de", "one")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert found(col.mine_collocations(df, top=top, least=least)) == brute(rows, top, least)


def test_waves_leave_most_pairs_alone(spark, monkeypatch):
    """A settled language never grows the pairs below its threshold."""
    grown = []
    plain = col.grown_triples
    monkeypatch.setattr(col, "STEP", 1)
    monkeypatch.setattr(col, "grown_triples", lambda t, w, p, f, fresh, n: grown.append((fresh.count(), p.count())) or plain(t, w, p, f, fresh, n))
    rows = [("en", f"left{i} right{i}. " * 12) for i in range(30)] + [("en", f"w{i % 37} v{i % 41} ") for i in range(6000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(col.mine_collocations(df, top=3, least=2)) == brute(rows, 3, 2)
    assert len(grown) == 1 and grown[0][0] < grown[0][1] / 2


def test_hot_language_long_text_and_ties(spark):
    rows = [("en", "same words here " * 20_000), ("fr", "un deux. " * 10), ("fr", "trois quatre. " * 10), ("fr", "a b. " * 10)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = found(col.mine_collocations(df))
    assert [r for r in got if r[0] == "fr"] == [
        ("fr", 1, "a b", 10, 10, 10, 60, 1_000_000),
        ("fr", 2, "trois quatre", 10, 10, 10, 60, 1_000_000),
        ("fr", 3, "un deux", 10, 10, 10, 60, 1_000_000),
    ]
    assert got == brute(rows, 2000, 10)


def test_exact_beyond_64_bits(spark):
    big = 40_000_000_000
    phrases = spark.createDataFrame([(big, big + 7, big + 9)], "a bigint, x bigint, y bigint")
    row = col.scored(phrases, [(F.col("x"), F.col("y"))]).first()
    assert row["score"] == 1_000_000 * big * big // ((big + 7) * (big + 9))


def test_no_rows_clashing_columns_and_bytes(spark):
    assert found(col.mine_collocations(spark.createDataFrame([], "text string, lang string"))) == []
    rows = [("ab cd " * 10, 1, 5, 0.5)]
    df = spark.createDataFrame(rows, "text string, lang int, h int, score double").withColumn("phrase", F.lit("p"))
    assert [r[:3] for r in found(col.mine_collocations(df))] == [("1", 1, "ab cd")]
    bad = spark.sql("select 'en' lang, cast(repeat(cast(concat(x'61ff20', x'6220') as string), 1) as string) text from range(12)")
    got = col.mine_collocations(bad).select(F.hex(F.col("phrase").cast("binary")).alias("p"), "a").collect()
    assert [tuple(r) for r in got] == [("61FF2062", 12)]


def test_query_matches_sql(spark):
    sf, name = "/root/testdata/sf0.01", "op11_collocations"
    assert differences(actual(QUERIES[name](spark, sf)), expected(connect(sf), ORACLES[name])) == []
