"""Phrase collocation mining by best-first growth of phrases.

A phrase of two or three words is scored by how much more often it occurs than
its parts do. Counting all of them is what costs, so phrases grow from their
beginnings, and only beginnings that can still matter are grown:

* Words are counted, then pairs of words that are frequent enough themselves.
* The count of a pair bounds the score of all that it can grow to: a triple
  occurs no more often than its first pair, and its rest no less often than the
  triple, so its score is at most ``SCALE * f(pair) / f(first word)``.
* A language's frontier is taken best bound first, in waves. A wave has a
  threshold; it grows every pair whose bound reaches the threshold, and every
  pair that may grow to a triple which displaces a pair of such a score. Each
  wave counts its triples in one pass over the texts, and the triples of
  earlier waves are kept.
* A language is settled once ``top`` phrases that survive reach the threshold:
  nothing outside the frontier can score as much, ties included. Other languages
  go on with a lower threshold, at last with zero, which grows everything.

Texts are cut and counted in Arrow batches by array operations; batches give
one row per distinct phrase, Spark adds them up. Which words and pairs are
frequent, and which pairs are in the frontier, reaches the batches as filters of
at most 8 MB (``Bits``) that let a few others pass; joins drop those afterwards.
Every table that later waves read is stored in the shared folder.

Edge cases: a null text is empty, a null language is ``und``. Words are bytes
throughout, so texts that are not valid UTF-8 are counted like others and come
out as they went in. Languages with fewer survivors than ``top`` return all. No
rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doseframe.llm.common import Bits, filter_of, quoted, raw_texts, slices, stored

#: Fixed by the contract: counts below are no candidates, the score's factor, and the share of a longer candidate that displaces.
LEAST = 10
SCALE = 1_000_000
DISPLACED_PERCENT = 50
TOP = 2000

#: Scores are dealt into steps of this width when a threshold is chosen: at most SCALE / STEP + 1 rows per language.
STEP = 1000

#: The first wave's threshold is reached by this many times ``top`` pairs, each later one's by GROWTH times as many.
FIRST_WAVE = 2
GROWTH = 16

#: Rows of tables that are broadcast, at most: one row per language.
SMALL_ROWS = 100_000

#: Bytes of text counted at once, beside one row of any length.
COUNTED_BYTES = 4 << 20

#: Rows that go back to Spark at once.
ROWS = 1 << 15

#: Hash parts into which a language's phrases are dealt when they are ranked.
RANK_PARTS = 64

#: A-Z become a-z, tabs blanks, and every sign that ends a piece a line feed.
PIECE_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b == 0x09 else 0x0A if 0x0A <= b <= 0x0D or b in b".,;:!?" else b for b in range(256)
)

WORD_COLUMNS = ["w1", "w2", "w3"]


def words_of(raw: bytes) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of a text, and the number of the piece that each lies in."""
    codes = np.frombuffer(raw.translate(PIECE_TABLE), np.uint8)
    inside = (codes != 0x0A) & (codes != 0x20)
    edges = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts = np.flatnonzero(edges == 1)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(edges == -1) - starts, out=offsets[1:])
    body = codes[inside]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    return words, np.searchsorted(np.flatnonzero(codes == 0x0A), starts)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of 64-bit hashes."""
    x = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def counted_in(raw: bytes, lang: bytes, size: int, words: Bits | None, firsts: Bits | None) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """Distinct phrases of ``size`` words of a text: their words, hashes and counts.

    ``words`` passes words for pairs, and pairs for triples; ``firsts`` passes the pairs that triples may begin with.
    """
    found, piece = words_of(raw)
    coded = found.dictionary_encode()
    ids, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    seed = xxhash.xxh32_intdigest(lang)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in distinct.to_pylist()), np.uint64, len(distinct))
    if size == 1:
        return [distinct], hashes, np.bincount(ids, minlength=len(distinct))
    follows = piece[1:] == piece[:-1]
    if size == 2:
        passes = words.holds(hashes)[ids]
        follows = follows & passes[1:] & passes[:-1]
    at = np.flatnonzero(follows)
    codes = ids[at] * len(distinct) + ids[at + 1]
    if size == 2:
        # Where each pair stands matters only for triples, and costs memory.
        codes, counts = np.unique(codes, return_counts=True)
    else:
        codes, place = np.unique(codes, return_inverse=True)
    first, second = np.divmod(codes, max(len(distinct), 1))
    pairs = mixed(hashes[first], hashes[second])
    if size == 2:
        return [distinct.take(pa.array(first)), distinct.take(pa.array(second))], pairs, counts
    pair_at = np.full(len(ids) + 1, -1, np.int64)
    pair_at[at] = place
    good = np.append(words.holds(pairs), False)
    begins = np.append(firsts.holds(pairs), False) & good
    left, right = pair_at[:-1], pair_at[1:]
    at = np.flatnonzero(begins[left] & good[right])
    codes, counts = np.unique(left[at] * max(len(pairs), 1) + right[at], return_counts=True)
    left, right = np.divmod(codes, max(len(pairs), 1))
    words_at = [first[left], second[left], second[right]]
    return [distinct.take(pa.array(w)) for w in words_at], mixed(pairs[left], pairs[right]), counts


def phrase_counts(texts: DataFrame, size: int, words: Bits | None = None, firsts: Bits | None = None) -> DataFrame:
    """How often each phrase of ``size`` words occurs in each language: lang, w1.., hash ``h`` and count ``a``."""
    names = WORD_COLUMNS[:size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", COUNTED_BYTES):
            by_lang: dict[bytes, list[bytes]] = {}
            for lang, raw in zip(raw_texts(batch.column("lang")), raw_texts(batch.column("text"))):
                if raw:
                    by_lang.setdefault(lang, []).append(raw)
            for lang, raws in by_lang.items():
                columns, hashes, counts = counted_in(b"\n".join(raws), lang, size, words, firsts)
                arrays = [pa.array([lang], pa.binary()).take(pa.array(np.zeros(len(counts), np.int64)))]
                arrays += [c.cast(pa.binary()) for c in columns]
                arrays += [pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))]
                rows = pa.RecordBatch.from_arrays(arrays, names=["lang", *names, "h", "a"])
                for start in range(0, rows.num_rows, ROWS):
                    yield rows.slice(start, ROWS)

    schema = ", ".join(["lang binary", *[f"{n} binary" for n in names], "h bigint", "a bigint"])
    return texts.mapInArrow(run, schema).groupBy("lang", *names, "h").agg(F.sum("a").alias("a"))


def small(df: DataFrame) -> DataFrame:
    """A stored table of one row per language: broadcast if it is as small as that should be, joined as usual if not."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def scored(phrases: DataFrame, cuts: list[tuple[Column, Column]]) -> DataFrame:
    """The lowest-scoring cut of each phrase, the first of equals, with its parts' counts ``l`` and ``r``.

    Products have at most 38 digits for counts of up to 15, so the division is exact.
    """

    def wide(c: Column) -> Column:
        return c.cast("decimal(15,0)")

    a = wide(F.col("a"))
    upper = (a * a * F.lit(SCALE).cast("decimal(7,0)")).cast("decimal(38,0)")
    options = [
        F.struct(F.call_function("div", upper, (wide(l) * wide(r)).cast("decimal(38,0)")).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))
        for k, (l, r) in enumerate(cuts)
    ]
    cut = F.least(*options) if len(options) > 1 else options[0]
    return phrases.withColumn("cut", cut).select("*", "cut.score", "cut.l", "cut.r").drop("cut")


def part_counts(df: DataFrame, counts: DataFrame, by: dict[str, str], name: str) -> DataFrame:
    """``df`` with the count of a part: ``by`` names the part's columns in ``counts`` and in ``df``."""
    part = counts.select("lang", *[F.col(c).alias(mine) for c, mine in by.items()], F.col("a").alias(name))
    return df.join(part, ["lang", *by.values()])


def thresholds(pairs: DataFrame, langs: DataFrame, wanted: int) -> DataFrame:
    """Per language the step of the score that at least ``wanted`` pairs reach; zero if there are not so many."""
    steps = pairs.join(small(langs), "lang").groupBy("lang", F.floor(F.col("score") / STEP).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy(F.col("step").desc()))
    reached = steps.withColumn("upto", upto).groupBy("lang").agg(F.max(F.when(F.col("upto") >= wanted, F.col("step") * STEP)).alias("theta"))
    return reached.select("lang", F.coalesce("theta", F.lit(0)).cast("bigint").alias("theta"))


def frontier(pairs: DataFrame, theta: DataFrame) -> DataFrame:
    """Pairs that may grow to triples which reach the threshold, or which displace a pair that does."""
    open_pairs = pairs.join(small(theta), "lang")
    # The least count of a pair beginning with a word: triples that end in the pair grow from pairs ending in that word.
    displaced = open_pairs.where("score >= theta").groupBy("lang", F.col("w1").alias("w2")).agg(F.min("a").alias("least"))
    could_displace = F.coalesce(100 * F.col("a") >= DISPLACED_PERCENT * F.col("least"), F.lit(False))
    needed = (F.col("bound") >= F.col("theta")) | could_displace
    return open_pairs.join(displaced, ["lang", "w2"], "left").where(needed).select("lang", "w1", "w2", "h")


def survivors(pairs: DataFrame, triples: DataFrame | None, theta: DataFrame) -> DataFrame:
    """Phrases that reach their language's threshold and are not displaced by a triple."""
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    blank = F.lit(bytearray(b" "))
    kept = pairs.join(small(theta), "lang").where("score >= theta")
    if triples is None:
        return kept.withColumn("phrase", F.concat("w1", blank, "w2")).select(columns)
    heads = triples.select("lang", "w1", "w2", "a")
    tails = triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")
    longer = heads.unionByName(tails).groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    displaced = F.coalesce(100 * F.col("longer") >= DISPLACED_PERCENT * F.col("a"), F.lit(False))
    kept = kept.join(longer, ["lang", "w1", "w2"], "left").where(~displaced).withColumn("phrase", F.concat("w1", blank, "w2"))
    grown = triples.join(small(theta), "lang").where("score >= theta")
    return kept.select(columns).unionByName(grown.withColumn("phrase", F.concat("w1", blank, "w2", blank, "w3")).select(columns))


def grown_triples(texts: DataFrame, words: DataFrame, pairs: DataFrame, frequent_pairs: Bits, fresh: DataFrame, least: int) -> DataFrame:
    """Scored triples that begin with a pair of ``fresh``."""
    counted = phrase_counts(texts, 3, frequent_pairs, filter_of(fresh, "h")).where(F.col("a") >= least)
    triples = counted.drop("h").join(fresh.select("lang", "w1", "w2"), ["lang", "w1", "w2"], "left_semi")
    triples = part_counts(triples, pairs, {"w1": "w1", "w2": "w2"}, "f12")
    triples = part_counts(triples, pairs, {"w1": "w2", "w2": "w3"}, "f23")
    triples = part_counts(triples, words, {"w1": "w1"}, "f1")
    triples = part_counts(triples, words, {"w1": "w3"}, "f3")
    done = scored(triples, [(F.col("f1"), F.col("f23")), (F.col("f12"), F.col("f3"))])
    return stored(done.select("lang", *WORD_COLUMNS, "a", "l", "r", "score"), "collocation-triples")


def mine_collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, least: int = LEAST) -> DataFrame:
    """The ``top`` surviving phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    lang_bytes = F.coalesce(quoted(lang).cast("string"), F.lit("und")).cast("binary")
    texts = docs.select(lang_bytes.alias("lang"), quoted(text).cast("string").alias("text")).where(F.length("text") > 0)
    all_words = stored(phrase_counts(texts, 1), "collocation-words")
    totals = stored(all_words.groupBy("lang").agg(F.sum("a").alias("n")), "collocation-totals")
    words = all_words.where(F.col("a") >= least)
    counted = phrase_counts(texts, 2, filter_of(words, "h")).where(F.col("a") >= least)
    pairs = part_counts(part_counts(counted, words, {"w1": "w1"}, "f1"), words, {"w1": "w2"}, "f2")
    pairs = scored(pairs, [(F.col("f1"), F.col("f2"))]).withColumn("bound", F.expr(f"CAST(a AS decimal(15,0)) * {SCALE} div f1"))
    pairs = stored(pairs.select("lang", "w1", "w2", "h", "a", "l", "r", "score", "bound"), "collocation-pairs")
    frequent_pairs = filter_of(pairs, "h")

    open_langs, wanted = stored(pairs.select("lang").distinct(), "collocation-langs"), FIRST_WAVE * top
    waves: list[DataFrame] = []
    settled: list[DataFrame] = []
    expanded: list[DataFrame] = []
    while not open_langs.isEmpty():
        theta = stored(thresholds(pairs, open_langs, wanted), "collocation-thresholds")
        fresh = frontier(pairs, theta)
        for earlier in expanded:
            fresh = fresh.join(earlier, ["lang", "w1", "w2"], "left_anti")
        fresh = stored(fresh, "collocation-frontier")
        expanded.append(fresh.select("lang", "w1", "w2"))
        waves.append(grown_triples(texts, words, pairs, frequent_pairs, fresh, least))
        reached = survivors(pairs, reduce(DataFrame.unionByName, waves), theta).groupBy("lang").agg(F.count(F.lit(1)).alias("reached"))
        judged = theta.join(reached, "lang", "left").withColumn("done", (F.col("theta") == 0) | (F.coalesce("reached", F.lit(0)) >= top))
        judged = stored(judged, "collocation-judged")
        settled.append(judged.where("done").select("lang", "theta"))
        open_langs, wanted = judged.where(~F.col("done")).select("lang"), wanted * GROWTH

    theta = reduce(DataFrame.unionByName, settled, pairs.select("lang", F.lit(0).cast("bigint").alias("theta")).limit(0))
    theta = stored(theta, "collocation-settled")
    found = survivors(pairs, reduce(DataFrame.unionByName, waves) if waves else None, theta)
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    nearest = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    best = found.withColumn("part", part).withColumn("near", nearest).where(F.col("near") <= top).drop("part", "near")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(small(totals), "lang").select(
        F.col("lang").cast("string").alias("lang"), "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score"
    )
