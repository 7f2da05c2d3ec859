"""Substring dedup with repeated-phrase automata.

A window is ``window`` consecutive words of one document. Every word that lies in a
window whose word sequence also starts anywhere else is removed; windows are
judged on the input.

1. Anchors. Of the runs of ``ANCHOR`` words in a window the one with the least hash
   is the window's anchor, so equal windows have equal anchors, about one in a
   dozen words. Neighbouring windows with the same anchor form a stretch. Every
   document sends its stretches as hashes: anchor, stretch, place.
2. Confirmation. A stretch that occurs twice repeats as a whole. Where an anchor
   occurs in several different stretches, these are split into their windows, one
   copy of each stretch, and windows are counted by two 64-bit hashes. Both counts
   combine before they are shuffled, so a passage in a third of all documents is a
   few rows, and its windows are spread over all tasks.
3. Automata. Texts are dealt into shards. A shard gets the hashes of the confirmed
   phrases that occur in it: stretches that repeat as a whole, and single windows of
   split ones. It reads the words of each phrase from one text of its own,
   compiles the phrases into an Aho-Corasick automaton over word numbers, and
   streams all its texts through it. Every occurrence of a phrase, wherever it
   stands, marks its words; word numbers are exact, so marking compares words and
   not hashes.

Tables of anchors and stretches that occur once would be as large as the corpus;
a bounded filter, built from the anchors (later: stretches) that go on, spares most
of them the shuffle. It only ever lets too much pass, never too little.

Words are runs between blanks, unchanged. Null and empty texts have no words and
lose none; a kept text joins words by one blank. Repeated rows count as
occurrences each and lose the same words. A shard is bounded by its share of
the texts; rows with equal id and text lie together but hold their text once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doseframe.llm.common import filter_of, partitions_for, quoted, raw_texts, slices, stored, without, words_blank
from doseframe.llm.shingles import blank_word_hashes, least_of, member, mixed, rolled, signed

WINDOW = 35
ANCHOR = 12
#: Bytes of text in one shard.
SHARD_BYTES = 3 << 20

FIELDS = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("n_removed", T.LongType(), False),
    T.StructField("kept", T.StringType(), False),
]


class Stretches:
    """The stretches of several texts, and the hashes of all their windows.

    ``anchor`` and ``stretch`` are hashes, ``first`` and ``number`` a stretch's windows,
    ``text`` its text; windows are numbered by their first word, over all texts.
    """

    def __init__(self, raws: list[bytes], window: int):
        hashes, self.counts = blank_word_hashes(raws)
        span = window - min(ANCHOR, window) + 1
        ends = np.cumsum(self.counts)
        room = np.repeat(ends, self.counts) - np.arange(len(hashes))
        self.windows = np.flatnonzero(room >= window)
        self.hashes = rolled(hashes, window, seed=1)
        if not len(self.windows):
            self.anchor = self.stretch = np.empty(0, np.uint64)
            self.first = self.number = self.text = np.empty(0, np.int64)
            return
        runs = rolled(hashes, min(ANCHOR, window))
        # Hash and place in one number: the least is the run with the least hash, of equal ones the last.
        bits = np.uint64(max(len(runs), 2).bit_length())
        place = (np.uint64(1) << bits) - np.uint64(1)
        packed = (runs >> bits << bits) | (place - np.arange(len(runs), dtype=np.uint64))
        own = (place - (least_of(packed, span)[self.windows] & place)).astype(np.int64)
        begin = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        self.number = np.diff(np.concatenate([begin, [len(own)]]))
        self.first = self.windows[begin]
        self.anchor = runs[own[begin]]
        # A stretch is told by its windows in their order and by the place of the anchor.
        wide = mixed(self.hashes[self.windows])
        step = mixed((np.arange(len(own)) - np.repeat(begin, self.number)).astype(np.uint64))
        content = np.add.reduceat(wide * (step | np.uint64(1)), begin)
        self.stretch = mixed(content + mixed((self.number * 64 + own[begin] - self.first).astype(np.uint64)))
        self.text = np.searchsorted(ends, self.first, "right")


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in a span; ends exclusive."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def compiled(phrases: list[tuple[int, ...]]) -> ahocorasick.Automaton:
    """An automaton over word numbers whose values are the phrases' lengths."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for phrase in phrases:
        automaton.add_word(phrase, len(phrase))
    automaton.make_automaton()
    return automaton


def witnessed(words: list[bytes], found: Stretches, solid: np.ndarray, single: np.ndarray, window: int) -> Iterator[list[bytes]]:
    """The words of every confirmed phrase, from the first place of the shard that has it."""
    there = np.flatnonzero(member(found.stretch, solid))
    for i in there[np.unique(found.stretch[there], return_index=True)[1]].tolist():
        yield words[found.first[i] : found.first[i] + found.number[i] + window - 1]
    places = found.windows[member(found.hashes[found.windows], single)]
    for i in places[np.unique(found.hashes[places], return_index=True)[1]].tolist():
        yield words[i : i + window]


def without_phrases(texts: list[bytes], solid: np.ndarray, single: np.ndarray, window: int) -> list[tuple[int, int, bytes]]:
    """For each text of a shard: its words, the words lost, and what is kept."""
    found = Stretches(texts, window)
    words = words_blank(b" ".join(texts))
    number: dict[bytes, int] = {}
    phrases = [tuple(number.setdefault(w, len(number) + 1) for w in p) for p in witnessed(words, found, solid, single, window)]
    automaton = compiled(phrases) if phrases else None
    del phrases
    ids = np.fromiter(map(number.get, words, repeat(0)), np.int64, len(words))
    out, at = [], 0
    for n in found.counts.tolist():
        mine, gone = words[at : at + n], None
        for start, end in known_runs(ids[at : at + n], window) if automaton is not None else ():
            hits = np.array([(last + 1 - size, last + 1) for last, size in automaton.iter(tuple(ids[at + start : at + end].tolist()))], np.int64)
            if len(hits):
                gone = np.zeros(n, bool) if gone is None else gone
                gone[start:end] |= covered(end - start, hits[:, 0], hits[:, 1])
        at += n
        if gone is None:
            out.append((n, 0, b" ".join(mine)))
        else:
            out.append((n, int(gone.sum()), b" ".join([mine[i] for i in np.flatnonzero(~gone).tolist()])))
    return out


def known_runs(ids: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The stretches without a word that is in no phrase, if a phrase fits in; no occurrence lies elsewhere."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ids > 0, [False]])))
    return [(a, b) for a, b in edge.reshape(-1, 2).tolist() if b - a >= window]


def confirmed_phrases(slim: DataFrame, window: int) -> DataFrame:
    """(_shard, kind, hash) of the phrases that repeat, for every shard that holds one: kind 1 stretches, 2 windows."""
    context = slim.sparkSession.sparkContext

    def anchors_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            names, n = np.unique(Stretches(raw_texts(batch.column("_text")), window).anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(names)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    counted = slim.select("_text").mapInArrow(anchors_once, "anchor bigint, n bigint")
    again = stored(counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "phrase-anchors")
    repeated = context.broadcast(filter_of(again, "anchor"))

    def repeated_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = repeated.value
        for batch in slices(batches, "_text"):
            found = Stretches(raw_texts(batch.column("_text")), window)
            there = bits.holds(found.anchor)
            shard = np.array(batch.column("_shard").to_pylist(), np.int32)[found.text[there]]
            columns = (shard, signed(found.anchor[there]), signed(found.stretch[there]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_shard", "anchor", "stretch"])

    found = slim.mapInArrow(repeated_stretches, "_shard int, anchor bigint, stretch bigint")
    places = stored(found.groupBy("anchor", "stretch", "_shard").agg(F.count(F.lit(1)).alias("n")), "phrase-places")
    kinds = stored(places.groupBy("anchor", "stretch").agg(F.sum("n").alias("n")), "phrase-stretches")
    anchors = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"))
    # Where every stretch repeats as a whole, so does every window; an anchor with one stretch has nothing to compare.
    mixed_anchors = anchors.where("k > 1 AND least = 1").select("anchor")
    split = stored(kinds.join(mixed_anchors, "anchor").select("anchor", "stretch"), "phrase-split")
    to_split = context.broadcast(filter_of(split, "stretch"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = to_split.value, np.empty(0, np.uint64)
        for batch in slices(batches, "_text"):
            found = Stretches(raw_texts(batch.column("_text")), window)
            there = np.flatnonzero(bits.holds(found.stretch) & ~member(found.stretch, seen))
            chosen = there[np.unique(found.stretch[there], return_index=True)[1]]
            seen = np.union1d(seen, found.stretch[chosen])
            times = found.number[chosen]
            begin = np.cumsum(times) - times
            where = np.repeat(found.first[chosen] - begin, times) + np.arange(int(times.sum()))
            columns = (np.repeat(found.anchor[chosen], times), found.hashes[where], np.repeat(found.stretch[chosen], times))
            yield pa.RecordBatch.from_arrays([pa.array(signed(c)) for c in columns], names=["anchor", "w", "stretch"])

    shown = slim.select("_text").mapInArrow(windows, "anchor bigint, w bigint, stretch bigint")
    spans = shown.groupBy("anchor", "w").agg(F.min("stretch").alias("a"), F.max("stretch").alias("b"))
    common = spans.where("a <> b").select("anchor", "w")
    solid = places.join(kinds.where("n > 1").select("anchor", "stretch"), ["anchor", "stretch"])
    holders = places.join(mixed_anchors, "anchor").select("anchor", "_shard").distinct()
    return solid.select("_shard", F.lit(1).alias("kind"), F.col("stretch").alias("hash")).unionByName(
        common.join(holders, "anchor").select("_shard", F.lit(2).alias("kind"), F.col("w").alias("hash"))
    )


def remove_repeats(docs: DataFrame, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",), window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_removed and kept, the text without its repeated passages.

    ``keys`` together with the text deal rows out into shards.
    """
    rest = without(docs, [f.name for f in FIELDS])
    columns, types = rest.columns, {f.name: f.dataType for f in rest.schema.fields}
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    shards = partitions_for(docs, F.octet_length(raw), SHARD_BYTES)
    shard = F.pmod(F.xxhash64(*[quoted(k) for k in keys], quoted(text)), F.lit(shards)).cast("int")
    phrases = confirmed_phrases(rest.select(shard.alias("_shard"), raw.alias("_text")), window)

    # Rows and phrases of a shard go to the same task; a row's text travels once.
    slim = {f"_c{i}": quoted(c) for i, c in enumerate(columns) if c != text}
    rows = rest.select(shard.alias("_shard"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("hash"), raw.alias("_text"),
                       F.col(text).isNull().alias("_null"), *[c.alias(n) for n, c in slim.items()])
    facts = phrases.select("_shard", "kind", "hash", F.lit(None).cast("string").alias("_text"), F.lit(None).cast("boolean").alias("_null"),
                           *[F.lit(None).cast(types[c]).alias(f"_c{i}") for i, c in enumerate(columns) if c != text])
    names = [*columns, "n_words", "n_removed", "kept"]
    places = {c: f"_c{i}" for i, c in enumerate(columns)}

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, dict[bytes, int]] = {}
        held: dict[int, list[tuple[pa.RecordBatch, list[int]]]] = {}
        known: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            of, kind = np.array(batch.column("_shard").to_pylist(), np.int64), np.array(batch.column("kind").to_pylist(), np.int64)
            facts = np.flatnonzero(kind > 0)
            if len(facts):
                values = np.array(batch.column("hash").take(pa.array(facts)).to_pylist(), np.int64).view(np.uint64)
                for s, k in {*zip(of[facts].tolist(), kind[facts].tolist())}:
                    known.setdefault((s, k), []).append(values[(of[facts] == s) & (kind[facts] == k)])
            for s in np.unique(of[kind == 0]).tolist():
                part = batch.take(pa.array(np.flatnonzero((kind == 0) & (of == s))))
                mine = texts.setdefault(s, {})
                numbers = [mine.setdefault(t, len(mine)) for t in raw_texts(part.column("_text"))]
                held.setdefault(s, []).append((part.drop_columns(["_text", "hash", "kind", "_shard"]), numbers))
        none = [np.empty(0, np.uint64)]
        for s in sorted(held):
            bodies = list(texts.pop(s))
            solid, single = (np.unique(np.concatenate(known.pop((s, k), none))) for k in (1, 2))
            done = without_phrases(bodies, solid, single, window)
            for part, numbers in held.pop(s):
                new = {
                    "n_words": pa.array([done[i][0] for i in numbers], pa.int64()),
                    "n_removed": pa.array([done[i][1] for i in numbers], pa.int64()),
                    "kept": pa.array([done[i][2] for i in numbers], pa.binary()).view(pa.string()),
                    text: pa.array(
                        [None if null else bodies[i] for i, null in zip(numbers, part.column("_null").to_pylist())], pa.binary()
                    ).view(pa.string()),
                }
                yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(places[c]) for c in names], names=names)

    met = rows.unionByName(facts).repartition(shards, "_shard")
    return met.mapInArrow(locate, T.StructType([*rest.schema.fields, *FIELDS]))
