"""Benchmark decontamination by a broadcast hash set of test n-grams.

A window is ``n`` consecutive words of a test item; an item of fewer words, but
not none, is one window. Windows are 64-bit hashes of word numbers in sorted
arrays that every task gets, with their places in the items' words; a document's
words are numbered with the same vocabulary. All words of a window are compared
before it counts as hit.

A set is broadcast only up to ``set_bytes`` bytes of item text. Larger
benchmarks are dealt into blocks of that size, and every document passes through
the blocks one after the other in the same stage; no shuffle is added.

Nulls, empty texts and texts of signs have no words: no hits, not contaminated,
and as items they have no window. Repeated rows are scored each; several texts
under one item id count as one item; the windows of an item without id count as
hits, but there is no id to list. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doseframe.llm.common import ALNUM_TABLE, add_columns, set_aside, words_alnum
from doseframe.llm.shingles import mixed

WINDOW = 13
SET_BYTES = 32 << 20
SPAN = T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)])
FIELDS = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("hit_spans", T.ArrayType(SPAN, False), False),
    T.StructField("hit_items", T.ArrayType(T.StringType(), False), False),
]


class WindowSet:
    """The windows of one block of items: by length, their hashes in order and their places in the items' word numbers."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.number: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        texts = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_alnum(text)], np.int32) for _, text in items]
        sizes = np.array([len(t) for t in texts], np.int64)
        self.words = np.concatenate([np.empty(0, np.int32), *texts])
        self.begins = np.cumsum(sizes) - sizes
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({min(n, k) for k in sizes.tolist() if k}):
            mine = np.flatnonzero(np.minimum(sizes, n) == size)
            places = np.concatenate([np.arange(self.begins[k], self.begins[k] + sizes[k] - size + 1, dtype=np.int32) for k in mine])
            hashes = window_hashes(self.words, size)[places]
            order = np.argsort(hashes, kind="stable")
            hashes, places = hashes[order], places[order]
            # A window that an item repeats counts once; places in order keep an item's together.
            again = hashes[1:] == hashes[:-1]
            again &= self.item_of(places[1:]) == self.item_of(places[:-1])
            for k in range(size):
                again &= self.words[places[1:] + k] == self.words[places[:-1] + k]
            keep = np.concatenate([[True], ~again])
            self.windows[size] = hashes[keep], places[keep]

    def item_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, places, side="right") - 1

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans, end exclusive, that windows cover, and the items they come from."""
        number = self.number.get
        ids = np.fromiter((number(w, 0) for w in words), np.int32, len(words))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for size, (hashes, places) in self.windows.items():
            if size > len(ids):
                continue
            # Only starts of windows without a foreign word can be in the set.
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(starts):
                continue
            asked = window_hashes(ids, size)[starts]
            low = np.searchsorted(hashes, asked)
            there = hashes[np.minimum(low, len(hashes) - 1)] == asked
            for i, h, at in zip(starts[there].tolist(), asked[there], low[there].tolist()):
                found = places[at : np.searchsorted(hashes, h, side="right")]
                # Hashes propose; all words are compared.
                for k in range(size):
                    found = found[self.words[found + k] == ids[i + k]]
                if len(found):
                    spans.append((i, i + size))
                    items.update(name for x in self.item_of(found).tolist() if (name := self.items[x]) is not None)
        return spans, items


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of the window of ``size`` word numbers from each word that begins one."""
    values = mixed(ids.astype(np.uint64))
    count = max(0, len(ids) - size + 1)
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + values[k : k + count]
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def cut_words(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the characters from the first to the last word of each span."""
    plain = raw.translate(ALNUM_TABLE)
    bounds = np.flatnonzero(np.diff(np.frombuffer(b" " + plain + b" ", np.uint8) != 0x20)).reshape(-1, 2)
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : bounds[start][0]])
        at = int(bounds[end - 1][1])
    return b"".join([*out, raw[at:]])


def item_blocks(benchmark: DataFrame, item: str, text: str, set_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items dealt into blocks of about ``set_bytes`` bytes; one block is on the driver at a time."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.encode(F.col(text), "UTF-8").alias("text"))
    rows = rows.where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-size // set_bytes)
    for b in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield [(r["item"], bytes(r["text"])) for r in mine.collect()]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    n: int = WINDOW,
    set_bytes: int = SET_BYTES,
) -> DataFrame:
    """``docs`` with n_words, hit_spans (word positions, merged, end exclusive) and hit_items (sorted as strings)."""
    sc = docs.sparkSession.sparkContext

    def numbered(values: Callable[[], object], first: bool):
        def start():
            block = values()

            def run(raws: list[bytes], batch: pa.RecordBatch) -> list:
                before = None if first else (batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist())
                counts, spans, items = [], [], []
                for i, raw in enumerate(raws):
                    words = words_alnum(raw)
                    new, names = block.hits(words) if block else ([], set())
                    if before:
                        new = [*new, *((s["start"], s["end"]) for s in before[0][i])]
                        names = {*names, *before[1][i]}
                    counts.append(len(words))
                    spans.append([{"start": s, "end": e} for s, e in merged(new)])
                    items.append(sorted(names))
                return [counts, spans, items]

            return run

        return start

    found, first = docs, True
    for items in item_blocks(benchmark, item, item_text, set_bytes):
        held = sc.broadcast(WindowSet(items, n))
        found = add_columns(found, text, FIELDS, numbered(lambda held=held: held.value, first))
        first = False
    return add_columns(docs, text, FIELDS, numbered(lambda: None, True)) if first else found


def n_hit(spans: Column | str = "hit_spans") -> Column:
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])


def contaminated(hit: Column, words: Column) -> Column:
    """At least a twentieth of a document's words are hit."""
    return (hit > 0) & (20 * hit >= words)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    own, given = set_aside(docs, [f.name for f in FIELDS])
    found = find_contamination(own, benchmark, **options)
    return given(found.where(~contaminated(n_hit(), F.col("n_words"))))


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """All documents, without the hit words in their texts; a null text stays null."""

    def start():
        def run(raws: list[bytes], batch: pa.RecordBatch) -> list:
            spans = batch.column("hit_spans").to_pylist()
            given = batch.column(text).is_valid().to_pylist()
            return [
                [
                    cut_words(raw, [(s["start"], s["end"]) for s in each]).decode(errors="replace") if ok else None
                    for raw, each, ok in zip(raws, spans, given)
                ]
            ]

        return run

    own, given = set_aside(docs, [f.name for f in FIELDS])
    found = find_contamination(own, benchmark, text=text, **options)
    return given(add_columns(found, text, [T.StructField(text, T.StringType())], start))
