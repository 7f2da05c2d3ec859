"""Document fingerprints by order MinHash.

A text's k-mers of code points are numbered by occurrence, so a repeated k-mer
counts as several. For each of ``SKETCHES`` hash functions the ``TUPLE`` k-mers with
the smallest hashes are selected and put back into text order, and the hash of
this tuple is one entry of the signature. Two texts agree in an entry if the
same k-mers are selected and stand in the same order, so the share of equal
entries falls with edit distance, not only with the loss of k-mers.

Null counts as an empty text. Bytes that are not UTF-8 count as replacement characters. Texts shorter than a k-mer are one k-mer; the empty
text has a signature of its own. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from doseframe.llm.common import add_columns, partitions_for, raw_texts, slices, stored

K = 6
TUPLE = 2
SKETCHES = 32
#: Ranks that are held at a time, so that they stay in cache.
RANKED = 1 << 16
#: Bytes of text in a partition of the ordered table.
PARTITION_BYTES = 16 << 20

_seeds = np.random.default_rng(20).integers(1, 1 << 32, SKETCHES, np.uint64).astype(np.uint32) | np.uint32(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; its input is overwritten."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return x


def numbered_kmers(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every k-mer together with the number of its occurrence, in text order."""
    n = len(codes) - K + 1
    if n < 1:
        codes, n = np.concatenate([codes, np.full(K - len(codes), 0x110000, np.uint32)]), 1
    kmers = np.zeros(n, np.uint64)
    for i in range(K):
        kmers *= np.uint64(0x9E3779B97F4A7C15)
        kmers += codes[i : i + n]
    kmers = mixed(kmers)
    # Hash and place in one word sort equal k-mers together in text order; a long text leaves fewer bits to the hash.
    width = np.uint64(max(n - 1, 1).bit_length())
    packed = np.sort((kmers >> width << width) | np.arange(n, dtype=np.uint64))
    place = (packed & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
    head = packed >> width
    fresh = np.concatenate([[True], head[1:] != head[:-1]])
    begin = np.flatnonzero(fresh)
    nth = np.arange(n) - np.repeat(begin, np.diff(np.concatenate([begin, [n]])))
    again = nth > 0
    # First occurrences keep their hash, so only the repeated ones are mixed again.
    kmers[place[again]] = mixed(kmers[place[again]] + nth[again].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return kmers


def selected(kmers: np.ndarray) -> np.ndarray:
    """For each hash function the places of its smallest k-mers, in text order."""
    low, high = kmers.astype(np.uint32), (kmers >> np.uint64(32)).astype(np.uint32)
    size = min(TUPLE, len(kmers))
    step = max(1, min(SKETCHES, RANKED // len(kmers)))
    out = np.empty((SKETCHES, size), np.int64)
    for j in range(0, SKETCHES, step):
        seeds = _seeds[j : j + step, None]
        ranks = low ^ seeds
        ranks *= seeds
        ranks ^= high
        row = np.arange(len(seeds))
        for i in range(size):
            out[j : j + step, i] = at = ranks.argmin(axis=1)
            ranks[row, at] = 0xFFFFFFFF
    return np.sort(out, axis=1)


def signature(text: str) -> np.ndarray:
    kmers = numbered_kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    places = selected(kmers)
    out = np.arange(1, SKETCHES + 1, dtype=np.uint64)
    for i in range(places.shape[1]):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + kmers[places[:, i]])
    return out.astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_hex(sign: np.ndarray) -> str:
    return sign.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third replaced by as many characters from the start of ``following``, or by all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprints(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with the fingerprint of each text."""

    def start():
        return lambda raws, batch: [[as_hex(signature(raw.decode(errors="replace"))) for raw in raws]]

    return add_columns(docs, text, [T.StructField("fingerprint", T.StringType(), False)], start)


RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
SCHEMA = f"part int, edge string, text string, {RESULT}"
NAMES = ["part", "edge", "text", *[f.split()[0] for f in RESULT.split(", ")]]
KINDS = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]


def compared(doc_id: int | None, text: str, sign: np.ndarray, following: str, next_sign: np.ndarray) -> dict:
    changed = edited(text, following)
    changed_sign = signature(changed)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
        "fingerprint": as_hex(sign), "edited_fingerprint": as_hex(changed_sign),
        "near_edited": likeness(sign, changed_sign), "near_next": likeness(sign, next_sign),
    }


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(NAMES, KINDS)], names=NAMES)


def near_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text against itself with its last third replaced from the next document, and against that document.

    Documents follow each other by descending id (nulls last, ties by text); the
    first follows the last. The table is cut into ranges of that order once;
    inside a range each row meets its follower as rows pass by. A range's first
    and last rows are kept aside and matched over the list of ranges, whose length is
    the number of partitions.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = partitions_for(rows, F.octet_length("text"), PARTITION_BYTES)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in slices(batches, "text"):
            out = []
            ids, numbers = batch.column("doc_id").to_pylist(), batch.column("part").to_pylist()
            for key, part, raw in zip(ids, numbers, raw_texts(batch.column("text"))):
                body = raw.decode(errors="replace")
                sign = signature(body)
                if last is None:
                    out.append({"part": part, "edge": "first", "text": body, "fingerprint": as_hex(sign)})
                else:
                    out.append(compared(last[0], last[1], last[2], body, sign))
                last = (key, body, sign, part)
            yield batch_of(out)
        if last is not None:
            yield batch_of([{"part": last[3], "edge": "last", "text": last[1], "doc_id": last[0], "fingerprint": as_hex(last[2])}])

    done = stored(ranged.mapInArrow(run, SCHEMA), "order-minhash")
    # One short row per partition of the table.
    heads = done.where("edge = 'first'").select("part")
    turn = Window.partitionBy().orderBy("part")
    links = heads.select(
        F.col("part").alias("part"), F.coalesce(F.lead("part").over(turn), F.min("part").over(Window.partitionBy())).alias("next_part")
    )
    firsts = done.where("edge = 'first'").select(
        F.col("part").alias("next_part"), F.col("text").alias("following"), F.col("fingerprint").alias("next_sign")
    )
    lasts = done.where("edge = 'last'").select("part", "doc_id", "text", "fingerprint").join(links, "part").join(firsts, "next_part")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                signs = [np.frombuffer(bytes.fromhex(r[c]), ">u4").astype(np.uint32) for c in ("fingerprint", "next_sign")]
                out.append(compared(r["doc_id"], r["text"], signs[0], r["following"], signs[1]))
            if out:
                yield pa.RecordBatch.from_arrays(batch_of(out).columns[3:], names=NAMES[3:])

    closing = lasts.select("doc_id", "text", "fingerprint", "following", "next_sign").mapInArrow(finish, RESULT)
    return done.where("edge IS NULL").select(*NAMES[3:]).unionByName(closing)
