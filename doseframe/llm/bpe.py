"""BPE encoding and decoding through a table of distinct words.

Texts are split into words by the vocabulary's own rules. The distinct words of
a group of documents are packed by hash into ranges of the word table; in the
table every distinct word is encoded once, and the ids go back to each group in
the order in which it sent its words. There each document's ids are joined in by
position. Decoding joins every id with its piece, in a table as large as the
vocabulary file.

A group is a bounded share of the texts, dealt out by a hash of id and text, so no
word, source or group of copies gathers in one task. Words travel once per group
and without their counts.

Null counts as an empty text and gives no ids. Rows are encoded each, repeated
rows alike. Columns with the names of new ones are replaced. Ids equal those of
the tokenizers library for the same file without added special tokens; strings
of special tokens in a text become their ids, as there.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from doseframe.llm.common import partitions_for, quoted, raw_texts, slices, without

#: Bytes of text in one group of documents. A worker holds the words of one group at a time, some ten times that with their ids.
GROUP_BYTES = 2 << 20
#: Groups to a range of the word table, as most words repeat from group to group; and how many ranges a small corpus has.
GROUPS_A_RANGE = 16
LEAST_RANGES = 32
#: Characters below this have no combining forms, and lower-case alike in Python and in the library.
PLAIN_END = 0x250
BEYOND = re.compile(f"[{chr(PLAIN_END)}-{chr(sys.maxunicode)}]")
#: Words that are encoded at a time.
ENCODED = 4_000

FIELDS = [T.StructField("ids", T.BinaryType(), False), T.StructField("decoded", T.StringType(), False)]


def of_category(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN_END) if unicodedata.category(chr(c))[0] == kind)


def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


class Splitter:
    """Words of a text. Long-tail characters go through the library's own normalizer and splitter."""

    def __init__(self, path: str):
        self.path = path
        self.special = special_tokens(path)
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        letters, digits = of_category("L"), of_category("N")
        space = re.escape("\t\n\x0b\x0c\r \x85\xa0")
        self.plain = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+")
        table = pre_tokenizers.ByteLevel.alphabet()
        # The printable stand-ins of bytes, in the order in which the library gives them out.
        own = [b for b in range(256) if chr(b) in table and b not in (0x20, 0xA0, 0xAD) and (0x21 <= b <= 0x7E or b >= 0xA1)]
        rest = [b for b in range(256) if b not in set(own)]
        self.byte = {ord(chr(b)): b for b in own} | {256 + i: b for i, b in enumerate(rest)}

    @cached_property
    def full(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def segment(self, text: str) -> list[str]:
        lower = text.lower()
        if not BEYOND.search(text) and not BEYOND.search(lower):
            return self.plain.findall(lower)
        split = self.full.pre_tokenizer.pre_tokenize_str(self.full.normalizer.normalize_str(text))
        return [bytes(self.byte[ord(c)] for c in word).decode() for word, _ in split]

    def words(self, text: str) -> list[str]:
        """Words in order; a special token's string stands for itself."""
        if self.marks is None or "<|" not in text:
            return self.segment(text)
        out: list[str] = []
        for part in self.marks.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self.segment(part)
        return out


class Encoder:
    """Ids of single words: the vocabulary's merges alone, without normalizing or splitting again."""

    def __init__(self, path: str):
        self.special = special_tokens(path)
        self.single = Tokenizer(Tokenizer.from_file(path).model)
        self.single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def encode(self, words: list[str]) -> list[list[int]]:
        found = self.single.encode_batch(words, add_special_tokens=False)
        return [[self.special[w]] if w in self.special else e.ids for w, e in zip(words, found)]

    def encode_packed(self, words: list[str]) -> list[bytes]:
        """As 32-bit numbers, which take a fraction of the memory of lists."""
        return [np.array(ids, np.uint32).tobytes() for ids in self.encode(words)]


class Pieces:
    """The id-to-piece table."""

    def __init__(self, path: str):
        vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
        self.piece = [""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.piece[i] = piece

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.piece.__getitem__, ids))


# A worker keeps these from task to task.


@lru_cache(2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def squeezed(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def packed_words(words: list[str]) -> bytes:
    return squeezed("\n".join(words).encode())


def unpacked_words(block: bytes) -> list[str]:
    return zstandard.decompress(block).decode().split("\n")


def packed_ids(ids: list[bytes]) -> bytes:
    """The number of ids of each word, then all ids, as one block of 32-bit numbers."""
    counts = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
    return squeezed(b"".join([counts.tobytes(), *ids]))


def unpacked_ids(block: bytes, n: int) -> list[bytes]:
    data = zstandard.decompress(block)
    ends = (n + np.cumsum(np.frombuffer(data, np.uint32)[:n], dtype=np.int64)) * 4
    starts = np.concatenate([[n * 4], ends[:-1]]).tolist()
    return [data[a:b] for a, b in zip(starts, ends.tolist())]


def packed_rows(rows: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(rows)
    return out.getvalue().to_pybytes()


def unpacked_rows(block: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(block)))


def by_range(words: Iterable[str], ranges: int) -> list[list[str]]:
    """Distinct words dealt to ranges of the word table, each in sorted order, so that sender and table agree on it."""
    dealt: list[list[str]] = [[] for _ in range(ranges)]
    for w in words:
        dealt[crc32(w.encode()) % ranges].append(w)
    for each in dealt:
        each.sort()
    return dealt


def encode(docs: DataFrame, vocabulary: str, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit numbers) and ``decoded``.

    ``keys`` together with the text deal rows out into groups.
    """
    rest = without(docs, [f.name for f in FIELDS])
    columns = rest.columns
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    groups = partitions_for(docs, F.octet_length(raw), GROUP_BYTES)
    ranges = max(min(groups, LEAST_RANGES), -(-groups // GROUPS_A_RANGE))
    hashed = F.pmod(F.xxhash64(*[quoted(k) for k in keys], quoted(text)), F.lit(groups)).cast("int")
    dealt = rest.withColumn("_group", hashed)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one group travel as one compressed block."""
        for batch in slices(batches, text):
            group = np.array(batch.column("_group").to_pylist(), np.int32)
            order = np.argsort(group, kind="stable")
            rows = batch.select(columns)
            for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[part[:1]], pa.int32()), pa.array([packed_rows(rows.take(pa.array(part)))], pa.binary())],
                    names=["_group", "_rows"],
                )

    # The same exchange serves both readers below.
    located = dealt.mapInArrow(pack, "_group int, _rows binary").repartition(groups, "_group")

    def words_of(split: Splitter, block: bytes) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
        rows = unpacked_rows(block)
        for part in slices(iter([rows]), text):
            yield part, [split.words(raw.decode(errors="replace")) for raw in raw_texts(part.column(text))]

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(vocabulary)
        # Blocks are collected as they came, compressed, so that the words of one group at a time are held.
        blocks: dict[int, list[bytes]] = {}
        for batch in batches:
            for group, block in zip(batch.column("_group").to_pylist(), batch.column("_rows").to_pylist()):
                blocks.setdefault(group, []).append(block)
        for group in sorted(blocks):
            found: set[str] = set()
            for block in blocks.pop(group):
                for _, lists in words_of(split, block):
                    for words in lists:
                        found.update(words)
            sent = by_range(found, ranges)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group] * ranges, pa.int32()),
                    pa.array(range(ranges), pa.int32()),
                    pa.array([packed_words(w) for w in sent], pa.binary()),
                    pa.array([len(w) for w in sent], pa.int32()),
                ],
                names=["_group", "_range", "_words", "_n"],
            )

    sent = located.mapInArrow(distinct, "_group int, _range int, _words binary, _n int").where("_n > 0")

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range of the word table: every distinct word is encoded once."""
        encoder = encoder_of(vocabulary)
        # As with groups, the words of one range at a time.
        blocks: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for group, r, block in zip(*(batch.column(c).to_pylist() for c in ("_group", "_range", "_words"))):
                blocks.setdefault(r, []).append((group, block))
        for r in sorted(blocks):
            known: dict[str, bytes] = {}
            for group, block in blocks.pop(r):
                asked = unpacked_words(block)
                new = [w for w in asked if w not in known]
                for i in range(0, len(new), ENCODED):
                    part = new[i : i + ENCODED]
                    known.update(zip(part, encoder.encode_packed(part)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group], pa.int32()), pa.array([r], pa.int32()), pa.array([packed_ids([known[w] for w in asked])], pa.binary())],
                    names=["_group", "_range", "_ids"],
                )

    encoded = sent.repartition(ranges, "_range").mapInArrow(table, "_group int, _range int, _ids binary")
    names = [*columns, "ids", "decoded"]

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        """Documents of one group with the ids of its words, by position."""
        split, pieces = splitter(vocabulary), pieces_of(vocabulary)
        found: set[str] = set()
        for block in left.column("_rows"):
            for _, lists in words_of(split, block.as_py()):
                for words in lists:
                    found.update(words)
        order = by_range(found, ranges)
        ids_of: dict[str, bytes] = {}
        for r, block in zip(right.column("_range").to_pylist(), right.column("_ids")):
            ids_of.update(zip(order[r], unpacked_ids(block.as_py(), len(order[r]))))
        del order, found
        done = []
        for block in left.column("_rows"):
            for part, lists in words_of(split, block.as_py()):
                ids = [b"".join(map(ids_of.__getitem__, words)) for words in lists]
                decoded = [pieces.decode(np.frombuffer(each, np.uint32).tolist()) for each in ids]
                added = [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
                kept = [part.column(c) for c in columns]
                done.append(pa.RecordBatch.from_arrays([*kept, *added], names=names))
        return pa.Table.from_batches(done)

    schema = T.StructType([*[rest.schema[c] for c in columns], *FIELDS])
    return located.groupBy("_group").cogroup(encoded.groupBy("_group")).applyInArrow(join, schema)


def decode(ids: list[int], vocabulary: str) -> str:
    """One list of ids as text."""
    return pieces_of(vocabulary).decode(ids)
