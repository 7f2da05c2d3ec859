"""What several operators of this subpackage share.

``add_columns`` is the usual shape of an operator: rows keep their columns, a
function over Arrow batches adds new ones, and nothing is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one call of a row function gets at most, beside one row of any length.
SLICE_BYTES = 8 << 20

#: Bits of a filter, at most.
FILTER_BITS = 1 << 26

#: Bytes of letters and digits: a-z, 0-9 and every byte of a character beyond ASCII. All other bytes become blanks, A-Z become a-z.
ALNUM_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words_alnum(raw: bytes) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    return raw.translate(ALNUM_TABLE).split()


def words_blank(raw: bytes) -> list[bytes]:
    """Runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    return raw.split()


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null gives an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            n = n or 0
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without the columns that new ones of these names would clash with, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def set_aside(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with other names for columns that would clash with these, and what gives a result those of ``df`` again."""
    taken, used = {n.lower() for n in names}, {c.lower() for c in df.columns}
    moved: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in taken:
            name = f"given_{c}"
            while name.lower() in used | taken:
                name += "_"
            used.add(name.lower())
            moved[c] = name
    columns = [(moved.get(c, c), c) for c in df.columns]
    return df.withColumnsRenamed(moved), lambda out: out.select(*[quoted(now).alias(given) for now, given in columns])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def add_columns(
    df: DataFrame,
    text: str,
    fields: Sequence[T.StructField],
    function: Callable[[], Callable[[list[bytes], pa.RecordBatch], list]],
    drop: Sequence[str] = (),
    most: int = SLICE_BYTES,
) -> DataFrame:
    """Rows with added columns computed from the whole text of each row.

    ``function`` is called once per task and returns a function from texts and
    their batch to one list of values per field. Columns of ``df`` whose names
    clash with a new one are replaced; those in ``drop`` are left out. ``most`` is
    the bytes of text that the function gets at once.
    """
    names = [f.name for f in fields]
    taken = {n.lower() for n in [*names, *drop]}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    schema = T.StructType([*kept, *fields])
    keep = [f.name for f in kept]
    arrow = [pa_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values_of = function()
        for batch in slices(batches, text, most):
            columns = values_of(raw_texts(batch.column(text)), batch)
            arrays = [batch.column(c) for c in keep]
            arrays += [pa.array(v, type=t) for v, t in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return df.mapInArrow(run, schema)


def pa_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local session without it gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "/tmp/checkpoints"
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table below the shared folder and read again: the lineage ends there, whatever executor is lost."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Bits:
    """A filter of 64-bit hashes: those put in always pass, few others do."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __contains__(self, value: int) -> bool:
        at = value & (len(self.words) * 64 - 1)
        return bool(int(self.words[at >> 6]) >> (at & 63) & 1)

    def holds(self, values: np.ndarray) -> np.ndarray:
        at = values & np.uint64(len(self.words) * 64 - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def filter_of(rows: DataFrame, column: str) -> Bits:
    """Built by a combined aggregate; at most FILTER_BITS / 64 rows come to the driver."""
    n = rows.count()
    bits = min(FILTER_BITS, 1 << max(10, (16 * n - 1).bit_length()))
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    places = rows.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 AS int))").alias("b"))
    words = np.zeros(bits // 64, np.uint64)
    for r in places.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        words[r["w"]] = r["b"] & 0xFFFFFFFFFFFFFFFF
    return Bits(words)


def bucket5(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: 0 marks the held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def partitions_for(df: DataFrame, size: Column, bytes_each: int) -> int:
    """Enough partitions for ``bytes_each`` bytes each, and no fewer than the session's number."""
    total = df.agg(F.sum(size.cast("bigint")).alias("n")).first()["n"] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // bytes_each))
