"""Line dedup by content-defined chunks of lines, in DataFrame operations only.

A text is cut at line feeds. A rolling hash runs over the hashes of each two
neighbouring lines. A chunk opens at a line unless the hash of it and the next
hits one residue, and closes at the first later line unless the hash of it and
the line before hits another, after MOST_LINES lines at most (else there is no
chunk). Both lines at an end lie inside the chunk, so that its bounds do not
depend on what surrounds it: a passage gives the same chunks in any text. Chunks
begin and end with lines that are not blank (empty or spaces); they may overlap.

A chunk that occurs more than once in the whole table is removed but for its
first occurrence: lowest doc_id (null first), then lowest text hash, then place in
the text; what overlaps the first occurrence is no repeat. Lines of any removed
chunk go. Hashes only propose: a chunk goes only if its bytes equal those of the
occurrence that stays. The first occurrence of a line in the whole table always stays.

Texts of one line, empty and null texts stay as they are. A text that loses all its
lines becomes empty, its row stays. Rows that agree in doc_id and text share one
decision. Ids may be of any type with an order. Columns n_lines and n_removed are
replaced, all others stay.

Shuffled are: slim rows of hash and place; the texts once, by document; and those
chunks that occur again, by hash. Repeated hashes and the bodies that stay are combined
before their shuffle and stored; joins with them read exchanges on both sides, so that
adaptive execution can split a chunk that a third of all documents share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseframe.llm.common import quoted, stored, without

#: One pair of lines in so many does not open a chunk, and one does not close it.
DIVISOR = 16
MOST_LINES = 8
MULTIPLIER = 31


def line_hash(line: Column) -> Column:
    """28 bits of a line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row however often the body names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def chunk_body(lines: Column, at: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, at + 1, end - at + 1), "\n")


def chunks_of(lines: Column) -> Column:
    """The chunks of a text's lines: (at, end), the numbers from 0 of the first and last line."""

    def pair(one: Column, two: Column) -> Column:
        rolling = (one["hash"] * MULTIPLIER + two["hash"]) % 65521 % DIVISOR
        return F.struct((one["full"] & (rolling != 0)).alias("opens"), (two["full"] & (rolling != 1)).alias("closes"))

    def bounds(pairs: Column) -> Column:
        def chunk(p: Column, at: Column) -> Column:
            further = F.array_position(F.transform(F.slice(pairs, at + 2, MOST_LINES - 2), lambda q: q["closes"]), True).cast("int")
            end = F.when(p["closes"], at + 1).when(further > 0, at + 1 + further)
            return F.struct(at.alias("at"), F.when(p["opens"], end).alias("end"))

        return F.filter(F.transform(pairs, chunk), lambda c: c["end"].isNotNull())

    def pairs_of(hashed: Column) -> Column:
        n = F.size(hashed) - 1
        return F.zip_with(F.slice(hashed, F.lit(1), n), F.slice(hashed, F.lit(2), n), pair)

    hashed = F.transform(lines, lambda x: F.struct(line_hash(x).alias("hash"), (F.trim(x) != "").alias("full")))
    return let(let(hashed, pairs_of), bounds)


def hashed_chunks(text: Column) -> Column:
    """(at, end, hash) of the chunks of a text."""

    def hashed(lines: Column) -> Column:
        def one(c: Column) -> Column:
            return c.withField("hash", F.unhex(F.md5(chunk_body(lines, c["at"], c["end"]).cast("binary"))))

        return F.transform(chunks_of(lines), one)

    return let(lines_of(text), hashed)


def document(doc_id: str, key: str) -> Column:
    """Joins the documents "d" with places "w"."""
    return F.col(f"d.`{doc_id}`").eqNullSafe(F.col("w._id")) & (F.col(f"d.`{key}`") == F.col("w._key"))


def repeated_lines(keyed: DataFrame, doc_id: str, key: str, text: str) -> DataFrame:
    """(_id, _key, _gone): for each document the numbers of its lines in chunks that an earlier occurrence equals byte for byte."""
    chunks = keyed.select(quoted(doc_id).alias("_id"), F.col(key).alias("_key"), F.explode(hashed_chunks(quoted(text))).alias("_c"))
    chunks = chunks.select("_id", "_key", F.col("_c.at").alias("_at"), F.col("_c.end").alias("_end"), F.col("_c.hash").alias("_hash"))
    place = F.struct("_id", "_key", "_at", "_end")
    counts = chunks.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).where("_n > 1")
    counts = stored(counts.select("_hash", "_first"), "lines-repeated")
    first = F.col("_first")
    own = F.col("_id").eqNullSafe(first["_id"]) & (F.col("_key") == first["_key"])
    marked = chunks.join(counts, "_hash").withColumn("_stays", own & (F.col("_at") == first["_at"]))
    marked = marked.where(F.col("_stays") | ~own | (F.col("_at") > first["_end"]))
    # Places go to the documents and fetch the chunks there, so that only repeated ones are shuffled with their bytes.
    wanted = marked.groupBy("_id", "_key").agg(F.collect_set(F.struct("_at", "_end", "_hash", "_stays")).alias("_wanted"))
    wanted = stored(wanted, "lines-wanted")

    def fetched(lines: Column) -> Column:
        return F.transform("_wanted", lambda c: c.withField("_body", chunk_body(lines, c["_at"], c["_end"])))

    # Columns by their names and in their order, as the caller joins them: with none beside them both joins share an exchange.
    met = keyed.select(*[quoted(c) for c in keyed.columns if c in (doc_id, text, key)]).alias("d").join(wanted.alias("w"), document(doc_id, key))
    bodies = met.select("w._id", "w._key", F.explode(let(lines_of(F.col(f"d.`{text}`")), fetched)).alias("_c")).select("_id", "_key", "_c.*")
    kept = stored(bodies.where("_stays").groupBy("_hash").agg(F.max("_body").alias("_body")), "lines-kept")
    same = bodies.where("NOT _stays").join(kept, ["_hash", "_body"])
    return same.groupBy("_id", "_key").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("_at", "_end")))).alias("_gone"))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with new texts, n_lines, n_removed (lines)."""
    rest = without(docs, ["n_lines", "n_removed"])
    key = "_key"
    while key in {c.lower() for c in rest.columns}:
        key += "_"
    body = F.coalesce(quoted(text), F.lit(""))
    # Never null: else the inner join's check for it would keep that join from sharing the exchange.
    keyed = rest.withColumn(key, F.coalesce(F.unhex(F.md5(body.cast("binary"))), F.lit(b"")))
    gone = repeated_lines(keyed, doc_id, key, text)
    joined = keyed.alias("d").join(gone.alias("w"), document(doc_id, key), "left")

    def rest_of(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("w._gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    old = F.col(f"d.`{text}`")
    touched = F.col("w._gone").isNotNull()
    new = F.when(touched, let(lines_of(old), rest_of)).otherwise(old)
    whole = F.when(F.length(old) > 0, F.size(lines_of(old))).otherwise(0).cast("bigint")
    lost = F.when(touched, F.size("w._gone")).otherwise(0).cast("bigint")
    columns = [new.alias(text) if c == text else F.col("d.`" + c.replace("`", "``") + "`") for c in rest.columns]
    return joined.select(*columns, whole.alias("n_lines"), lost.alias("n_removed"))
