"""Mixing sources to target weights by entropy balancing.

Every source gets a target of words; the documents of a source are then taken
none, one or several times, so that the words taken meet it. Of all ways to do
so the one nearest to taking each document once is chosen: copies of a document
have a binomial base distribution with mean one and at most ``most`` copies, and
the relative entropy to it is minimised under one token constraint per source.
The solution tilts the base exponentially by ``exp(multiplier * size)``, which
gives a document the rate ``most / (1 + (most - 1) * exp(-multiplier * size))``.
The multipliers solve the convex dual by Newton's method, all sources at once.
A rate depends on source and size only, so a step runs over the table of counts
by source and size, an exact summary, and is one join and one combined aggregate;
steps that leave the bracket known so far are replaced by its middle.

Targets are ``share_percent`` of all words dealt by weight (sources by code point,
null last, weigh ``weights`` in turn). A target stops at ``most`` times the words of
its source; the excess is dealt to the others by weight until none is above.

Rates become copies by error diffusion: sizes of a source go from the largest to
the smallest, a size gets the whole number of copies nearest to its expected words
plus what is still owed, and the rest is passed on. If more than half a smallest
document is owed at the end, as in sources of few documents, single copies and pairs
of them are added or withdrawn while that brings the source nearer. Within a size the odd copies go to the documents whose hashes come
first. Rank is found in hash buckets of a size with offsets, so a source or size that
holds a third of all rows meets in no task. Sums are decimals, rounded per row, so
no result depends on the order of a sum; reruns agree.

Edge cases: a null text has size 0, documents without words are taken once and
count nothing, an empty source string is not null. Rows equal in id, source and size
are interchangeable. No rows give no rows. The result has the id, the columns in
``keep`` and those listed in ``mix``; kept columns whose names clash with new ones
are replaced, all others are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from doseframe.llm.common import add_columns, quoted, stored, words_blank

#: Fixed by the contract of the query: weights in turn, and the share of all words in percent.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150

#: A document is taken at most so often.
MOST = 2

#: Hash buckets in which documents of one source and size are ranked.
BUCKETS = 1024

#: Newton's method stops when every source is within half a word or this share of its target, at the latest after MAX_STEPS.
TOLERANCE = 1e-9
MAX_STEPS = 100

#: Changes of one or two copies when a source is settled, at most.
SETTLE_STEPS = 50

NEW_COLUMNS = ["size", "source_size", "target", "rate", "copies", "taken"]

#: A source as a key that joins without nulls.
SOURCE = ["src", "src_null"]


def sized_documents(docs: DataFrame, text: str, source: str, id_col: str, keep: Sequence[str]) -> DataFrame:
    """Narrow rows: id, source key, size, a bucket and a place in it, and the kept columns in one struct."""
    name = quoted(source).cast("string")
    kept = F.struct(F.lit(0).alias("none"), *[quoted(c) for c in keep]).alias("kept")
    rows = docs.select(
        quoted(id_col).alias("id"), F.coalesce(name, F.lit("")).alias("src"), name.isNull().alias("src_null"), quoted(text).cast("string").alias("text"), kept
    )

    def word_counts():
        return lambda texts, batch: [[len(words_blank(t)) for t in texts]]

    sized = add_columns(rows, "text", [T.StructField("size", T.LongType())], word_counts, drop=["text"])
    place = F.xxhash64("id", *SOURCE, "size")
    return sized.withColumn("place", place).withColumn("bucket", F.pmod("place", F.lit(BUCKETS)).cast("int"))


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Sources with their number from 0 in order of code points, null last: ranges of the order with offsets, no global sort in a task."""
    order = ["src_null", "src"]
    dealt = stored(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-sources")
    # The only window without a partition key: its input has a row per range.
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(offsets, "part").withColumn("s", F.col("before") + inside - 1).drop("part", "before")


def with_targets(sources: DataFrame, weights: Sequence[int], share_percent: int, most: int) -> DataFrame:
    """Numbered sources with their target, and whether it is all they can give.

    A source that its share would overfill gives all it can and leaves the rest;
    a round recomputes the share per weight from the totals of both kinds. Shares
    only grow from round to round, so the rounds end.
    """
    weight = F.element_at(F.array(*[F.lit(w).cast("decimal(10,0)") for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    weighed = stored(sources.withColumns({"w": weight, "cap": (F.col("source_size") * most).cast("decimal(20,0)")}), "mix-weights")
    total = weighed.agg(F.sum("source_size").alias("t"), F.sum("w").alias("w")).first()
    wanted, filled, rest = Fraction(share_percent * int(total["t"] or 0), 100), 0, int(total["w"] or 0)

    def per_weight() -> tuple[int, int]:
        left = (wanted - filled) / rest
        return left.numerator, left.denominator

    up, down = per_weight() if rest else (0, 1)
    while rest:
        full = weighed.where(F.col("w") * F.lit(up).cast("decimal(25,0)") >= F.col("cap") * F.lit(down).cast("decimal(18,0)"))
        found = full.agg(F.sum("cap").alias("c"), F.sum("w").alias("w")).first()
        now = int(found["c"] or 0), int(total["w"]) - int(found["w"] or 0)
        if now == (filled, rest):
            break
        filled, rest = now
        if rest:
            up, down = per_weight()
    is_full = F.lit(rest == 0) | (F.col("w") * F.lit(up).cast("decimal(25,0)") >= F.col("cap") * F.lit(down).cast("decimal(18,0)"))
    share = F.col("w").cast("double") * F.lit(up / down)
    return weighed.withColumn("full", is_full).withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)).drop("cap", "w")


def rate_at(multiplier, x, most: int):
    """Expected copies under the tilted distribution."""
    return F.lit(float(most)) / (1 + (most - 1) * F.exp(-multiplier * x))


def multipliers(sizes: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """Newton's method for the multiplier of each source that is not full: s, lam.

    ``sizes`` counts documents by source number and size; sizes are scaled by the
    source's greatest, so multipliers of all sources are alike.
    """
    none = F.lit(None).cast("double")
    state = sources.where(~F.col("full")).select("s", "target", "largest", F.lit(0.0).alias("lam"), none.alias("lo"), none.alias("hi"), F.lit(False).alias("done"))
    state = stored(state, "mix-multipliers")
    for _ in range(MAX_STEPS):
        if state.where(~F.col("done")).isEmpty():
            break
        rows = sizes.join(state.where(~F.col("done")).select("s", "largest", "lam"), "s")
        x = F.col("size") / F.col("largest")
        rate = rate_at(F.col("lam"), x, most)
        words = F.col("n") * F.col("size") * rate
        slope = words * x * (1 - rate / most)
        sums = rows.groupBy("s").agg(F.sum(words.cast("decimal(38,6)")).cast("double").alias("words"), F.sum(slope.cast("decimal(38,6)")).cast("double").alias("slope"))
        moved = state.join(sums, "s", "left")
        short = F.col("target") - F.col("words")
        near = F.abs(short) <= F.greatest(F.lit(0.5), F.col("target") * TOLERANCE)
        reach = 2 * (1 + F.abs("lam"))
        step = F.when(F.col("slope") > 0, short / F.col("slope")).otherwise(F.signum(short) * reach)
        lo = F.when(short > 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(short < 0, F.col("lam")).otherwise(F.col("hi"))
        bounded = F.col("lam") + F.greatest(-reach, F.least(reach, step))
        moved = moved.withColumns({"near": near, "new_lo": lo, "new_hi": hi, "next": bounded})
        outside = (F.col("next") <= F.col("new_lo")) | (F.col("next") >= F.col("new_hi"))
        following = F.when(outside & F.col("new_lo").isNotNull() & F.col("new_hi").isNotNull(), (F.col("new_lo") + F.col("new_hi")) / 2).otherwise(F.col("next"))
        kept = F.col("done") | F.col("near")
        state = stored(
            moved.select(
                "s",
                "target",
                "largest",
                F.when(kept, F.col("lam")).otherwise(following).alias("lam"),
                F.when(kept, F.col("lo")).otherwise(F.col("new_lo")).alias("lo"),
                F.when(kept, F.col("hi")).otherwise(F.col("new_hi")).alias("hi"),
                kept.alias("done"),
            ),
            "mix-multipliers",
        )
    return state.select("s", "lam")


def settled(owed: float, sizes: np.ndarray, copies: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """``copies`` with single ones, or two at once, added or withdrawn while that lessens what is owed. Sizes are distinct and not 0."""
    copies = copies.copy()
    for _ in range(SETTLE_STEPS):
        more, less = np.flatnonzero(copies < limits), np.flatnonzero(copies > 0)
        moves = np.concatenate(([0], sizes[more], -sizes[less]))
        places, signs = np.concatenate(([-1], more, less)), np.concatenate(([0], np.ones(len(more), int), -np.ones(len(less), int)))
        order = np.argsort(moves, kind="stable")
        at = np.searchsorted(moves[order], owed - moves)
        options = np.stack([order[np.clip(at - 1, 0, len(moves) - 1)], order[np.clip(at, 0, len(moves) - 1)]])
        left = np.abs(owed - moves - moves[options])
        # Twice the same document is no pair.
        left[(places[options] == places) & (places >= 0)] = np.inf
        side, first = np.unravel_index(np.argmin(left), left.shape)
        if left[side, first] >= abs(owed):
            break
        for move in (first, options[side, first]):
            if places[move] >= 0:
                copies[places[move]] += signs[move]
                owed -= moves[move]
    return copies


def rounded(rates: DataFrame, most: int) -> DataFrame:
    """Copies of all documents of a source and size together: s, size, n, rate, copies.

    A group has one row per distinct size of a source, so its length is bounded by the longest text, not by the documents.
    """
    schema = "s bigint, size bigint, n bigint, rate double, copies bigint"

    def diffuse(rows: pa.Table) -> pa.Table:
        rows = rows.select(["s", "size", "n", "rate"]).sort_by([("size", "descending")])
        owed, copies = 0.0, []
        for size, n, rate in zip(rows["size"].to_pylist(), rows["n"].to_pylist(), rows["rate"].to_pylist()):
            if not size:
                copies.append(n)
                continue
            due = n * rate + owed / size
            copies.append(min(max(int(due + 0.5), 0), most * n))
            owed = (due - copies[-1]) * size
        sizes, counts = rows["size"].to_numpy(), rows["n"].to_numpy()
        worded = sizes > 0
        if worded.any() and abs(owed) > sizes[worded].min() / 2:
            done = settled(owed, sizes[worded], np.array(copies)[worded], most * counts[worded])
            copies[: len(done)] = done.tolist()
        return rows.append_column("copies", pa.array(copies, pa.int64()))

    return rates.groupBy("s").applyInArrow(diffuse, schema)


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    id_col: str = "doc_id",
    keep: Sequence[str] = (),
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most: int = MOST,
) -> DataFrame:
    """Per document: its id, kept columns, size, source_size, target (of its source), rate, copies and taken (copies x size).

    ``share_percent`` is at most 100 * ``most``, else every source gives all it can.
    """
    sized = stored(sized_documents(docs, text, source, id_col, keep), "mix-documents")
    buckets = stored(sized.groupBy(*SOURCE, "size", "bucket").agg(F.count(F.lit(1)).alias("in_bucket")), "mix-buckets")
    counts = buckets.groupBy(*SOURCE, "size").agg(F.sum("in_bucket").alias("n"))
    totals = counts.groupBy(*SOURCE).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.max("size").alias("largest"))
    sources = stored(with_targets(ranked_sources(totals), weights, share_percent, most), "mix-targets")
    sizes = stored(counts.join(sources.select("s", *SOURCE), SOURCE).select("s", "size", "n"), "mix-sizes")
    solved = sources.join(multipliers(sizes, sources, most), "s", "left")
    rate = F.when(F.col("full"), F.lit(float(most))).otherwise(rate_at(F.col("lam"), F.col("size") / F.col("largest"), most))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate)
    copies = rounded(sizes.join(solved.select("s", "full", "largest", "lam"), "s").select("s", "size", "n", rate.alias("rate")), most)
    plan = copies.join(sources.select("s", *SOURCE, "source_size", "target"), "s")

    # Odd copies of a size go to its first documents in order of (bucket, place, id).
    before = F.sum("in_bucket").over(Window.partitionBy(*SOURCE, "size").orderBy("bucket")) - F.col("in_bucket")
    dealt = buckets.withColumn("before", before).join(plan, [*SOURCE, "size"]).select(
        *SOURCE,
        "size",
        "bucket",
        "source_size",
        "target",
        "rate",
        F.expr("copies div n").alias("each"),
        (F.col("copies") % F.col("n") - F.col("before")).alias("odd"),
    )
    at = F.row_number().over(Window.partitionBy(*SOURCE, "size", "bucket").orderBy("place", "id"))
    times = (F.col("each") + (at <= F.col("odd")).cast("bigint")).alias("copies")
    taken = sized.join(dealt, [*SOURCE, "size", "bucket"]).select("id", "kept", "size", "source_size", "target", "rate", times)
    clash = {n.lower() for n in [id_col, *NEW_COLUMNS]}
    kept = [F.col("kept").getField(c).alias(c) for c in keep if c.lower() not in clash]
    return taken.select(
        F.col("id").alias(id_col), *kept, "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself: each row of ``mix`` as often as it is taken, with its number from 1 as ``copy``."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
