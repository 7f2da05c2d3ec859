"""N-gram Jaccard join with vertical partitioning.

A document is its set of word shingles, in one global order (of their hashes).
That order is cut into fragments, so that a set becomes one short segment per
fragment. Two sets with the wanted similarity differ in at most D shingles; with
more than D fragments, at least one pair of their segments is equal. The steps:

1. Equal sets are one node from here on, however many documents have them.
2. Every node emits a hash of each segment. Nodes that share one are tied to a
   label, that of the smallest of them: a star, not all pairs. Linked sets share several
   segments, and a node keeps only the ties that a link cannot do without. The connected
   components of the kept ties hold all links, and nodes outside of them have none.
3. Nodes of a component meet in tasks, in blocks of bounded size and like numbers of
   shingles, every pair of blocks whose sizes allow a link once. There two parts of blocks at a time are compared: the order, rarest shingle first, is cut into fragments
   again; for each node the partial overlaps with all others are counted fragment
   by fragment and summed per pair, and pairs that can no longer reach the
   threshold drop out. Only links' counts and a spanning root per node leave a task.
4. The roots give the components of linked documents.

The number of fragments depends on a set's size: sizes are grouped in classes,
and a set also emits for the class below if a partner may lie there. A fragment
in which a set has no shingle emits nothing; sets with too many of these are cut
in further, differently hashed orders until one has fewer.

Words are runs between blanks, A-Z lower-cased. Texts with fewer words than a
shingle are one shingle; null, empty and blank texts have none and no link.
Repeated rows and ids count as documents each; a null id is never the smallest.
Nodes are 64-bit hashes of sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from doseframe.llm.common import add_columns, filter_of, raw_texts, set_aside, slices, stored
from doseframe.llm.components import components
from doseframe.llm.shingles import blank_word_hashes, mixed, rolled, signed

SHINGLE = 3
#: Percent of the union that two linked sets share at least.
THRESHOLD = 90
#: Below this, segments are too short for their equality to mean much.
LEAST_THRESHOLD = 75
#: Upper ends of neighbouring size classes differ by this factor; it exceeds 100 / THRESHOLD.
CLASS_RATIO = 1.4
#: Nodes and bytes of shingles in a block. A set is sent to every block that its own meets, so few large blocks spare the shuffle.
BLOCK_NODES = 3072
BLOCK_BYTES = 24 << 20
#: Nodes and bytes of a part of a block; what is compared at once is two parts.
PART_NODES = 1024
PART_BYTES = 8 << 20
FRAGMENTS = 8
#: Bytes of text that are cut into shingles at once; its hashes take some fifteen times that.
CUT_BYTES = 2 << 20
#: The lowest bits of a segment's hash are its size class.
CLASS_BITS = 6
#: Of the shingles in which linked sets may differ, a share of one in so many fragments comes on top, so that every link shares several segments; they are shorter for it.
MORE_FRAGMENTS = 8
#: Marks nodes that meet their own part; otherwise they are of part 0 or 1 of a pair.
WITHIN = 2

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_sets(raws: list[bytes], n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text."""
    words, counts = blank_word_hashes([raw.translate(LOWER) for raw in raws])
    runs, at = rolled(words, n), 0
    for count in counts.tolist():
        if count >= n:
            yield np.unique(runs[at : at + count - n + 1])
        else:
            yield rolled(words[at : at + count], count) if count else np.empty(0, np.uint64)
        at += count


def node_of(shingles: np.ndarray) -> int:
    value = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >> 63 else value


class Classes:
    """Size classes and their numbers of fragments for one threshold in percent."""

    def __init__(self, threshold: int):
        if not LEAST_THRESHOLD <= threshold <= 100:
            raise ValueError(f"the threshold must be {LEAST_THRESHOLD} to 100 percent")
        self.threshold = threshold
        self.tops = [1]

    def fragments(self, k: int) -> tuple[int, int]:
        """Fragments of a class, and how many of them may be empty: 2 percent, or more where segments are short.

        As many fragments as shingles stand for single shingles, of which linked sets share one anyway.
        """
        different = self.most_different(self.tops[k])
        if not different:
            return 0, 0  # linked sets are equal, so they are one node
        low = self.tops[k - 1] + 1 if k else 1
        spare, more = 1 + different // 50, different // MORE_FRAGMENTS
        while (count := different + 1 + more + spare) * math.exp(-low / count) * 1.25 > spare:
            spare += 1 + spare // 8
            if count >= low:
                return low, 0
        return count, spare

    def shared(self, k: int) -> int | None:
        """Segments with content that sets of this class would share if they were equal, at least; None where segments are single shingles."""
        count, spare = self.fragments(k)
        return count - spare if spare else None

    def most_different(self, top: int) -> int:
        """Shingles in which two linked sets differ at most, if the smaller has ``top`` shingles or fewer."""
        both = top + top * 100 // self.threshold
        return both * (100 - self.threshold) // (100 + self.threshold)

    def number(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * max(CLASS_RATIO, 105 / self.threshold))))
        return int(np.searchsorted(self.tops, size))

    def of(self, size: int) -> list[int]:
        """The class of a size, and the classes below in which smaller partners may lie."""
        low = self.number(-(-size * self.threshold // 100))
        return list(range(low, self.number(size) + 1))


def signatures(shingles: np.ndarray, classes: Classes) -> np.ndarray:
    """Hashes of the segments of one set, for each class it belongs to."""
    out = []

    def marked(hashes: np.ndarray, k: int) -> np.ndarray:
        return hashes >> np.uint64(CLASS_BITS) << np.uint64(CLASS_BITS) | np.uint64(k)

    for k in classes.of(len(shingles)):
        fragments, spare = classes.fragments(k)
        name = np.uint64((k << 20) * 0x9E3779B1 & 0xFFFFFFFFFFFF)
        if not fragments:
            continue
        if not spare:
            out.append(marked(mixed(shingles + name), k))
            continue
        # The first shingle hash of each fragment; the products stay below 2^64.
        edges = (np.arange(fragments + 1, dtype=np.float64) / fragments * 2.0**63).astype(np.uint64)
        salt = 0
        while True:
            order = shingles if not salt else np.sort(mixed(shingles ^ np.uint64(salt * 0x5851F42D)))
            ends = np.searchsorted(order >> np.uint64(1), edges)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(order))])
            sums = total[ends[1:]] - total[ends[:-1]]
            there = ends[1:] > ends[:-1]
            name = np.uint64((k << 20 | salt) * 0x9E3779B1 & 0xFFFFFFFFFFFF)
            place = np.arange(fragments, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            out.append(marked(mixed(mixed(sums + place) + name)[there], k))
            # At least spare + 1 segments of linked sets are equal; fewer empty ones than that leave one with content.
            if fragments - int(there.sum()) <= spare:
                break
            salt += 1
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def segment_rows(docs: DataFrame, text: str, shingle: int, threshold: int) -> DataFrame:
    """(sig, node) of every distinct set in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = Classes(threshold), set()
        for batch in slices(batches, text, CUT_BYTES):
            sigs, nodes = [], []
            for found in shingle_sets(raw_texts(batch.column(text)), shingle):
                node = node_of(found)
                if node in seen or not len(found):
                    continue
                seen.add(node)
                mine = signatures(found, classes)
                sigs.append(signed(mine))
                nodes.append(np.full(len(mine), node, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(nodes))], names=["sig", "node"])

    return docs.select(text).mapInArrow(run, "sig bigint, node bigint")


def least_shared(size: Column, k: Column, threshold: int) -> Column:
    """Segments of class ``k`` that a set of this size shares with any one it links with there, at least.

    A link's class is that of the smaller set. Of equal sets all segments are equal, and every shingle in
    which two sets differ changes one at most.
    """
    classes = Classes(threshold)
    while len(classes.tops) < 1 << CLASS_BITS:
        classes.number(classes.tops[-1] + 1)
    numbers = range(1 << CLASS_BITS)

    def of_class(values: list[int | None]) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), (k + 1).cast("int"))

    top = of_class(classes.tops[: len(numbers)])
    low = of_class([classes.tops[i - 1] + 1 if i else 1 for i in numbers])
    shared = of_class([classes.shared(i) for i in numbers])
    largest = F.when(size <= top, F.floor(size * 100 / threshold)).otherwise(top)
    smallest = F.greatest(low, F.ceil(size * threshold / 100))
    different = F.floor((size + largest) * (100 - threshold) / (100 + threshold))
    overlap = F.ceil((size + smallest) * threshold / (100 + threshold))
    return F.greatest(F.coalesce(shared - different, overlap), F.lit(1))


def needed_ties(rows: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """(a, b): nodes with the labels of their segments, without ties that no link depends on.

    All segments whose smallest node is the same have one label in a class. A node that has n segments under a label holds
    its levels 0 to log2(n), which count for 1, 2, 4 .. and the rest; what two nodes share under it is no more than the levels
    that both hold. With high levels first, linked nodes hold the first one they have in common before the last ones of
    each that together fall short of what a link shares. So a few segments are no tie to the near copies of another text.
    """
    of_sig = Window.partitionBy("sig").orderBy("node")
    whole = of_sig.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = rows.withColumns({"hub": F.min("node").over(whole), "last": F.max("node").over(whole), "before": F.lag("node").over(of_sig)})
    # A set has its segments once for every task that read it.
    shared = seen.where("hub <> last AND (before IS NULL OR before <> node)").withColumn("k", F.col("sig").bitwiseAND(F.lit((1 << CLASS_BITS) - 1)))
    ties = shared.groupBy("node", "k", "hub").agg(F.count(F.lit(1)).alias("n")).join(sizes, "node")
    ties = ties.select("node", "k", F.xxhash64("hub", "k").alias("label"), "n", least_shared(F.col("n_shingles"), F.col("k"), threshold).alias("need"))
    by_label = Window.partitionBy("label").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Two nodes share no more under a label than the second most that any has.
    ties = ties.withColumn("n", F.least("n", F.nth_value("n", 2).over(by_label))).withColumn("top", F.length(F.bin("n")) - 1)
    levels = ties.withColumn("level", F.explode(F.sequence(F.lit(0), "top"))).withColumn("_size", F.pow(F.lit(2.0), "level").cast("bigint"))
    levels = levels.withColumn("counts", F.when(F.col("level") < F.col("top"), F.col("_size")).otherwise(F.col("n") - F.col("_size") + 1))
    last_first = Window.partitionBy("node", "k").orderBy("level", "label").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = levels.withColumn("_upto", F.sum("counts").over(last_first)).where("_upto >= need")
    return kept.select(F.col("node").alias("a"), F.xxhash64("label", "level").alias("b"))


def tied_sets(docs: DataFrame, text: str, shingle: int, tied: DataFrame) -> DataFrame:
    """(node, shingles) of the sets that have ties, once each."""
    held = docs.sparkSession.sparkContext.broadcast(filter_of(tied, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = held.value, set()
        for batch in slices(batches, text, CUT_BYTES):
            nodes, sets = [], []
            for found in shingle_sets(raw_texts(batch.column(text)), shingle):
                node = node_of(found)
                if node in bits and node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return docs.select(text).mapInArrow(run, "node bigint, shingles binary").dropDuplicates(["node"])


def linked(sets: list[np.ndarray], own: np.ndarray, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the later ones it links with. ``own`` is 0 or 1 by part, and pairs are of unlike parts, or WITHIN."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    # The arrays by shingle are the memory of the task: 32 bits where they do, and none is kept longer than it is read.
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number, tokens = number.astype(np.int32), len(times)
    owner = np.repeat(np.arange(count, dtype=np.int32), sizes)
    # Rarest shingles first; equal ranks are told apart by their place in the hash order.
    rarest = np.argsort(times, kind="stable")
    rank = np.empty(tokens, np.int32)
    rank[rarest] = np.arange(tokens, dtype=np.int32)
    begin = np.concatenate([[0], np.cumsum(times[rarest])])
    alone = np.bincount(owner, weights=times[number] == 1, minlength=count)
    by = rank[number]
    del number, times, rarest, rank
    posting = owner[np.argsort(by, kind="stable")]
    key = owner.astype(np.int64)
    del owner
    key *= tokens
    key += by
    del by
    key.sort()
    key %= tokens
    ordered = key.astype(np.int32)
    del key
    starts = np.concatenate([[0], np.cumsum(sizes)])
    cross = own[0] != WITHIN
    need_of = threshold / (100 + threshold)
    for x in range(count - 1):
        mine = ordered[starts[x] : starts[x + 1]]
        need = np.ceil(need_of * (sizes + sizes[x]) - 1e-9)
        # A shingle that no other set here has is in no overlap.
        alive = (np.minimum(sizes - alone, sizes[x] - alone[x]) >= need) & (np.arange(count) > x)
        if cross:
            alive &= own != own[x]
        shared = np.zeros(count, np.int64)
        at = int(alone[x])
        step = max(1, -(-(len(mine) - at) // FRAGMENTS))
        while alive.any() and at < len(mine):
            part = mine[at : at + step]
            where = np.concatenate([posting[begin[t] : begin[t + 1]] for t in part])
            shared += np.bincount(where, minlength=count)
            at += step
            alive &= shared + (len(mine) - min(at, len(mine))) >= need
        if alive.any():
            others = np.flatnonzero(alive)
            union = sizes[others] + sizes[x] - shared[others]
            others = others[100 * shared[others] >= threshold * union]
            if len(others):
                yield x, others


def parts_of(rows: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The rows of a block in parts that are compared at once."""
    count = max(-(-len(rows) // PART_NODES), -(-int(sizes[rows].sum()) * 8 // PART_BYTES))
    return [p for p in np.array_split(rows, max(count, 1)) if len(p)]


def block_links(threshold: int):
    """Links of one pair of blocks, and inside of those marked ``inner``: for each node with a link the weight of its partners and a root."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        weight = np.array(table.column("weight").to_pylist(), np.int64)
        # Views of the table's own bytes, so that two blocks are held once.
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles")]
        own = np.array(table.column("own").to_pylist(), np.int64)
        inner = np.array(table.column("inner").to_pylist(), bool)
        sizes = np.array([len(s) for s in sets], np.int64)
        blocks = [parts_of(np.flatnonzero(own == b), sizes) for b in (0, 1)]
        pairs = [(p, q) for p in blocks[0] for q in blocks[1]]
        for parts in blocks:
            if parts and inner[parts[0][0]]:
                pairs += [*((p, p[:0]) for p in parts), *combinations(parts, 2)]
        parent, degree = list(range(len(nodes))), np.zeros(len(nodes), np.int64)

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for p, q in pairs:
            rows = np.concatenate([p, q])
            side = np.repeat([0, 1], [len(p), len(q)]) if len(q) else np.full(len(p), WITHIN)
            for at, partners in linked([sets[i] for i in rows], side, threshold) if len(rows) > 1 else ():
                x, others = int(rows[at]), rows[partners]
                degree[x] += weight[others].sum()
                degree[others] += weight[x]
                for y in others.tolist():
                    a, b = top(x), top(y)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
        found = np.flatnonzero(degree).tolist()
        return pa.table(
            {
                "node": pa.array([nodes[i] for i in found], pa.int64()),
                "root": pa.array([nodes[top(i)] for i in found], pa.int64()),
                "n_links": pa.array(degree[found], pa.int64()),
            }
        )

    return run


def size_band(size: str, threshold: int) -> Column:
    """Sizes of two linked sets are of one band or of neighbouring ones, as their ratio is at most 100 / threshold.

    Bands are a little wider than that, so that rounding does no harm.
    """
    return F.floor(F.log(F.col(size)) / max(1.001 * math.log(100 / threshold), 0.01)).cast("int")


def banded_blocks(sized: DataFrame) -> DataFrame:
    """(grp, band, start, blocks, below, above): blocks of each band of a group, numbered by band, and how many the neighbouring bands have.

    A group of one block in all has no bands.
    """

    def count(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK_NODES), F.ceil(size / BLOCK_BYTES)).cast("int")

    whole = Window.partitionBy("grp")
    ordered = whole.orderBy("band")
    bands = sized.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_shingles") * 8).alias("bytes"))
    bands = bands.withColumn("single", count(F.sum("n").over(whole), F.sum("bytes").over(whole)) == 1)
    bands = bands.withColumn("blocks", count(F.col("n"), F.col("bytes")))
    columns = {
        "start": F.sum("blocks").over(ordered).cast("int") - F.col("blocks"),
        "below": F.when(F.lag("band").over(ordered) == F.col("band") - 1, F.lag("blocks").over(ordered)),
        "above": F.when(F.lead("band").over(ordered) == F.col("band") + 1, F.lead("blocks").over(ordered)),
    }
    bands = bands.withColumns(columns)
    return bands.select(
        "grp",
        "band",
        *[F.when(F.col("single"), 0).otherwise(F.coalesce(c, F.lit(0))).alias(c) for c in ("start", "below", "above")],
        F.when(F.col("single"), 1).otherwise(F.col("blocks")).alias("blocks"),
    )


def jaccard_links(docs: DataFrame, copies: DataFrame, *, text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(node, root, n_links) of every node that links with a different one; ``copies`` has the documents (weight) and shingles (n_shingles) of each node."""
    # Segments are by far the most rows: they are shuffled once, not stored, and leave the task only as ties.
    ties = needed_ties(segment_rows(docs, text, shingle, threshold), copies.select("node", "n_shingles"), threshold)
    groups = components(ties, "ngram-ties")
    # The labels among them are no nodes, and go.
    member = groups.select(F.col("a").alias("node"), F.col("b").alias("grp")).unionByName(groups.select(F.col("b").alias("node"), F.col("b").alias("grp")).distinct())
    # Blocks follow from the numbers of shingles, so that the sets themselves are shuffled by node and by blocks only, and not stored.
    sized = stored(member.join(copies, "node").withColumn("band", size_band("n_shingles", threshold)), "ngram-groups")
    dealt = sized.join(banded_blocks(sized), ["grp", "band"]).select("node", "grp", "weight", "start", "blocks", "below", "above")
    placed = tied_sets(docs, text, shingle, sized).join(dealt, "node")
    placed = placed.withColumn("blk", F.col("start") + F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Every pair of blocks of like sizes is one group, so a group of copies of any size is many tasks of bounded size.
    # The sets of a block meet each other where they meet the next block (of the last block: the one before), so they are not sent once more for that.
    first, last = F.col("start") - F.col("below"), F.col("start") + F.col("blocks") + F.col("above") - 1
    home = F.when(F.col("blk") < last, F.col("blk") + 1).when(F.col("blk") > first, F.col("blk") - 1).otherwise(F.col("blk"))
    reach = F.filter(F.sequence(first, last), lambda other: (other != F.col("blk")) | (first == last))
    met = placed.withColumn("other", F.explode(reach)).withColumns(
        {
            "low": F.least("blk", "other"),
            "high": F.greatest("blk", "other"),
            "own": (F.col("blk") > F.col("other")).cast("int"),
            "inner": F.col("other") == home,
        }
    )
    # Said outright: rows that a join has dealt by group already would else stay so, a whole group in one task.
    parts = met.select("grp", "low", "high", "own", "inner", "node", "weight", "shingles").repartition("grp", "low", "high")
    found = parts.groupBy("grp", "low", "high").applyInArrow(block_links(threshold), "node bigint, root bigint, n_links bigint")
    found = stored(found, "ngram-links")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "ngram-roots")
    totals = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    links = totals.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    return links.select("node", F.coalesce("root", "node").alias("root"), "n_links")


def add_nodes(docs: DataFrame, text: str, shingle: int = SHINGLE) -> DataFrame:
    def start():
        def run(raws: list[bytes], batch: pa.RecordBatch) -> list:
            found = [(len(s), node_of(s)) for s in shingle_sets(raws, shingle)]
            return [[n for n, _ in found], [node for _, node in found]]

        return run

    fields = [T.StructField("n_shingles", T.LongType(), False), T.StructField("node", T.LongType(), False)]
    return add_columns(docs, text, fields, start, most=CUT_BYTES)


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_shingles, node, group, component_id, n_links), one row per row of ``docs``.

    n_links counts the other documents with a linked or an equal set.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    slim = stored(add_nodes(texts, "text", options.get("shingle", SHINGLE)).select("doc_id", "n_shingles", "node"), "ngram-docs")
    copies = slim.where("n_shingles > 0").groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.max("n_shingles").alias("n_shingles")
    )
    links = jaccard_links(texts, copies.select("node", F.col("copies").alias("weight"), "n_shingles"), **options)
    # One row per distinct set; hot sets are combined before they are joined.
    named = copies.join(links, "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("group"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    lowest = named.groupBy("group").agg(F.min("least").alias("component_id"))
    classes = named.join(lowest, "group").select("node", "group", "component_id", "n_links")
    joined = slim.join(classes, "node", "left")
    lone = F.col("n_shingles") == 0
    return joined.select(
        "doc_id", "n_shingles", "node", F.when(~lone, F.col("group")).alias("group"),
        F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(lone, F.lit(0)).otherwise(F.col("n_links")).cast("bigint").alias("n_links"),
    )


def keep_one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id. Texts without words all stay."""
    docs, given = set_aside(docs, ["n_shingles", "node", "_again"])
    found = stored(jaccard_components(docs, doc_id=doc_id, text=text, **options), "ngram-components")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    lone = first.where("n_shingles = 0").select("doc_id", "node").distinct()
    # Where an id is repeated inside its component, one of its sets stays.
    rest = first.where("n_shingles > 0").groupBy("group", "doc_id").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
    keep = rest.select("doc_id", "node", (F.col("n") > 1).alias("_again")).unionByName(lone.withColumn("_again", F.lit(False)))
    with_nodes = add_nodes(docs, text, options.get("shingle", SHINGLE)).alias("d")
    same = F.col(f"d.{doc_id}").eqNullSafe(F.col("k.doc_id")) & (F.col("d.node") == F.col("k.node"))
    kept = with_nodes.join(keep.alias("k"), same).select("d.*", "k._again")
    again = kept.where("_again").dropDuplicates([doc_id, "node"])
    return given(kept.where("NOT _again").unionByName(again))
