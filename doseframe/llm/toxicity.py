"""Toxicity by the nearest labelled examples.

Examples and documents are TF-IDF vectors (square root of the count, times inverse
document frequency) over a chosen vocabulary: of the words and word beginnings
of a bounded sample of labelled documents, those that most clearly go with toxic
labels (chi-squared), none of which begins another. All other words are one more
feature, so that a single such word counts for less in a longer text. Document
frequencies are counted over all documents.

Most texts have no chosen feature. They are compared by all their words: their
whole TF-IDF vectors against those of ``WORD_TOXIC`` and ``WORD_CLEAN`` of the same
examples at most, in an index of their own (words that none of them has are one more
feature there). So every text that shares a
word with an example has neighbours and evidence.

Each document looks up its nearest examples by exact cosine in an inverted index
whose postings lie in blocks with their largest weight: the blocks' upper bounds
decide which blocks are scored, highest first, until no block left can reach the
list of nearest examples.

The nearest examples vote, the closer the more; a logistic curve, fitted on the
examples' own votes without themselves, turns votes into a calibrated score, and
the nearest examples are the evidence. Each of the two indexes has its own curve.

The sample is ``TOXIC_EXAMPLES`` and ``CLEAN_EXAMPLES`` documents at most, by lowest hash of
their id, and ``SAMPLE_BYTES`` of text at most (whole texts, in the same order). Conflicting labels of an id count as toxic; null labels and ids are
ignored. Null and empty texts, and texts without a word of any example, have no
neighbour and get the mean score of examples without chosen features. Without both kinds of labels every
score is the share of the labels seen. Rows are scored each by their text alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from doseframe.llm.common import add_columns, raw_texts, slices, stored

TOXIC_EXAMPLES = 1500
CLEAN_EXAMPLES = 3000
VOCABULARY = 1024
#: Least chi-squared of a chosen word: far beyond chance also among very many words.
LEAST_CHI2 = 25.0
NEIGHBOURS = 15
BLOCK = 64
#: Texts of the sample, in bytes; its words go to every worker.
SAMPLE_BYTES = 32 << 20
#: Examples in the index of all words, and in a block of it.
WORD_TOXIC = 500
WORD_CLEAN = 1000
WORD_BLOCK = 256
BEGINNINGS = (4, 5, 6)

# Letters keep their place and A-Z become a-z; every byte beyond ASCII counts as a letter.
LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

EVIDENCE = T.ArrayType(
    T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("toxic", T.IntegerType())])
)
FIELDS = [T.StructField("score", T.DoubleType(), False), T.StructField("evidence", EVIDENCE, False)]


def word_features(word: bytes) -> list[bytes]:
    """The whole word, marked by a closing sign, and its beginnings."""
    return [word + b"$", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def counted(raw: bytes) -> Counter:
    return Counter(raw.translate(LETTERS).split())


class Features:
    """Numbers of the vocabulary's features in a text, with their counts."""

    def __init__(self, vocabulary: list[bytes]):
        self.number = {f: i for i, f in enumerate(vocabulary)}
        # The first letters of all features; few other words begin so.
        self.heads = {f.rstrip(b"$")[:3] for f in vocabulary}

    def of(self, words: Counter) -> dict[int, int]:
        """Counts by number; words with no feature are counted under the number after the last."""
        found: dict[int, int] = {}
        number, heads, others = self.number, self.heads, 0
        for word, n in words.items():
            numbers = [number[f] for f in word_features(word) if f in number] if word[:3] in heads else ()
            for i in numbers:
                found[i] = found.get(i, 0) + n
            if not numbers:
                others += n
        if others:
            found[len(number)] = others
        return found


@dataclass
class Neighbours:
    """The nearest examples of one vector, best first."""

    examples: np.ndarray
    similarity: np.ndarray


class BlockMaxIndex:
    """Postings of examples by feature, in blocks of example numbers with their largest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], features: int):
        self.size = len(vectors)
        self.blocks = max(1, -(-self.size // BLOCK))
        self.bound = np.zeros((features, self.blocks))
        postings: dict[tuple[int, int], tuple[list[int], list[float]]] = {}
        for example, (terms, weights) in enumerate(vectors):
            block = example // BLOCK
            for t, w in zip(terms.tolist(), weights.tolist()):
                places, values = postings.setdefault((t, block), ([], []))
                places.append(example % BLOCK)
                values.append(w)
                self.bound[t, block] = max(self.bound[t, block], w)
        self.postings = {key: (np.array(p), np.array(v)) for key, (p, v) in postings.items()}

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int = -1) -> Neighbours:
        """The exact ``k`` nearest examples with a common feature; ties go to the lower number. ``leave`` is left out."""
        bounds = weights @ self.bound[terms]
        examples, similarity = np.empty(0, np.int64), np.empty(0)
        for block in np.argsort(-bounds, kind="stable"):
            # A hair below the bound, so that rounding never skips an equal example.
            if bounds[block] <= 0 or len(similarity) == k and bounds[block] < similarity[-1] - 1e-9:
                break
            scores = np.zeros(BLOCK)
            for t, w in zip(terms.tolist(), weights.tolist()):
                if self.bound[t, block]:
                    places, values = self.postings[t, block]
                    scores[places] += w * values
            here = np.flatnonzero(scores > 0)
            examples = np.concatenate([examples, block * BLOCK + here])
            similarity = np.concatenate([similarity, scores[here]])
            if leave >= 0:
                other = examples != leave
                examples, similarity = examples[other], similarity[other]
            best = np.lexsort((examples, -similarity))[:k]
            examples, similarity = examples[best], similarity[best]
        return Neighbours(examples, similarity)


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``sizes`` of each, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)


class WordIndex:
    """``BlockMaxIndex`` for very many terms: postings by term, cut at the blocks of examples, in flat arrays."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = WORD_BLOCK):
        self.block, self.blocks = block, max(1, -(-len(vectors) // block))
        term = np.concatenate([t for t, _ in vectors])
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        order = np.lexsort((example, term))
        term, example = term[order], example[order]
        self.weight = np.concatenate([w for _, w in vectors])[order]
        key = term * self.blocks + example // block
        cut = np.flatnonzero(np.diff(key, prepend=-1))
        # Cuts are the places where a term's postings of one block begin.
        self.cut = np.append(cut, len(key)).astype(np.int32)
        self.of_term = np.searchsorted(term[cut], np.arange(terms + 1)).astype(np.int32)
        self.cut_block = (example[cut] // block).astype(np.int32)
        self.bound = np.maximum.reduceat(self.weight, cut) if len(cut) else np.empty(0)
        self.place = example % block

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int = -1) -> Neighbours:
        """The exact ``k`` nearest examples with a common term; ties go to the lower number. ``leave`` is left out."""
        first = self.of_term[terms]
        many = self.of_term[terms + 1] - first
        cuts, given = ranges(first, many), np.repeat(weights, many)
        bounds = np.bincount(self.cut_block[cuts], given * self.bound[cuts], self.blocks)
        order = np.argsort(self.cut_block[cuts], kind="stable")
        cuts, given = cuts[order], given[order]
        edge = np.searchsorted(self.cut_block[cuts], np.arange(self.blocks + 1))
        examples, similarity = np.empty(0, np.int64), np.empty(0)
        for block in np.argsort(-bounds, kind="stable").tolist():
            # A hair below the bound, so that rounding never skips an equal example.
            if bounds[block] <= 0 or len(similarity) == k and bounds[block] < similarity[-1] - 1e-9:
                break
            mine = cuts[edge[block] : edge[block + 1]]
            begin = self.cut[mine]
            many = self.cut[mine + 1] - begin
            at = ranges(begin, many)
            scores = np.bincount(self.place[at], self.weight[at] * np.repeat(given[edge[block] : edge[block + 1]], many), self.block)
            if 0 <= leave - block * self.block < self.block:
                scores[leave - block * self.block] = 0
            here = np.flatnonzero(scores > (max(similarity[-1] - 1e-9, 0) if len(similarity) == k else 0))
            examples = np.concatenate([examples, block * self.block + here])
            similarity = np.concatenate([similarity, scores[here]])
            best = np.lexsort((examples, -similarity))[:k]
            examples, similarity = examples[best], similarity[best]
        return Neighbours(examples, similarity)


def unit(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's vector of length 1, terms in order."""
    order = np.argsort(terms)
    terms = terms[order]
    weights = np.sqrt(counts[order].astype(np.float64)) * idf[terms]
    length = np.sqrt((weights * weights).sum())
    return terms, weights / length if length else weights


class WordVectors:
    """Whole texts as vectors: a term for each word of the examples, and one for all other words."""

    def __init__(self, words: list[bytes], idf: np.ndarray):
        self.number, self.idf = {w: i for i, w in enumerate(words)}, idf

    def of(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        number = self.number
        known = [(number[w], n) for w, n in words.items() if w in number]
        if not known:
            return np.empty(0, np.int64), np.empty(0)
        pairs = np.array(known, np.int64)
        others = words.total() - int(pairs[:, 1].sum())
        if others:
            pairs = np.append(pairs, [[len(number), others]], axis=0)
        return unit(pairs[:, 0], pairs[:, 1], self.idf)


def few_of_each(vectors: list[tuple[np.ndarray, np.ndarray]], order: list[int]) -> list[int]:
    """Of equal vectors no more than can be nearest at a time; one more, since a training example leaves itself out."""
    seen: Counter = Counter()
    kept = []
    for i in order:
        key = (vectors[i][0].tobytes(), vectors[i][1].tobytes())
        seen[key] += 1
        if seen[key] <= NEIGHBOURS + 1:
            kept.append(i)
    return kept


def word_examples(examples: list[tuple[str, Counter, int]]) -> list[tuple[str, Counter, int]]:
    """Those in the index of all words: the lowest hashes of either label."""
    order = sorted(examples, key=lambda e: crc32(e[0].encode()))
    return [e for y, n in ((1, WORD_TOXIC), (0, WORD_CLEAN)) for e in [e for e in order if e[2] == y][:n]]


class ToxicityModel:
    """Labelled examples, their two indexes and the curves from votes to scores."""

    def __init__(
        self, vocabulary: list[bytes], idf: np.ndarray, words: list[bytes], word_idf: np.ndarray, examples: list[tuple[str, Counter, int]], rate: float
    ):
        self.features, self.idf, self.rate, self.rest = Features(vocabulary), idf, rate, len(vocabulary)
        self.words = WordVectors(words, word_idf)
        labels = np.array([y for _, _, y in examples], np.int64)
        self.steady = len(set(labels.tolist())) < 2
        if self.steady:
            return
        vectors = [self.vector(self.features.of(counts)) for _, counts, _ in examples]
        # Alike examples lie together, which keeps the blocks' bounds tight.
        order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0][:3].tolist(), vectors[i][1][:3].round(2).tolist(), examples[i][0]))
        kept = few_of_each(vectors, order)
        self.ids = [examples[i][0] for i in kept]
        self.labels = labels[kept]
        self.index = BlockMaxIndex([vectors[i] for i in kept], len(vocabulary) + 1)
        # Sampling took more toxic examples than there are, so each weighs as much as the labels it stands for.
        share = labels.mean()
        each = np.where(labels == 1, rate / share, (1 - rate) / (1 - share))
        silent = np.array([not self.speaks(t) for t, _ in vectors])
        self.silent_score = float((each * labels)[silent].sum() + rate) / float(each[silent].sum() + 1)
        place = {i: n for n, i in enumerate(kept)}
        loud = np.flatnonzero(~silent)
        votes = [self.vote(self.index.nearest(*vectors[i], NEIGHBOURS, leave=place.get(i, -1)), self.labels) for i in loud.tolist()]
        self.curve = logistic(np.array(votes), labels[loud], each[loud]) if votes else np.zeros(3)
        self.learn_words(examples)

    def learn_words(self, examples: list[tuple[str, Counter, int]]) -> None:
        """The index of all words, and its curve from the examples without a chosen feature."""
        examples = word_examples(examples)
        labels = np.array([y for _, _, y in examples], np.int64)
        share = labels.mean()
        each = np.where(labels == 1, self.rate / share, (1 - self.rate) / (1 - share))
        vectors = [self.words.of(counts) for _, counts, _ in examples]
        silent = [not self.speaks(self.vector(self.features.of(counts))[0]) for _, counts, _ in examples]
        common = [t[np.argsort(self.words.idf[t], kind="stable")[:4]].tolist() for t, _ in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (common[i], examples[i][0]))
        kept = few_of_each(vectors, order)
        self.word_ids = [examples[i][0] for i in kept]
        self.word_labels = labels[kept]
        self.word_index = WordIndex([vectors[i] for i in kept], len(self.words.number) + 1)
        place = {i: n for n, i in enumerate(kept)}
        quiet = [i for i in np.flatnonzero(silent).tolist() if len(vectors[i][0])]
        votes = [self.vote(self.word_index.nearest(*vectors[i], NEIGHBOURS, leave=place.get(i, -1)), self.word_labels) for i in quiet]
        self.word_curve = logistic(np.array(votes), labels[quiet], each[quiet]) if votes else None

    def speaks(self, terms: np.ndarray) -> bool:
        """Whether any chosen feature occurs."""
        return len(terms) > 0 and terms[0] != self.rest

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        return unit(np.array([*counts], np.int64), np.array([*counts.values()], np.int64), self.idf)

    def vote(self, found: Neighbours, labels: np.ndarray) -> list[float]:
        """The share of toxic neighbours, weighted by closeness, less a half; and how near the nearest is."""
        if not len(found.examples):
            return [0.0, 0.0]
        weights = 1 / (0.05 + np.sqrt(np.maximum(0, 2 - 2 * found.similarity)))
        return [float((weights * labels[found.examples]).sum() / weights.sum()) - 0.5, float(found.similarity[0])]

    def score(self, raw: bytes) -> tuple[float, list[tuple[str, float, int]]]:
        if self.steady:
            return self.rate, []
        words = counted(raw)
        terms, weights = self.vector(self.features.of(words))
        if self.speaks(terms):
            index, ids, labels, curve = self.index, self.ids, self.labels, self.curve
        else:
            terms, weights = self.words.of(words)
            if not len(terms) or self.word_curve is None:
                return min(max(self.silent_score, 0.0), 1.0), []
            index, ids, labels, curve = self.word_index, self.word_ids, self.word_labels, self.word_curve
        found = index.nearest(terms, weights, NEIGHBOURS)
        vote, near = self.vote(found, labels)
        p = 1 / (1 + np.exp(-(curve[0] + curve[1] * vote + curve[2] * vote * near)))
        return float(p), [(ids[i], min(1.0, float(s)), int(labels[i])) for i, s in zip(found.examples, found.similarity)]


def logistic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weighted logistic regression on the vote and the vote times its nearness, by Newton steps."""
    x = np.column_stack([np.ones(len(votes)), votes[:, 0], votes[:, 0] * votes[:, 1]])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weights * (labels - p)) - ridge * w
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def example_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, raw, toxic) of the sample, stored. Only ids of the sample, a bounded number, are broadcast."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ranked = known.withColumn("h", F.xxhash64("doc_id"))
    chosen = [ranked.where(f"toxic = {y}").orderBy("h", "doc_id").limit(n) for y, n in ((1, TOXIC_EXAMPLES), (0, CLEAN_EXAMPLES))]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("id"), "toxic"))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("raw"))
    sample = stored(rows.join(sample, "id").withColumn("h", F.xxhash64("id", "raw")), "toxicity")
    size = F.octet_length("raw").cast("bigint")
    if (sample.agg(F.sum(size).alias("n")).first()["n"] or 0) > SAMPLE_BYTES:
        # Sizes of a sample, no texts, meet in one task.
        sums = sample.select("h", size.alias("n")).distinct().withColumn("upto", F.sum("n").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)))
        sample = sample.join(sums.where(F.col("upto") <= SAMPLE_BYTES).select("h").distinct(), "h")
    return sample.dropDuplicates(["h"]).select("id", "raw", "toxic")


def chosen_features(sample: DataFrame) -> list[bytes]:
    """The features that go most clearly with toxic labels, of the whole texts of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for batch in slices(batches, "raw"):
            for raw, y in zip(raw_texts(batch.column("raw")), batch.column("toxic").to_pylist()):
                (toxic if y == 1 else clean).update({f for word in counted(raw) for f in word_features(word)})
        names = list(toxic)  # a feature of clean texts alone is never chosen
        for i in range(0, len(names), 100_000):
            part = names[i : i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), pa.array([toxic[f] for f in part]), pa.array([clean[f] for f in part])],
                names=["f", "toxic", "clean"],
            )
        rest = [f for f in clean if f not in toxic]
        for i in range(0, len(rest), 100_000):
            part = rest[i : i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), pa.array([0] * len(part)), pa.array([clean[f] for f in part])], names=["f", "toxic", "clean"]
            )

    sizes = sample.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).first()
    a, b = float(sizes["a"] or 0), float(sizes["b"] or 0)
    if not a or not b:
        return []
    counts = sample.mapInArrow(run, "f binary, toxic bigint, clean bigint").groupBy("f").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    t, c = F.col("t"), F.col("c")
    chi2 = (a + b) * F.pow(t * (b - c) - c * (a - t), 2) / (F.lit(a * b) * (t + c) * (a + b - t - c))
    telling = counts.where((t * b > c * a) & (t + c < a + b)).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
    best = telling.orderBy(F.desc("chi2"), F.octet_length("f"), "f").limit(VOCABULARY).collect()
    kept: list[bytes] = []
    for f in (bytes(r["f"]) for r in best):
        if not any(f.startswith(k) or k.startswith(f) for k in kept):
            kept.append(f)
    return sorted(kept)


def inverse_frequencies(docs: DataFrame, text: str, vocabulary: list[bytes], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """log((1 + N) / (1 + df)) + 1 over all documents, of features and of whole words; all other words together count as
    in every document."""
    size, most = len(vocabulary), len(vocabulary) + len(words)
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts, rows = Features(vocabulary), np.zeros(most, np.int64), 0
        number = {w: size + i for i, w in enumerate(held.value)}
        for batch in slices(batches, text):
            for raw in raw_texts(batch.column(text)):
                here = counted(raw)
                found = [i for i in features.of(here) if i < size]
                found += [number[w] for w in here if w in number]
                counts[found] += 1
                rows += 1
        met = np.flatnonzero(counts)
        for i in range(0, len(met), 100_000):
            part = met[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["i", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([rows], pa.int64())], names=["i", "n"])

    sums = docs.select(text).mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(most + 1, np.int64)
    df[sums.column("i").to_numpy()] = sums.column("n").to_numpy()  # the number of rows stands last
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    return np.append(idf[:size], 1.0), np.append(idf[size:], 1.0)


def examples_of(sample: DataFrame) -> list[tuple[str, Counter, int]]:
    """(id, words with counts, label), ordered; words have no blanks, so they travel joined by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "raw"):
            texts = [counted(raw) for raw in raw_texts(batch.column("raw"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([b" ".join(words) for words in texts], pa.binary()),
                    pa.array([np.fromiter(words.values(), np.int64).tobytes() for words in texts], pa.binary()),
                    batch.column("toxic"),
                ],
                names=["id", "words", "counts", "toxic"],
            )

    rows = sample.select(F.col("id").cast("string").alias("id"), "raw", "toxic").mapInArrow(run, "id string, words binary, counts binary, toxic int")
    found = [
        (r["id"], Counter(dict(zip(r["words"].split(), np.frombuffer(r["counts"], np.int64).tolist()))), r["toxic"]) for r in rows.toArrow().to_pylist()
    ]
    return sorted(found, key=lambda e: (e[0], e[2], sorted(e[1].items())))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Learn from ``labels`` (doc_id, toxic) and the texts of ``docs``."""
    labels = labels.select("doc_id", "toxic")
    sample = example_rows(docs, labels, doc_id, text)
    vocabulary = chosen_features(sample)
    counts = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rate = counts.agg(F.avg("toxic").alias("p")).first()["p"]
    examples = examples_of(sample)
    words = sorted(set().union(*(w for _, w, _ in word_examples(examples))))
    idf, word_idf = inverse_frequencies(docs, text, vocabulary, words)
    return ToxicityModel(vocabulary, idf, words, word_idf, examples, float(rate or 0.0))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text: str = "text") -> DataFrame:
    """``docs`` with score and evidence (id, similarity and label of the nearest examples)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        learned = held.value

        def run(raws: list[bytes], batch: pa.RecordBatch) -> list:
            found = [learned.score(raw) for raw in raws]
            return [
                [score for score, _ in found],
                [[{"doc_id": i, "similarity": s, "toxic": y} for i, s, y in near] for _, near in found],
            ]

        return run

    return add_columns(docs, text, FIELDS, start)


def remove_toxic(docs: DataFrame, model: ToxicityModel, *, text: str = "text") -> DataFrame:
    """The documents that score below a half, with their own columns, also those named like a column of the score."""
    own = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    kept = score_toxicity(own, model, text=f"_c{docs.columns.index(text)}").where("score < 0.5").drop(*(f.name for f in FIELDS))
    return kept.toDF(*docs.columns)
