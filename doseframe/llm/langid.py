"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a window of bytes, one from each end (one gate
and a candidate each, without a reset gate); at every byte the two states
together give a probability for each language. Training is
plain numpy: backpropagation through time with Adam, on a bounded sample of
labelled windows. Every byte of every text is labelled, in windows of ``WINDOW``
bytes that together cover the text; a document's probabilities are the pooled
log probabilities of its bytes.

A text that is null or has no letter gives ``und`` and score 0. Other texts get a
learned language; its score is the pooled probability. If no labelled text with
a letter exists, every text is ``und``. Rows are scored each by their own text
alone, so repeated rows agree; ties go to the language that sorts first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doseframe.llm.common import add_columns

WINDOW = 64
HIDDEN = 8
#: The training sample: so many documents of each language at most, by a hash of their text, and so many windows of each.
SAMPLE_DOCUMENTS = 400
SAMPLE_WINDOWS = 6
#: Sections of input tasks that rank their texts before those of a language meet.
SECTIONS = 256
STEPS = 240
BATCH = 384
#: Windows that are scored together.
SCORED = 2048
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"

FIELDS = [
    T.StructField("lang_pred", T.StringType(), False),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("position_counts", T.MapType(T.StringType(), T.LongType(), False), False),
]


def squashed(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), which costs far less than tanh; the input is overwritten."""
    scale = np.abs(x)
    scale += 1
    x /= scale
    return x


@dataclass
class Layer:
    """One direction. Arrays have features first: all values of one feature lie together.

    A state moves to its candidate as far as its gate is open; gate and candidate
    both see the byte and the state before it.
    """

    byte: np.ndarray  # 2h x 256: what each byte adds to gate and candidate
    inner: np.ndarray  # 2h x h

    @staticmethod
    def start(rng: np.random.Generator, h: int) -> Layer:
        return Layer(rng.normal(0, 0.5, (2 * h, 256)).astype(np.float32), rng.normal(0, 0.4, (2 * h, h)).astype(np.float32))

    def steps(self, x: np.ndarray):
        """For each step of x (steps x batch): the state before, gate, candidate, both squashed, and the state after."""
        h = self.inner.shape[1]
        state = np.zeros((h, x.shape[1]), np.float32)
        given = np.empty((2 * h, x.shape[1]), np.float32)
        for row in x:
            both = self.inner @ state
            both += np.take(self.byte, row, axis=1, out=given, mode="clip")
            squashed(both)
            gate = both[:h] * np.float32(0.5)
            gate += np.float32(0.5)
            after = both[h:] - state
            after *= gate
            after += state
            yield state, gate, both, after
            state = after

    def backward(self, x: np.ndarray, kept: list, grads: list[np.ndarray]) -> Layer:
        """Gradients by going back through the steps; grads are by the states."""
        h = self.inner.shape[1]
        inner = np.zeros_like(self.inner)
        carried = np.zeros_like(grads[0])
        by_input = np.empty((2 * h, *x.shape), np.float32)
        for t in reversed(range(len(x))):
            before, gate, both, _ = kept[t]
            d = grads[t] + carried
            slope = (1 - np.abs(both)) ** 2
            slope[:h] *= d * (both[h:] - before) * np.float32(0.5)
            slope[h:] *= d * gate
            by_input[:, t] = slope
            inner += slope @ before.T
            carried = d * (1 - gate) + self.inner.T @ slope
        flat = x.ravel()
        byte = np.stack([np.bincount(flat, weights=row.ravel(), minlength=256) for row in by_input])
        return Layer(byte.astype(np.float32), inner)


class LanguageModel:
    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.ahead, self.back = Layer.start(rng, hidden), Layer.start(rng, hidden)
        self.out = rng.normal(0, 0.3, (2, len(langs), hidden)).astype(np.float32)
        self.bias = np.zeros((len(langs), 1), np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.ahead.byte, self.ahead.inner, self.back.byte, self.back.inner, self.out, self.bias]

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log probability of each language at each byte: steps x languages x batch; x is steps x batch."""
        logs = np.empty((x.shape[0], len(self.langs), x.shape[1]), np.float32)
        for t, (*_, state) in enumerate(self.ahead.steps(x)):
            np.matmul(self.out[0], state, out=logs[t])
            logs[t] += self.bias
        for t, (*_, state) in enumerate(self.back.steps(x[::-1])):
            row = logs[len(x) - 1 - t]
            row += self.out[1] @ state
            row -= row.max(axis=0)
            row -= np.log(np.exp(row).sum(axis=0))
        return logs

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy of all bytes; y is the language of each window."""
        kept_a, kept_b = list(self.ahead.steps(x)), list(self.back.steps(x[::-1]))
        by_out, by_bias = np.zeros_like(self.out), np.zeros_like(self.bias)
        grads_a, grads_b = [], []
        for t in range(len(x)):
            a, b = kept_a[t][3], kept_b[len(x) - 1 - t][3]
            logits = self.out[0] @ a + self.out[1] @ b + self.bias
            p = np.exp(logits - logits.max(axis=0))
            p /= p.sum(axis=0)
            p[y, np.arange(len(y))] -= 1
            p /= x.size
            by_out += np.stack([p @ a.T, p @ b.T])
            by_bias += p.sum(axis=1, keepdims=True)
            grads_a.append(self.out[0].T @ p)
            grads_b.append(self.out[1].T @ p)
        ahead = self.ahead.backward(x, kept_a, grads_a)
        back = self.back.backward(x[::-1], kept_b, grads_b[::-1])
        return [ahead.byte, ahead.inner, back.byte, back.inner, by_out, by_bias]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 3) -> LanguageModel:
        rng = np.random.default_rng(seed)
        parts = self.parts()
        first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        for step in range(1, steps + 1):
            chosen = rng.integers(0, len(y), min(batch, 4 * len(y)))
            rate = 0.02 * min(1.0, 2 * (1 - (step - 1) / steps))
            for p, g, m, v in zip(parts, self.gradients(x[:, chosen], y[chosen]), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def pooled(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text, the pooled probabilities and the number of bytes with each label; every byte counts once."""
        windows, owner, used = [], [], []
        sums = np.zeros((len(texts), len(self.langs)))
        counts = np.zeros((len(texts), len(self.langs)), np.int64)

        def flush() -> None:
            if not windows:
                return
            block = np.frombuffer(b"".join(windows), np.uint8).reshape(len(windows), WINDOW)
            logs = self.log_probs(np.ascontiguousarray(block.T))
            real = np.arange(WINDOW)[:, None] < np.array(used)
            best = logs.max(axis=1)
            for k in range(len(self.langs)):
                one = logs[:, k]
                np.add.at(counts[:, k], owner, ((one == best) & real).sum(axis=0))
                np.add.at(sums[:, k], owner, np.where(real, one, 0).sum(axis=0, dtype=np.float64))
            windows.clear()
            owner.clear()
            used.clear()

        for i, raw in enumerate(texts):
            for at in range(0, len(raw), WINDOW):
                piece = raw[at : at + WINDOW]
                windows.append(piece if len(piece) == WINDOW else piece.ljust(WINDOW))
                owner.append(i)
                used.append(len(piece))
                if len(windows) == SCORED:
                    flush()
        flush()
        out = []
        for i, raw in enumerate(texts):
            mean = sums[i] / max(len(raw), 1) * 8
            p = np.exp(mean - mean.max())
            out.append((p / p.sum(), counts[i]))
        return out


def training_windows(docs: DataFrame, text: str, lang: str, documents: int = SAMPLE_DOCUMENTS, windows: int = SAMPLE_WINDOWS) -> DataFrame:
    """(lang, piece): at most ``documents`` texts of each language, lowest hashes first, and ``windows`` stretches of each."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    width = F.length("text")

    def piece(i: int) -> Column:
        at = (width * F.lit(i / windows)).cast("int")
        return F.substring("text", at + 1, F.lit(WINDOW))

    # Only stretches are ranked, so that neither the shuffle nor the driver sees whole texts.
    short = rows.select("lang", F.xxhash64("text").alias("h"), F.array(*[piece(i) for i in range(windows)]).alias("piece"))

    def lowest(of: DataFrame, *parts: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*parts).orderBy("h", "piece"))
        return of.withColumn("n", place).where(F.col("n") <= documents)

    # Input tasks are ranked in sections first: a language's rows would else all meet in one task.
    sections = lowest(short.withColumn("section", F.spark_partition_id() % SECTIONS), "lang", "section")
    return lowest(sections, "lang").select("lang", F.explode("piece").alias("piece")).where("length(piece) > 0")


def fit_language_model(docs: DataFrame, *, text: str = "text", lang: str = "lang", steps: int = STEPS) -> LanguageModel | None:
    """A model of the languages of ``docs``; None if there is nothing to learn from."""
    rows = [(r["lang"], r["piece"].encode()[:WINDOW]) for r in training_windows(docs, text, lang).collect()]
    if not rows:
        return None
    langs = sorted({name for name, _ in rows})
    x = np.frombuffer(b"".join(raw.ljust(WINDOW) for _, raw in rows), np.uint8).reshape(len(rows), WINDOW).T
    y = np.array([langs.index(name) for name, _ in rows])
    # Every language counts alike, however few windows it has.
    order = np.concatenate([np.resize(np.flatnonzero(y == k), np.bincount(y).max()) for k in range(len(langs))])
    return LanguageModel(langs).fit(np.ascontiguousarray(x[:, order]), y[order], steps)


def identify_language(docs: DataFrame, model: LanguageModel | None, *, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and position_counts (bytes by their own label)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        learned = held.value

        def run(raws: list[bytes], batch: pa.RecordBatch) -> list:
            spoken = [bool(learned) and LETTER.search(raw.decode(errors="replace")) is not None for raw in raws]
            found = iter(learned.pooled([raw for raw, ok in zip(raws, spoken) if ok]) if learned else ())
            names, scores, counts = [], [], []
            for ok in spoken:
                if not ok:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    counts.append([])
                    continue
                p, n = next(found)
                k = int(p.argmax())
                names.append(learned.langs[k])
                scores.append(float(p[k]))
                counts.append([(name, int(c)) for name, c in zip(learned.langs, n) if c])
            return [names, scores, counts]

        return run

    return add_columns(docs, text, FIELDS, start)
