"""Hashes of words and word shingles, in numpy."""

from __future__ import annotations

import numpy as np

FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are hashed at a time, so that the arrays stay in cache.
PIECE = 1 << 18
BLANKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_values = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_inverse = pow(int(FACTOR), -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def blank_word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between blanks of all texts, one after the other, and the number of each text's words.

    A word's hash is a sum over its bytes that does not depend on its place, so
    all words of a piece are hashed by a handful of array operations.
    """
    joined = b" ".join([*raws, b""])
    codes = np.frombuffer(joined, np.uint8)
    blank = BLANKS[codes]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank])))
    starts, ends = edge[::2], edge[1::2]
    texts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])]).astype(np.int64)
    counts = np.diff(np.searchsorted(starts, texts))
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, "right")))
        low, high = int(starts[first]), int(ends[last - 1])
        up, down = _powers(high - low + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_values[codes[low:high]] * up[: high - low])])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (total[e] - total[s]) * down[s]
        first = last
    return mixed(out), counts


_kept: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse; those for ordinary pieces are kept."""
    if not _kept:
        _kept.append((powers(int(FACTOR), PIECE + 1), powers(_inverse, PIECE + 1)))
    return _kept[0] if n <= PIECE + 1 else (powers(int(FACTOR), n), powers(_inverse, n))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer of a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` words, by doubling: a run of 2k words is made of two of k."""
    size = len(hashes) - n + 1
    if size < 1:
        return np.empty(0, np.uint64)
    out, done, part, length = np.full(size, (seed * 2 + n) & 0xFFFFFFFF, np.uint64), 0, hashes, 1
    while True:
        scale = np.uint64(pow(int(FACTOR), length, 1 << 64))
        if n & length:
            out = out * scale + part[done : done + size]
            done += length
        if done == n:
            return mixed(out)
        part = part[:-length] * scale + part[length:]
        length *= 2


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` neighbours."""
    out, done, part, length = None, 0, values, 1
    size = len(values) - n + 1
    while done < n:
        if n & length:
            here = part[done : done + size]
            out = here if out is None else np.minimum(out, here)
            done += length
        if done < n:
            part = np.minimum(part[:-length], part[length:])
            length *= 2
    return out


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
