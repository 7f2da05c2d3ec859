"""Plain versions of the operators, over lists of (doc_id, text)."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def alnum_words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def blank_words(text, lower=False):
    return BLANK.findall((text or "").translate(LOWER) if lower else text or "")


def contamination(docs, items, n=13):
    windows = defaultdict(set)
    for item, text in items:
        words = alnum_words(text)
        size = min(n, len(words))
        if not size:
            continue
        for i in range(len(words) - size + 1):
            windows[tuple(words[i : i + size])].update([] if item is None else [str(item)])
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = alnum_words(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                names = windows.get(tuple(words[i : i + size]))
                if names is not None:
                    hit.update(range(i, i + size))
                    found |= names
        out.append((doc, len(words), len(hit), sorted(found)))
    return out


def repeats(docs, window=35):
    starts = Counter()
    lists = [(doc, blank_words(text)) for doc, text in docs]
    for _, words in lists:
        starts.update(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    out = []
    for doc, words in lists:
        gone = set()
        for i in range(len(words) - window + 1):
            if starts[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def shingle_set(text, n=3):
    words = blank_words(text, lower=True)
    size = min(n, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if size else frozenset()


def jaccard(docs, threshold=90, shingle=3):
    """(doc, n_shingles, component, links) per row, all pairs."""
    sets = [shingle_set(text, shingle) for _, text in docs]
    parent, degree = list(range(len(docs))), [0] * len(docs)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                parent[top(i)] = top(j)
                degree[i] += 1
                degree[j] += 1
    least = {}
    for i, (doc, _) in enumerate(docs):
        ids = [x for x in (doc, least.get(top(i))) if x is not None]
        least[top(i)] = min(ids) if ids else None
    return [(doc, len(sets[i]), least[top(i)], degree[i]) for i, (doc, _) in enumerate(docs)]
