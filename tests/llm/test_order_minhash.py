import hashlib
import random

import numpy as np

from doseframe.llm import order_minhash as om


def brute_next(docs):
    order = sorted(range(len(docs)), key=lambda i: docs[i][0], reverse=True)
    out = {}
    for place, i in enumerate(order):
        text, following = docs[i][1] or "", docs[order[(place + 1) % len(order)]][1] or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        signs = [om.signature(t) for t in (text, changed, following)]
        out[docs[i][0]] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), (signs[0] == signs[1]).mean(), (signs[0] == signs[2]).mean())
    return out


def test_every_document_meets_the_next(table, monkeypatch):
    monkeypatch.setattr(om, "PARTITION_BYTES", 300)
    rng = random.Random(1)
    docs = [(i * 7, "".join(rng.choice("abcñ 😀") for _ in range(rng.randrange(60)))) for i in range(80)]
    docs += [(1000, None), (1001, ""), (1002, "abc" * 50_000)]
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in om.near_next(table(docs)).collect()}
    assert got == brute_next(docs)


def test_no_rows_one_row_and_repeats(table):
    assert om.near_next(table([])).collect() == []
    one = om.near_next(table([(4, "only one text")])).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(4, 1.0)]
    many = om.near_next(table([(1, "a text"), (1, "a text"), (None, "a text"), (2, "other")])).collect()
    assert len(many) == 4 and len({r.fingerprint for r in many if r.doc_id != 2}) == 1
    assert om.fingerprints(table([(1, "x")]).withColumnRenamed("lang", "Fingerprint")).columns[-1] == "fingerprint"


def test_repeated_kmers_are_numbered():
    kmers = om.numbered_kmers(np.frombuffer("abababababab".encode("utf-32-le"), np.uint32))
    assert len(kmers) == 7 and len(set(kmers.tolist())) == 7
    again = om.numbered_kmers(np.frombuffer("abababababcc".encode("utf-32-le"), np.uint32))
    assert kmers[:5].tolist() == again[:5].tolist()


def test_likeness_falls_with_edits_and_with_order():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    text = " ".join(words)
    few = " ".join(w if i % 40 else "changed" for i, w in enumerate(words))
    many = " ".join(w if i % 4 else "changed" for i, w in enumerate(words))
    moved = " ".join(words[200:] + words[:200])
    sign = om.signature(text)
    near = [om.likeness(sign, om.signature(t)) for t in (text, few, many, moved)]
    assert near[0] == 1 and near[0] > near[1] > near[2] and near[3] < 0.8
