import random
import tracemalloc

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from doseframe.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(texts):
    library = Tokenizer.from_file(PATH)
    out = []
    for text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((ids, library.decode(ids, skip_special_tokens=False)))
    return out


def strange(rng, n):
    latin = [chr(c) for c in range(0x250)] + list("'strvmld<|>endoftext 12 Aa\n") * 6
    wide = latin + [chr(rng.randrange(0x250, 0x3000)) for _ in range(200)] + ["😀", "é", "Σ", "ς", "İ", "　", "中"]
    ends = ["", "", "<|endoftext|>", "<|startoftext|>x's", "<|endoftext|", "<|ENDOFTEXT|>"]
    return "".join(rng.choice(rng.choice([latin, wide])) for _ in range(n)) + rng.choice(ends)


def test_words_and_ids_agree_with_the_library():
    rng = random.Random(5)
    split, encoder, pieces = bpe.Splitter(PATH), bpe.Encoder(PATH), bpe.Pieces(PATH)
    texts = [strange(rng, rng.randrange(40)) for _ in range(1500)]
    for text, (ids, decoded) in zip(texts, expected(texts)):
        words = split.words(text)
        got = [i for each in (encoder.encode(words) if words else []) for i in each]
        assert (got, pieces.decode(got)) == (ids, decoded), repr(text)


def test_table_gives_whole_texts(table, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP_BYTES", 20_000)
    rng = random.Random(8)
    docs = [(i, strange(rng, rng.randrange(300))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \n\t"), (203, "word " * 60_000), (204, "x" * 3000), (None, "null id"), (3, docs[3][1]), (3, docs[3][1])]
    rows = bpe.encode(table(docs), PATH).collect()
    got = sorted(((r.doc_id, r.text, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in rows), key=str)
    want = [(d, t, ids, decoded) for (d, t), (ids, decoded) in zip(docs, expected([t for _, t in docs]))]
    assert got == sorted(want, key=str)


def test_no_rows_and_clashing_columns(table):
    assert bpe.encode(table([]), PATH).collect() == []
    out = bpe.encode(table([(1, "a b")]).withColumnRenamed("lang", "IDS").withColumnRenamed("source", "_rows"), PATH)
    assert out.columns == ["doc_id", "text", "_rows", "n_chars", "ids", "decoded"]
    assert out.first()["decoded"] == "a</w> b</w>"


def test_ids_of_a_range_are_held_packed():
    encoder, words = bpe.Encoder(PATH), [f"word{i}x" for i in range(20_000)]
    encoder.encode_packed(words[:10])
    tracemalloc.start()
    known = dict(zip(words, encoder.encode_packed(words)))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert bpe.unpacked_ids(bpe.packed_ids([*known.values()]), len(words)) == [*known.values()]
    assert [np.frombuffer(b, np.uint32).tolist() for b in known.values()] == encoder.encode(words)
    assert held / len(words) < 150
