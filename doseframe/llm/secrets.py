"""Secret scans that also look inside encoded text.

Each text is scanned as it stands (the base). Then encoded stretches of every
layer are unwrapped: percent escapes, ``\\u`` escapes, base64, and gzip or zlib
data found inside base64. Every decoded layer is scanned and searched for
further layers until nothing new turns up. A stretch is unwrapped once and
mapped at every place where it occurs; among the layers below one place a
content counts once, so cycles end. All escapes of a layer are decoded together
with the text between them and map character by character, through any number
of layers; a finding there is reported at the span of the text that encodes it.
What is still escaped after ``SEPARATE`` layers is decoded to its end in one sweep,
so that time grows with the text and not with the depth times the text. A finding
has no escape sign in it, so whatever a layer in between would show is there at the
end of the sweep too, unless it borrowed the digits of an escape.
Base64 maps to the whole encoded stretch, and so does all that is found in it.
It may be wrapped over lines; then single lines count as stretches too.

Decoded bytes need not be text: findings are ASCII, so they are looked for
between any bytes, and in text of two or four bytes a character.

Null and empty texts have no findings. Bytes that are not UTF-8 count as replacement characters, as in
Python's ``decode(errors="replace")``. Repeated rows are scanned each. Whole
texts are scanned whatever their length, and so are compressed data: all their
members, in steps, so that memory is bounded. A bomb takes time in proportion
to what it unpacks to. Only an unbroken stretch of more than ``STRETCH_BYTES``
inside compressed data is decoded in parts.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from doseframe.llm.common import add_columns

#: Compressed data are unpacked and scanned in steps of so many bytes, or up to the next place where they can be cut,
#: but in one unbroken stretch of base64 or blanks for so many bytes at most.
STEP = 16 << 20
STRETCH_BYTES = 256 << 20
#: Layers of escapes that are scanned one by one; deeper ones are decoded together.
SEPARATE = 8

# The patterns of the three kinds, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
# A run that is long enough is matched whole, from its start, with the least length in the pattern or without.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_VALUE = 8

# Runs of percent escapes, and single \u escapes or surrogate pairs of them.
ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Base64 over lines: one that ends with its run, and those that follow it (not the dashes of a footer).
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?=[ \t]*[\r\n])")
LINE = re.compile(r"[ \t]*(?:\r\n?|\n)[ \t]*(?!--)([A-Za-z0-9+/_-]+)(?=[ \t]*(?:[\r\n]|$)|[=\"'<>,;)\]}])")
PAD = re.compile(r"={0,2}")
BLANKS = re.compile(r"\s+")
WIDE = re.compile(r"[\t-\r -~](?:\0{1,3}[\t-\r -~]){13,}")
#: What may be inside a finding, an encoded stretch or wide text; data are cut after anything else.
JOINED = bytes({*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-\"':%\\ \t\r\n\0"})
#: Characters of the shortest finding.
LEAST = 14

Finding = tuple[int, int, int]

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType(), False),
            T.StructField("start", T.IntegerType(), False),
            T.StructField("end", T.IntegerType(), False),
        ]
    ),
    False,
)


def scan(text: str) -> list[Finding]:
    """(start, number of the kind, end) of every finding in one layer, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def packed(data: bytes) -> bool:
    """Whether data start like gzip or zlib."""
    return data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0)


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Members of compressed data, one after the other, in steps; what is broken or not compressed as it stands."""
    data = b""
    while True:
        while len(data) < 3 and (more := next(chunks, None)) is not None:
            data = (data + more).lstrip(b"\0")
        if not packed(data):
            break
        first, unwrap = data, zlib.decompressobj(47)
        try:
            while not unwrap.eof:
                if step := unwrap.decompress(data, STEP):
                    yield step
                data = unwrap.unconsumed_tail
                if not data and not step and not unwrap.eof:
                    data = next(chunks)
        except (zlib.error, StopIteration):
            data = first
            break
        data = unwrap.unused_data.lstrip(b"\0")
    # No finding reaches over from a member into what is not compressed.
    if data:
        yield b"\0" + data
    yield from chunks


def unpacked(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Data through any number of compressed layers, in steps; a layer that starts like one around it stays as it is."""
    seen: set[bytes] = set()
    while True:
        # Small layers are held whole, so that calls do not nest.
        head = b""
        while len(head) < STEP and (more := next(chunks, None)) is not None:
            head += more
        chunks = iter([head]) if len(head) < STEP else itertools.chain([head], chunks)
        name = hashlib.blake2b(head, digest_size=16).digest()
        if not packed(head) or name in seen:
            return chunks
        seen.add(name)
        chunks = inflated(chunks)


def readable(chunks: Iterator[bytes]) -> Iterator[str]:
    """Data as text, cut only where no finding and no encoded stretch can be. Findings are ASCII, so any bytes will do.

    Text of two or four bytes a character follows without its zero bytes.
    """
    data = b""
    for chunk in itertools.chain(chunks, [None]):
        data += chunk or b""
        at = len(data)
        if chunk is not None:
            if len(data) < STEP:
                continue
            at = len(data.rstrip(JOINED)) or (at if at >= STRETCH_BYTES else 0)
        text, data = data[:at].decode("latin-1"), data[at:]
        if text:
            yield text
            if wide := "\n\n".join(m[0].replace("\0", "") for m in WIDE.finditer(text)):
                yield wide


def unbase64(chunk: str) -> bytes:
    body = BLANKS.sub("", chunk).rstrip("=").translate({45: "+", 95: "/"})
    # One character too many says nothing.
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def stretches(text: str) -> set[tuple[int, int]]:
    """Where base64 is: runs, and blocks of lines of one length with a shorter last one and a first one of any length."""
    found = {m.span() for m in BASE64.finditer(text)}
    if "\n" not in text and "\r" not in text:
        return found
    at = 0
    while m := WRAPPED.search(text, at):
        at = m.end()
        lines, sizes = [m.start()], [at - m.start()]
        while follows := LINE.match(text, at):
            size = follows.end(1) - follows.start(1)
            if len(lines) > 1 and size > sizes[-1]:
                break
            lines.append(follows.start(1))
            sizes.append(size)
            at = follows.end(1)
            if size < sizes[-2]:
                found.add((lines[0], with_pad(text, at)))
                if len(lines) > 2:
                    break
        if len(lines) > 1:
            found.add((lines[0], with_pad(text, at)))
        # A first line of another length may be other text.
        if len(lines) > 2 and sizes[0] != sizes[1]:
            found.add((lines[1], with_pad(text, at)))
        # A shorter line may begin the next block.
        at = max(m.end(), lines[-1])
    return found


def with_pad(text: str, at: int) -> int:
    return at + len(PAD.match(text, at)[0])


def characters(run: str) -> list[tuple[str, int]]:
    """The characters of a run of escapes, each with the length of its escapes."""
    if run[0] == "%":
        raw = bytes.fromhex(run.replace("%", ""))
        try:
            return [(c, 3 * len(c.encode())) for c in raw.decode()]
        except UnicodeDecodeError:
            return [(chr(b), 3) for b in raw]
    code = int(run[2:6], 16)
    if len(run) == 12:
        code = 0x10000 + ((code - 0xD800) << 10) + int(run[8:], 16) - 0xDC00
    return [(chr(code) if not 0xD800 <= code < 0xE000 else "\N{REPLACEMENT CHARACTER}", len(run))]


def unescaped(text: str) -> tuple[str, array, array]:
    """Percent and ``\\u`` escapes decoded once; for each character its start and end in the layer above."""
    out: list[str] = []
    starts, ends = array("i"), array("i")
    at = 0
    for run in ESCAPES.finditer(text):
        out.append(text[at : run.start()])
        starts.extend(range(at, run.start()))
        ends.extend(range(at + 1, run.start() + 1))
        at = run.start()
        for c, width in characters(run[0]):
            out.append(c)
            starts.append(at)
            at += width
            ends.append(at)
    out.append(text[at:])
    starts.extend(range(at, len(text)))
    ends.extend(range(at + 1, len(text) + 1))
    return "".join(out), starts, ends


HEXADECIMAL = frozenset("0123456789abcdefABCDEF")


def settled(text: str) -> tuple[str, array, array]:
    """Escapes decoded until none is left, also those that only decoding completes; places as in ``unescaped``.

    One pass over the text: a character that completes an escape takes its place, and may complete the one before it.
    Bytes and surrogates beyond ASCII stay single characters, since no finding and no escape has them.
    """
    out: list[str] = []
    starts, ends = array("i"), array("i")
    for i, c in enumerate(text):
        out.append(c)
        starts.append(i)
        ends.append(i + 1)
        while out[-1] in HEXADECIMAL and len(out) > 2 and out[-2] in HEXADECIMAL:
            if out[-3] == "%":
                size = 3
            elif len(out) > 5 and out[-6] == "\\" and out[-5] == "u" and out[-4] in HEXADECIMAL and out[-3] in HEXADECIMAL:
                size = 6
            else:
                break
            code = int("".join(out[-2:] if size == 3 else out[-4:]), 16)
            last = ends[-1]
            del out[1 - size :], starts[1 - size :], ends[1 - size :]
            out[-1] = chr(code) if not 0xD800 <= code < 0xE000 else "\N{REPLACEMENT CHARACTER}"
            ends[-1] = last
    return "".join(out), starts, ends


class Hidden:
    """Kinds of findings in encoded stretches; a stretch is unwrapped once, however often it occurs."""

    def __init__(self) -> None:
        self.reached: dict[str, frozenset[int]] = {}

    def kinds(self, code: str) -> frozenset[int]:
        """Kinds of all findings in a base64 stretch and in the layers below it; its characters have no places of their own."""
        if code not in self.reached:
            found: set[int] = set()
            work = [unbase64(code)]
            seen = {hashlib.blake2b(work[0], digest_size=16).digest()}
            while work and len(found) < len(KINDS):
                data = work.pop()
                if len(data) < LEAST and not packed(data):
                    continue
                for layer in readable(unpacked(iter([data]))):
                    for depth in itertools.count(1):
                        found.update(kind for _, kind, _ in scan(layer))
                        for a, b in stretches(layer):
                            inner = unbase64(layer[a:b])
                            name = hashlib.blake2b(inner, digest_size=16).digest()
                            if name not in seen:
                                seen.add(name)
                                work.append(inner)
                        if not ESCAPES.search(layer):
                            break
                        if depth < SEPARATE:
                            layer = ESCAPES.sub(lambda m: "".join(c for c, _ in characters(m[0])), layer)
                        else:
                            layer = settled(layer)[0]
            self.reached[code] = frozenset(found)
        return self.reached[code]


def hidden(text: str) -> set[Finding]:
    """Findings in decoded layers, at their spans of the text."""
    found: set[Finding] = set()
    codes = Hidden()
    layer, starts, ends = text, None, None
    for depth in itertools.count(1):
        for a, b in stretches(layer):
            if kinds := codes.kinds(layer[a:b]):
                s, e = (a, b) if starts is None else (starts[a], ends[b - 1])
                found.update((s, kind, e) for kind in kinds)
        # Escapes get shorter when decoded, so this ends.
        if not ESCAPES.search(layer):
            return found
        layer, firsts, lasts = (unescaped if depth < SEPARATE else settled)(layer)
        if starts is not None:
            firsts, lasts = array("i", (starts[a] for a in firsts)), array("i", (ends[b - 1] for b in lasts))
        starts, ends = firsts, lasts
        found.update((starts[s], kind, ends[e - 1]) for s, kind, e in scan(layer))


def find_secrets(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: findings of the text itself, and these with the ones from decoded
    layers; code points, end exclusive, ordered by start, kind, end."""

    def named(found) -> list[dict]:
        return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(found)]

    def start():
        def run(raws: list[bytes], batch: pa.RecordBatch) -> list:
            base, spans = [], []
            for raw in raws:
                content = raw.decode(errors="replace")
                plain = scan(content)
                base.append(named(plain))
                deep = hidden(content)
                spans.append(named({*plain, *deep}) if deep else base[-1])
            return [base, spans]

        return run

    return add_columns(docs, text, [T.StructField("base", SPANS, False), T.StructField("spans", SPANS, False)], start)
