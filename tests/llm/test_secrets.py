import base64
import gzip
import random
import re
import time
import urllib.parse
import zlib
from array import array

from doseframe.llm import secrets

KEY = "AKIA" + "Q7Z2" * 4
WORDS = ["password", "PASSWD", "secret", "token", "api_key", "ApiKey", ": ", "=", '"', "'", " ", "short", "longenough1", KEY, "AKIA12", "0a" * 16, "0a" * 15, "ſecret", "\n", "ñ", "%41", "\\u0041"]


def brute(text):
    """The base by the plain definition: every match, then those too short dropped."""
    found = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def deep(text):
    return {(text[s:e], k) for s, k, e in secrets.hidden(text)}


def test_base_matches_the_definition():

    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(WORDS) for _ in range(rng.randrange(12)))
        assert secrets.scan(text) == brute(text), text


def test_nested_layers():
    line = f"password={KEY}"
    b64 = base64.b64encode(line.encode()).decode()
    url = "".join(f"%{b:02X}" for b in line.encode())
    uni = "".join(f"\\u{ord(c):04x}" for c in line)
    packed = base64.b64encode(gzip.compress(line.encode())).decode()
    twice = base64.b64encode(zlib.compress(base64.b64encode(line.encode()))).decode()
    for code in (b64, packed, twice, base64.urlsafe_b64encode(line.encode()).decode()):
        text = f"see {code} there"
        assert deep(text) == {(code, 0), (code, 1)}, code
    for code in (url, uni):
        # Escapes map character by character.
        text = f"ñ see {code} there"
        assert {t for t, k in deep(text) if k == 1} == {code[-len(code) * len(KEY) // len(line):]}
    quoted = urllib.parse.quote(b64 + "==", safe="")
    assert any(k == 1 for _, k in deep(f"x {quoted} y"))
    assert any(k == 1 for _, k in deep("x " + "".join(f"%{b:02x}" for b in uni.encode())))


def test_cycles_and_noise_end():
    assert secrets.hidden("%2525252525") == set()
    assert secrets.hidden("%25" * 2000 + "41") == set()
    assert secrets.hidden("A" * 4000) == set()
    assert secrets.hidden("\\ud800 %ff %zz \\u12") == set()
    bomb = base64.b64encode(gzip.compress(b"z" * 3_000_000)).decode()
    assert secrets.hidden(bomb) == set()


def test_deep_escapes_take_linear_time():
    start = time.monotonic()
    hidden = f"secret={KEY}"
    left = "%" + "25" * 200_000 + "41"
    right = "%3" * 200_000 + "%31"
    mixed = "%5cu0025" * 3 + "%" + "5cu0025" * 60_000 + "41"
    for text in (left, right, mixed):
        secrets.hidden(text)
    deep = f"secret=A%{'25' * 100_000}4b" + KEY
    found = {(k, e) for _, k, e in secrets.hidden(deep)}
    assert (0, len(deep)) in found
    inside = base64.b64encode(f"x %{'25' * 5000}{hidden[0].encode().hex()}{hidden[1:]}".encode()).decode()
    assert any(k == 0 for _, k in deep_kinds(f"see {inside} there"))
    assert time.monotonic() - start < 20


def deep_kinds(text):
    return {(s, k) for s, k, _ in secrets.hidden(text)}


def test_settled_is_the_fixpoint_of_layers():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice(["%", "2", "5", "41", "\\", "u00", "5c", "%25", "\\u0025", "x", "3"]) for _ in range(rng.randrange(25)))
        layer, starts, ends = text, range(len(text)), range(1, len(text) + 1)
        while secrets.ESCAPES.search(layer):
            layer, a, b = secrets.unescaped(layer)
            starts, ends = [starts[i] for i in a], [ends[i - 1] for i in b]
        assert secrets.settled(text) == (layer, array("i", starts), array("i", ends)), text


def test_same_code_at_many_places():
    line = f"password={KEY}"
    b64 = base64.b64encode(line.encode()).decode()
    url = "".join(f"%{b:02X}" for b in line.encode())
    quoted = "".join(f"%{b:02X}" for b in b64.encode())
    outer = base64.b64encode(f"x {b64} y {b64}".encode()).decode()
    text = f"{b64} a {b64} {url} b {url} {quoted} c {outer} {outer}"
    want = set()
    for code in (b64, quoted, outer):
        want |= {(m.start(), kind, m.end()) for m in re.finditer(re.escape(code), text) for kind in (0, 1)}
    for m in re.finditer(re.escape(url), text):
        want |= {(m.start(), 0, m.end()), (m.end() - 3 * len(KEY), 1, m.end())}
    assert secrets.hidden(text) == want


def test_findings_cross_blanks_between_escapes():
    quoted = r"\u0022password\u0022: \u0022hunter2hunter2\u0022"
    assert deep(f"see {quoted} there") == {(quoted.removeprefix(r"\u0022").removesuffix(r"\u0022"), 0)}
    assert deep("x token%3A abcdefgh12 y") == {("token%3A abcdefgh12", 0)}
    # Blanks inside deeper layers.
    code = base64.b64encode(b"x token%3A abcdefgh12 y").decode()
    assert deep(f"see {code}") == {(code, 0)}
    assert deep("a tok%2565n%3A abcdefgh12 b") == {("tok%2565n%3A abcdefgh12", 0)}
    # Pairs of surrogates are one character, lone ones too.
    assert secrets.unescaped(r"\ud83d\ude00a%C3%B1\ud800b")[0] == "\U0001f600a\u00f1\ufffdb"


def test_all_of_compressed_wrapped_and_mixed_layers(monkeypatch):
    line = f"password={KEY}".encode()
    both = {0, 1}

    def kinds(data):
        code = base64.b64encode(data).decode()
        found = secrets.hidden(f"see {code} there")
        assert {(s, e) for s, _, e in found} <= {(4, 4 + len(code))}
        return {k for _, k, _ in found}

    # Further members, text after them, broken ends, and many layers.
    assert kinds(gzip.compress(b"first, ") + gzip.compress(line)) == both
    assert kinds(gzip.compress(b"pass") + gzip.compress(line[4:])) == both
    assert kinds(gzip.compress(b"first") + b"\0\0" + line) == both
    assert kinds(gzip.compress(line)[:-6]) == both
    assert kinds(b"80 " + line) == both and kinds(b"80t" + line) == both
    deepest = line
    for _ in range(1500):
        deepest = zlib.compress(deepest, 0)
    assert kinds(deepest) == both
    # Bytes that are not text around it, and text of two bytes a character.
    assert kinds(b"\x00\xff\x01" + line + b"\x02\xfe") == both
    assert kinds(line.decode().encode("utf-16")) == both
    assert kinds(gzip.compress(line.decode().encode("utf-16-be"))) == both
    # Lines.

    noise = bytes(random.Random(3).randrange(256) for _ in range(300))
    packed = gzip.compress(noise + line)
    for raw in (packed, b"x" * 50 + line + b"y" * 90):
        mime = base64.encodebytes(raw).decode().rstrip()
        for block in (mime, mime.replace("\n", "\r\n"), mime.replace("\n", "\n    ")):
            for text in (f"a\n\n{block}\n\nend", f"-----BEGIN CERTIFICATE-----\n{block}\n-----END CERTIFICATE-----", f'x="{block}", y'):
                assert {(text[s:e], k) for s, k, e in secrets.hidden(text)} >= {(block, 0), (block, 1)}, text
    # Long data in small steps, with a finding on every place of a step's edge and nothing else in the text.
    monkeypatch.setattr(secrets, "STEP", 64)
    for n in range(80):
        assert kinds(gzip.compress(b"," * n + line + b"," * 500)) == both
        inner = base64.b64encode(b"x," * n + line + b"z" * 100)
        assert kinds(gzip.compress(b"," * n + inner + b"," * 200)) == both
        assert kinds(gzip.compress(gzip.compress(noise) + gzip.compress(b"," * n + line))) == both


def test_operator(table):
    line = f"token = {KEY}"
    docs = [(1, line), (2, base64.b64encode(line.encode()).decode()), (3, None), (4, ""), (None, "f" * 40), (1, line), (5, "x" * 200_000 + line)]
    rows = secrets.find_secrets(table(docs).withColumnRenamed("lang", "BASE")).collect()
    got = sorted((r.doc_id or 0, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in rows)
    plain = [("assign", 0, 28), ("access", 8, 28)]
    code = [("assign", 0, 40), ("access", 0, 40)]
    far = [(k, s + 200_000, e + 200_000) for k, s, e in plain]
    assert got == sorted([(1, plain, plain), (2, [], code), (3, [], []), (4, [], []), (0, [("hex", 0, 40)], [("hex", 0, 40)]), (1, plain, plain), (5, far, far)])
    assert secrets.find_secrets(table([])).collect() == []
