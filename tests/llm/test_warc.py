import base64
import glob
import gzip
import hashlib
import os
import random

from compare import actual, connect, differences, expected
from doseframe.llm import warc
from doseframe.llm.oracles import ORACLES
from doseframe.llm.queries import QUERIES


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def round_trip(spark, rows, path, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_warc(pages, path, **options)
    return warc.read_warc(spark, path).collect()


def test_round_trip(spark, tmp_path):
    rows = [(1, "u1", "same"), (5, "u5", "same"), (3, None, "same"), (2, "u2", "ñ\r\n\r\nWARC/1.1\r\n\x00"), (4, "u 4\r\nX: y", None), (6, "u6", ""), (7, "u7", "z" * 500_000)]
    rows += [(None, "n", "lone"), (None, "n", "same"), (8, "t", "twin"), (8, "t", "twin")]
    path = str(tmp_path / "a")
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in round_trip(spark, rows, path, archive_records=2)}
    want = set()
    for page, _, html in rows:
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        top = max(ids, default=None)
        revisit = top is not None and page != top
        want.add((page, len((html or "").encode()), digest(html), "revisit" if revisit else "response", top if revisit else None))
    assert got == want
    records = warc.read_warc(spark, path).collect()
    assert len(records) == len(rows) and all(r.problem is None for r in records)
    assert {bytes(r.payload).decode() for r in records if r.record_type == "response"} == {h or "" for _, _, h in rows}
    # The files are plain gzip, one record to a member that holds anything.
    for file in glob.glob(path + "/part-*"):
        data = open(file, "rb").read()
        contents = [c for c, problem in warc.members(data)]
        assert gzip.decompress(data) == b"".join(contents) and all(c.startswith(b"WARC/1.1\r\n") for c in contents)


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "u", "".join(rng.choices("0123456789abcdef", k=2000 if i else 30_000))) for i in range(40)]
    path = str(tmp_path / "a")
    got = round_trip(spark, rows, path, archive_bytes=5000)
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {i: h for i, _, h in rows} and len(got) == 40
    sizes = sorted(os.path.getsize(f) for f in glob.glob(path + "/part-*"))
    # Only the record that is larger by itself is beyond the bound; the separator comes on top.
    assert sizes[-2] <= 5000 + len(warc.EMPTY_MEMBER) < sizes[-1] and len(sizes) < 30


def test_short_payloads_are_not_revisited(spark, tmp_path):
    got = round_trip(spark, [(1, "", "ab"), (2, "", "ab"), (3, "", "abc"), (4, "", "abc")], str(tmp_path / "a"), revisit_bytes=3)
    assert {(r.page_id, r.record_type) for r in got} == {(1, "response"), (2, "response"), (3, "revisit"), (4, "response")}


def test_damage_is_named_and_reading_goes_on():
    records = [warc.member(warc.record_bytes(i, "u", b"payload %d" % i * 50, None)) for i in range(3)]
    whole = [warc.parsed(*m) for m in warc.members(b"".join(records))]
    assert [r["page_id"] for r in whole] == [0, 1, 2] and not any(r["problem"] for r in whole)
    torn = bytearray(records[1])
    torn[30:40] = bytes(10)
    got = [warc.parsed(*m) for m in warc.members(records[0] + bytes(torn) + records[2])]
    assert got[0]["problem"] is None and got[-1]["page_id"] == 2 and got[-1]["problem"] is None and any(r["problem"] for r in got)
    assert list(warc.members(records[0][:-9]))[0][1] == "truncated gzip member"
    other = warc.record_bytes(1, "u", b"abc", None).replace(b"abc", b"abd")
    assert warc.parsed(other, None)["problem"] == "digest does not match"
    assert warc.parsed(other[:-3], None)["problem"] == "length does not match"


def test_no_pages(spark, tmp_path):
    assert round_trip(spark, [], str(tmp_path / "a")) == []


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert differences(actual(QUERIES["op5_warc"](spark, sf)), expected(connect(sf), ORACLES["op5_warc"])) == []
