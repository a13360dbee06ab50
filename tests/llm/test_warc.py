import base64
import gzip
import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lakewright.llm import warc
from lakewright.llm.files import write_file
from lakewright.llm.queries import op10
from lakewright.session import scratch_path
from lakewright.sources.tables import table


def expected_rows(rows):
    first = defaultdict(list)
    for i, _, h in rows:
        if i is not None:
            first[h or ""].append(i)
    out = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        refers = min(first[h or ""], default=None) if i is not None else None
        refers = refers if refers != i else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out[i, len(data), digest, "response" if refers is None else "revisit", refers] += 1
    return out


def test_pages(spark, folder):
    rows = [(r.page_id, r.url, r.html) for r in table(spark, folder, "pages").collect()]
    assert Counter(tuple(r) for r in op10(spark, folder).collect()) == expected_rows(rows)


def test_hard_rows(spark):
    rows = [
        (5, "http://a/ö b", "same"), (3, None, "same"), (4, "u\r\nX: y", "same"), (3, "u", "same"), (None, "u", "same"), (7, "u", None),
        (8, "u", ""), (9, "u", "WARC/1.1\r\n\r\n" + "é" * 70000), (10, "u", "\r\n\r\n\x1f\x8b\x08"), (-2, "u", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1))
    records = warc.read_archives(spark, warc.write_archives(pages)).cache()
    assert records.where("kind = 'gap'").count() == 0
    assert Counter(tuple(r) for r in warc.page_records(records).collect()) == expected_rows(rows)
    payloads = {r.record_id: r.payload for r in records.where("record_type = 'response'").collect()}
    assert bytes(payloads["<urn:page:9>"]).decode() == rows[7][2]
    short = warc.page_records(warc.read_archives(spark, warc.write_archives(pages, min_bytes=1))).collect()
    assert {r.page_id: r.record_type for r in short if r.page_id in (7, 8)} == {7: "response", 8: "response"}
    none = warc.write_archives(pages.limit(0))
    assert warc.read_archives(spark, none).count() == 0


def one(i, body=b"payload"):
    return warc.record(i, "http://x", body, None, warc.base32_sha1(body))


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    wrap = gzip.compress if packed else bytes
    parts = [wrap(one(i, bytes([65 + i]) * 300)) for i in range(5)]
    whole = b"".join(parts)
    kinds = lambda data: [(k, a, n) for k, a, n, _ in warc.salvage(data)]
    starts = [sum(map(len, parts[:i])) for i in range(6)]
    assert kinds(whole) == [("record", starts[i], len(parts[i])) for i in range(5)]
    broken = bytearray(whole)
    broken[starts[2] + len(parts[2]) // 2] ^= 0xFF
    assert kinds(bytes(broken)) == [
        ("gap" if i == 2 else "record", starts[i], len(parts[i])) for i in range(5)
    ]
    cut = whole[: starts[4] + 40]
    assert kinds(cut)[-1] == ("gap", starts[4], 40)
    junk = parts[0] + b"junk in between" + parts[1]
    assert kinds(junk) == [("record", 0, len(parts[0])), ("gap", len(parts[0]), 15), ("record", len(parts[0]) + 15, len(parts[1]))]
    lost = b"xyz" + whole[starts[1] + 20 :]
    assert [k for k, *_ in warc.salvage(lost)] == ["gap", "record", "record", "record"]
    assert kinds(b"") == [] and kinds(b"no archive") == [("gap", 0, 10)]


def ids(data):
    return [what["record_id"] for kind, _, _, what in warc.salvage(data) if kind == "record"]


def test_salvage_inside_members():
    both = gzip.compress(one(1) + one(2)) + gzip.compress(one(3))
    assert ids(both) == [f"<urn:page:{i}>" for i in (1, 2, 3)]
    assert [k for k, *_ in warc.salvage(both)] == ["record"] * 3
    damaged = gzip.compress(one(1) + b"?" * 40 + one(2)) + gzip.compress(one(3))
    assert [k for k, *_ in warc.salvage(damaged)] == ["record", "record", "gap", "record"]
    assert ids(damaged) == [f"<urn:page:{i}>" for i in (1, 2, 3)]
    old = one(1).replace(b"WARC/1.1", b"WARC/0.18")
    assert ids(old + one(2)) == ids(gzip.compress(old) + one(2)) == ["<urn:page:1>", "<urn:page:2>"]


def test_salvage_head_of_a_broken_member():
    noise = b"".join(hashlib.sha256(bytes([i])).digest() for i in range(200))
    for level in (0, 6):
        first, many = gzip.compress(one(1), level), gzip.compress(one(2) + one(3, noise) + one(4, noise[::-1]), level)
        cut = first + many[: len(many) * 3 // 4] + first
        assert ids(cut) == [f"<urn:page:{i}>" for i in (1, 2, 3, 1)]
        (gap, start, *_), (kind, at, *_) = list(warc.salvage(cut))[-2:]
        assert (gap, kind, at) == ("gap", "record", len(cut) - len(first))
        assert start == len(first) or level == 0  # unpacked blocks show their records at their place
    checksum = bytearray(gzip.compress(one(5)))
    checksum[-6] ^= 1
    assert ids(bytes(checksum)) == []
    assert ids((gzip.compress(one(4) + one(5)) + gzip.compress(one(6)))[:-3]) == ["<urn:page:4>", "<urn:page:5>"]
    unproved = one(5).replace(b"WARC-Block-Digest", b"WARC-Other-Digest")
    assert ids(gzip.compress(unproved)) == ["<urn:page:5>"] and ids(gzip.compress(unproved + one(6))[:-3]) == []
    assert ids(gzip.compress(one(5) + one(6))[:-3]) == ["<urn:page:5>"]


def test_salvage_of_a_plain_file_with_packed_payloads():
    plain = b"\0" * 9 + one(1)[9:] + one(2, b"\x1f\x8b\x08 is no member") + one(3)
    assert ids(plain) == ["<urn:page:2>", "<urn:page:3>"]
    assert [(k, a) for k, a, *_ in warc.salvage(plain)][0] == ("gap", 0)


def test_gaps_are_reported(spark):
    folder = scratch_path(spark, "warc")
    write_file(f"{folder}/a.warc", one(1) + b"?" * 30 + one(2))
    write_file(f"{folder}/b.warc.gz", gzip.compress(one(3))[:-9] + gzip.compress(one(4)))
    rows = warc.read_archives(spark, folder).collect()
    assert {r.record_id for r in rows if r.kind == "record"} == {f"<urn:page:{i}>" for i in (1, 2, 4)}
    gaps = {r.file.rpartition("/")[2]: (r.offset, r.length, r.reason) for r in rows if r.kind == "gap"}
    assert gaps["a.warc"][:2] == (len(one(1)), 30) and gaps["b.warc.gz"][0] == 0 and gaps["b.warc.gz"][2]
