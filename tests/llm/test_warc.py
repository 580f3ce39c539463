"""Packages written and read back; the ZIP reader against zipfile and hand-made ZIP64 files."""

import hashlib
import io
import os
import struct
import zipfile

from siftline.llm import warc as W
from siftline.session import scratch


def expected(rows, least=100):
    first = {}
    for page, _, html in rows:
        p = (html or "").encode()
        if len(p) >= least and page is not None:
            first[p] = min(page, first.get(p, page))
    out = []
    for page, url, html in rows:
        p = (html or "").encode()
        refers = first.get(p) if first.get(p) != page else None
        out.append((page, len(p), hashlib.sha256(p).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_round_trip_with_copies_nulls_and_odd_urls(spark):
    big = "<p>é</p>" * 40
    rows = [
        (5, "http://a/x", big), (3, None, big), (9, "http://ä/\r\nX-Page-Id: 1", big), (1, "u", "short"), (2, "u", "short"),
        (4, "u", None), (None, "u", big), (6, "u", ""), (3, None, big), (2**62 + 1, "u", big), (8, "u", "x" * 200_000),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    folder = scratch(spark, "packages")
    W.write_packages(df, folder)
    out = W.read_packages(spark, folder, html=True).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr)
    assert got == expected(rows)
    assert {(r.page_id, r.html) for r in out if r.record_type == "response"} >= {(3, big), (4, ""), (8, "x" * 200_000)}


def test_empty_table(spark):
    folder = scratch(spark, "packages")
    W.write_packages(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert W.read_packages(spark, folder).collect() == []


def from_bytes(raw):
    return W.members(lambda at, n: raw[at : at + n], len(raw))


def test_members_of_plain_commented_and_prefixed_packages():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr("a.txt", b"stored")
        z.writestr("dir/ü.bin", b"\x00" * 70_000)
        z.writestr("c.txt", b"packed" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"note"
    raw = sink.getvalue()
    found = from_bytes(raw)
    assert set(found) == {"a.txt", "dir/ü.bin"}
    at, n = found["a.txt"]
    assert raw[at : at + n] == b"stored"


def test_zip64_directories():
    data, name = os.urandom(50), b"big.bin"
    extra_local = struct.pack("<2H2Q", 1, 16, len(data), len(data))
    local = struct.pack("<4s5H3L2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra_local)) + name + extra_local
    extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), 0)
    central = struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    start = len(local) + len(data)
    end64 = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), start)
    locator = struct.pack("<4sLQL", b"PK\x06\x07", 0, start + len(central), 1)
    end = struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    raw = local + data + central + end64 + locator + end
    at, n = from_bytes(raw)["big.bin"]
    assert raw[at : at + n] == data
