import gzip
import hashlib
import io
import os

import pytest

from sandloom.llm.warc import read_archives, read_range, record, write_archives

PAGES = [(1, "http://a/ b", "<p>" + "x" * 200, 1), (2, None, "<p>" + "x" * 200, 1), (3, "u", "short", 1), (4, "u", "short", 1), (5, "u", None, 1), (6, "u", "é" * 50, 1), (7, "u\r\nX: y", "é" * 50, 1), (7, "u", "é" * 50, 1), (None, "n", "é" * 50, 1), (8, "u", os.urandom(90_000).hex(), 1), (None, "n", "lonely" * 40, 1)]


def brute():
    first = {}
    for i, _, h, _ in PAGES:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, _, h, _ in PAGES:
        p = (h or "").encode()
        to = first.get(p)
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if to is None or to == i else "revisit", None if to == i else to))
    return sorted(out, key=str)


def test_round_trip_over_any_ranges(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, first int")
    archives = write_archives(pages)
    for size in (977, 40_000, 1 << 23):
        got = read_archives(archives, size).drop("url").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute()
    assert read_archives(write_archives(pages.limit(0))).count() == 0


def test_members_are_plain_gzip_and_false_magic_is_passed_over():
    fake = b"\x1f\x8b\x08" + b"\0" * 20 + gzip.compress(b"not a record")
    members = [record(i, f"u{i}", b"p%d" % i * 40, "d", None) for i in range(50)]
    blob = members[0] + fake + b"".join(members[1:])
    seen = []
    for start in range(0, len(blob), 101):
        seen += [int(f["X-Page-ID"]) for f, _ in read_range(io.BytesIO(blob), start, start + 101, len(blob), step=64)]
    assert seen == list(range(50))
    assert gzip.decompress(members[3]).startswith(b"WARC/1.1\r\nWARC-Type: response")
    with pytest.raises(ValueError, match="inside a record"):
        list(read_range(io.BytesIO(blob[:-9]), 0, len(blob), len(blob) - 9))


def test_headers_of_any_length_are_read(spark):
    urls = ["data:," + "a" * 100_000, "data:," + os.urandom(100_000).hex(), "u"]
    blob = b"".join(record(i, u, b"p%d" % i * 40, "d", None) for i, u in enumerate(urls))
    for step in (1000, 1 << 20):
        assert [f.get("WARC-Target-URI") for f, _ in read_range(io.BytesIO(blob), 0, len(blob), len(blob), step=step)] == urls
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "url AS html")
    assert sorted(r.page_id for r in read_archives(write_archives(pages)).collect()) == [0, 1, 2]
