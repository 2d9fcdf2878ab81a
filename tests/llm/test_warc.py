import base64
import gzip
import hashlib
import os

import pytest

from riskspark.llm.warc import read_archives, round_trip, write_archives

DDL = "page_id long, url string, html string, chunk string, first long"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>ü WARC/1.1\r\n\r\n</p>" * 30_000
    rows = [(5, "http://a/1", "same"), (2, "http://a/2", "same"), (9, None, "same"), (3, "http://ü/x\r\nWARC-Type: evil", big), (4, "u", None),
            (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (8, "u", "same"), (8, "u", "same"), (None, "u", "same"), (10, "v", big)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], DDL)


def test_round_trip_equals_the_rule(pages):
    got = sorted((tuple(r)[:5] for r in round_trip(pages.sparkSession, pages).collect()), key=str)
    payload = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, p in payload:
        if i is not None:
            first[p] = min(first.get(p, i), i)
    expected = [(i, len(p), _digest(p), "response" if first.get(p, i) == i else "revisit", None if first.get(p, i) == i else first[p])
                for i, p in payload]
    assert got == sorted(expected, key=str)


def test_chunks_carry_running_digests(pages):
    chunks = read_archives(write_archives(pages.where("page_id = 3"), chunk_bytes=1000), chunk_bytes=1000).orderBy("chunk_no").collect()
    data = pages.where("page_id = 3").first().html.encode()
    assert [c.chunk_no for c in chunks] == list(range(-(-len(data) // 1000)))
    assert b"".join(c.chunk for c in chunks) == data and max(len(c.chunk) for c in chunks) == 1000
    at = 0
    for c in chunks:
        at += len(c.chunk)
        assert c.payload_bytes == at and c.running_digest == _digest(data[:at]) and c.chunk_offset == at - len(c.chunk)
    assert [c.is_last for c in chunks] == [False] * (len(chunks) - 1) + [True]


def test_archives_are_plain_warc(pages):
    manifest = write_archives(pages.where("page_id in (2, 5, 6)").coalesce(1)).collect()
    assert sum(m.records for m in manifest) == 3
    path = manifest[0].archive.removeprefix("file:")
    text = gzip.open(path).read().decode()
    assert text.count("WARC/1.1\r\n") == 3 and text.count("WARC-Type: revisit") == 1
    assert "WARC-Refers-To: <urn:page:2>" in text and text.endswith("\r\n\r\n") and os.path.getsize(path)


def test_small_payloads_may_stay_responses(pages):
    rows = read_archives(write_archives(pages, min_dedup_bytes=100)).where("is_last").collect()
    assert {r.page_id for r in rows if r.record_type == "revisit"} == {10}


def test_damage_is_noticed_and_empty_tables_work(pages):
    manifest = write_archives(pages.where("page_id = 7").coalesce(1))
    path = manifest.first().archive.removeprefix("file:")
    data = gzip.open(path).read()
    with gzip.open(path, "wb") as f:
        f.write(data.replace(b"\r\n\r\nWARC/1.1\r\n\r\n\r\n", b"\r\n\r\nXARC/1.1\r\n\r\n\r\n"))
    with pytest.raises(Exception, match="does not match its digest"):
        read_archives(manifest).collect()
    assert round_trip(pages.sparkSession, pages.where("false")).count() == 0
