import hashlib

import pytest

from effectgrid.llm import archives

SCHEMA = "page_id long, url string, html string, record_type string"


def brute(pages):
    out, first = {}, {}
    for i, _, html in sorted(pages):
        payload = (html or "").encode()
        d = hashlib.sha256(payload).hexdigest()
        f = first.setdefault(payload, i)
        again = len(payload) >= 100 and f != i
        out[i] = (len(payload), d, "revisit" if again else "response", f if again else None)
    return out


PAGES = [
    (1, "http://a b/\n?q=é", "<p>é</p>" * 30),
    (2, None, None),
    (3, "http://x", ""),
    (9, "http://y", "<p>é</p>" * 30),
    (8, "http://y", "<p>é</p>" * 30),
    (10, "u", "x" * 99),
    (11, "u", "x" * 99),
    (12, "u", "x" * 100),
    (13, "u", "x" * 100),
    (20, "u", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n" * 9),
    (21, "u", "line\n" * 200_000),
]


@pytest.mark.parametrize("size", [8 << 20, 500])
def test_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(archives, "SEGMENT_BYTES", size)
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], SCHEMA).repartition(3)
    got = archives.page_records(df).collect()
    assert len(got) == len(PAGES)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute(PAGES)


def test_empty_table(spark):
    assert archives.page_records(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines(version):
    v, d = archives.parse_arc(archives.arc_description(version, "f.arc"), None)
    assert v == version and d["description"]
    body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\npay\nload"
    record = archives.arc_record(version, "http://h/ x", "20010203040506", "text/html", body, "f.arc")
    _, fields = archives.parse_arc(record, version)
    assert fields["url"] == "http://h/%20x" and fields["body"] == body and not fields["truncated"]
    assert archives.parse_arc(record[:-6], version)[1]["truncated"]
    assert archives.parse_arc(record, 3 - version)[1] is None
    assert archives.parse_arc(b"no header", version)[1] is None
    warc = archives.parse_warc(archives.warc_record("response", "urn:uuid:1", fields))
    assert warc["block"] == body and warc["digest"] == hashlib.sha256(b"pay\nload").hexdigest()
    assert archives.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and archives.warc_date("x") == "1996-01-01T00:00:00Z"


@pytest.mark.parametrize("version", [1, 2])
def test_addresses_keep_their_characters(version):
    url, want = "http://é.x/a b\t☃\x7f", "http://é.x/a%20b%09☃%7F"
    _, fields = archives.parse_arc(archives.arc_record(version, url, "20010203040506", "text/html", b"x", "f.arc"), version)
    assert fields["url"] == want
    assert f"WARC-Target-URI: {want}\r\n".encode() in archives.warc_record("response", "urn:uuid:1", fields)
