import base64
import gzip
import hashlib

import pytest

from repograph.llm import warc as W
from repograph.llm.warc import build_index, lookup_url, read_captures, url_key, write_archives


def pages(spark):
    big = "x" * 200_000
    rows = [(i, f"http://www.Site{i % 5}.example.com/p/{i % 40}?a={i}#f", f"<p>{i % 30}</p>é") for i in range(300)]
    rows += [(1000, None, None), (1001, "", ""), (1002, "not a url [", "<b>"), (1003, "http://[bad", "<b>"),
             (None, "http://x.org/", "<p>1</p>é"), (1004, "http://h:8080/a b\n", big), (1005, "https://h:443/", big),
             (1006, "http://site0.example.com/p/0?a=0", "again"), (1006, "http://site0.example.com/p/0?a=0", "again"),
             (2, "http://other/", "second row of id two")]
    return spark.createDataFrame([r + ("clash", 1) for r in rows],
                                 "page_id long, url string, html string, key string, offset int"), rows


def brute(rows, least=0):
    last = {}
    for i, _, h in rows:
        h = h or ""
        last[h] = max((x for x in (last.get(h), i) if x is not None), default=None)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        r = last[h or ""] == i or len(raw) < least
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "response" if r else "revisit", None if r else last[h or ""]))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, least, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_LINES", 7)
    df, rows = pages(spark)
    captures = write_archives(df, min_bytes=least)
    shards = build_index(captures)
    got = read_captures(df, shards)
    assert sorted(((r.page_id, len(r.payload), r.payload_digest, r.record_type, r.refers_to)
                   for r in got.collect()), key=str) == brute(rows, least)


def test_point_lookup_and_format(spark):
    df, rows = pages(spark)
    captures = write_archives(df)
    shards = build_index(captures)
    found = lookup_url(spark, shards, "https://www.site3.example.com/p/3?a=12")
    assert found == []
    found = lookup_url(spark, shards, "http://www.site3.EXAMPLE.com:80/p/3?a=123")
    assert [(p, t, x) for p, t, x in found] == [(123, "revisit", "<p>3</p>é".encode())]
    assert len(lookup_url(spark, shards, "http://site0.example.com/p/0?a=0")) == 2
    c = captures.where("page_id = 299").first()
    fs, path = W.open_fs(c.file)
    raw = gzip.decompress(fs.open_input_file(path).read_at(c.length, c.offset))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith("<p>29</p>é\r\n\r\n".encode())


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    shards = build_index(write_archives(none))
    assert read_captures(none, shards).count() == 0


def test_url_keys():
    assert url_key("HTTP://user@Www.Example.com:80/A?q=1#x") == "com,example,www)/A?q=1"
    assert url_key("https://example.com:8443") == "com,example:8443)/"
    assert url_key(None) == ")/"
