"""WARC round trip and the ordered index."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cohortsmith.llm import warc_merge as M


def want(rows, least=0):
    first = {}
    for p, _, h in rows:
        p = M.LAST if p is None else p
        if len((h or "").encode()) >= least:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        at = first.get(h or "", M.LAST if p is None else p)
        again = at < (M.LAST if p is None else p)
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", at if again else None))
    return sorted(out, key=str)


EDGES = [(90001, None, None), (90002, "", ""), (90003, "http://a.b/\r\nX: y", "é\r\n\r\nWARC/1.1\r\n\r\n\x00"), (90004, "http://a.b/", "same"),
         (90005, "http://A.b:80/?b=2&a=1#f", "same"), (90004, "http://a.b/", "same"), (None, "http://[bad", "same"), (90006, "HTTP://WWW.a.b:8080", "long " * 400000)]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(M, "RANGE", 12)
    monkeypatch.setattr(M, "ARCHIVE", 12)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()] + EDGES
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_bytes", F.lit("x")).repartition(5)
    got = M.page_records(M.capture_index(pages, least)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want(rows, least)
    got.sort(key=lambda r: (r.key_range, r.place_in_range))
    keys = [(r.urlkey, r.timestamp, M.LAST if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys) and len({r.key_range for r in got}) > 3 and len({r.archive for r in got}) > 3


def test_archives_hold_warc_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x.y/", "<p>é</p>"), (2, "http://x.y/2", "<p>é</p>")], "page_id long, url string, html string")
    M.write_archives(pages.coalesce(1), str(tmp_path / "w"))
    found = {f["warc-record-id"]: (f, b) for p in (tmp_path / "w").glob("*.gz") for f, b in M.records(gzip.open(p))}
    f, b = found["<urn:page:1>"]
    assert f["warc-type"] == "response" and b.endswith("\r\n\r\n<p>é</p>".encode()) and f["warc-target-uri"] == "http://x.y/"
    f, b = found["<urn:page:2>"]
    assert f["warc-type"] == "revisit" and f["warc-refers-to"] == "<urn:page:1>" and b.endswith(b"\r\n\r\n")


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.choice("abc"), str(rng.randrange(4)), rng.randrange(9), i) for _ in range(rng.randrange(0, 30))) for i in range(k)]
    assert [x[:3] for x in M.LoserTree(runs)] == sorted(x[:3] for r in runs for x in r)


def test_empty_table(spark):
    assert M.page_records(M.capture_index(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_url_key():
    assert M.url_key("http://www.Example.org:80/A/b?z=1&a=2#x") == "org,example)/a/b?a=2&z=1"
    assert M.url_key(None) == "" and M.url_key("https://h:8443") == "h:8443)/"
