"""Archives and their index against plain Python."""

import base64
import hashlib

from pyspark.sql import functions as F

from cuegrain.llm import warc


def brute(rows):
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        ids = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        top = max(ids, default=None)
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    rows = [(i, f"https://h{i % 13}.example.org:80{i % 2}/p/{i % 50}?q={i % 3}#f", f"<p>{i % 90}é</p>" * (1 + i % 5)) for i in range(600)]
    rows += [(1000, None, None), (1001, "no url", ""), (1002, "http://[bad", "x" * 3_000_000), (None, "http://a/", "null id"), (1003, "http://a/", "null id"), (None, "http://b/", "alone"), (1004, "http://x\r\nWARC: y", "crlf"), (1004, "http://x\r\nWARC: y", "crlf")]
    rows += [(1, "http://a/", "one"), (1, "http://a/", "two"), (None, None, "three"), (None, None, "four"), (2, "http://a/", "x" * 40), (2, "http://a/", "y" * 40)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("file", F.lit(1)).withColumn("key", F.lit("k"))
    got = warc.round_trip(df, archive_bytes=5000, block_rows=7)
    assert sorted((tuple(r[:5]) for r in got.collect()), key=str) == brute(rows)
    assert sorted(r.payload.decode() for r in got.where("page_id = 1 AND url = 'http://a/'").collect()) == ["one", "two"]
    monkeypatch.setattr(warc, "FEW_DIGESTS", 0)  # too many repeated payloads to broadcast
    assert sorted((tuple(r[:5]) for r in warc.round_trip(df).collect()), key=str) == brute(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_keys():
    assert warc.surt("http://www.Example.org:8080/a/b?x=1#top") == "org,example,www:8080)/a/b?x=1"
    assert warc.surt("https://example.org") == "org,example)/"
    assert warc.surt(None) == ")/"


def test_missing_captures(spark):
    scratch = warc.Scratch(spark)
    rows = [(i, f"http://h{i}.org/", "x") for i in range(0, 100, 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    root = scratch.path("index")
    table = warc.write_index(warc.write_archives(warc.judged(pages, scratch), scratch.path("archives"), scratch), root, scratch, 3, 4)
    key = hashlib.sha256(b"x").hexdigest()
    queries = spark.createDataFrame([(warc.surt(f"http://h{i}.org/"), i, key) for i in range(-1, 102)], "surt string, page_id bigint, key string")
    got = warc.look_up(queries, root, table).where("file IS NOT NULL").select("page_id").collect()
    assert sorted(r.page_id for r in got) == list(range(0, 100, 2))
