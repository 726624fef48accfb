import base64
import hashlib

from pyspark.sql import functions as F

from kerbline.llm import warc
from kerbline.llm.common import stage_path
from kerbline.llm.queries import QUERIES

PAGES = "page_id long, url string, html string"


def expected(pages, least=0):
    last = {}
    for i, _, html in pages:
        data = (html or "").encode()
        last[data] = max(last.get(data, -(2**63)), -(2**63) if i is None else i)
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = len(data) >= least and (-(2**63) if i is None else i) < last[data]
        yield (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last[data] if revisit else None)


def fields(r):
    return (r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])


def test_whole_table(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(str, map(fields, QUERIES["op3_warc"](spark, sf).collect()))) == sorted(map(str, expected(pages)))


def test_records_are_rebuilt_exactly(spark):
    pages = [(1, "http://a/", "<p>é\r\n\r\nx"), (2, "http://b/", "<p>é\r\n\r\nx"), (3, None, None), (4, "u\r\nInjected: 1", ""), (None, "n", "only"), (6, "c", "z" * 300_000), (7, "d", "<p>é\r\n\r\nx"), (7, "d", "<p>é\r\n\r\nx")]
    df = spark.createDataFrame(pages, PAGES).withColumn("sha256", F.lit("clash")).withColumn("header", F.lit(1))
    for least in (0, 5):
        path = stage_path(spark, "warc-test")
        warc.write_archive(df, path, least)
        got = warc.read_archive(spark, path).collect()
        assert sorted(str(fields(r)) for r in got) == sorted(map(str, expected(pages, least)))
        ids = set()
        for r in got:
            head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode()) and b"\r\nInjected" not in head
            named = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            ids.add(named[b"WARC-Record-ID"])
            assert named[b"WARC-Date"] == b"1970-01-01T00:00:00Z" and int(named[b"Content-Length"]) == len(body) - 4
            assert body == (bytes(r["payload"]) if r["record_type"] == "response" else b"") + b"\r\n\r\n"
            assert len(r["payload"]) == r["payload_bytes"]
        assert len(ids) == len(pages) and all(dict(x.split(b": ", 1) for x in bytes(r["record"]).partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]).get(b"WARC-Refers-To", next(iter(ids))) in ids for r in got)
        assert sorted((r["page_id"] or 0, str(r["url"]), bytes(r["payload"])) for r in got) == sorted((i or 0, str(u), (h or "").encode()) for i, u, h in pages)
        assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in pages})


def test_empty_table(spark):
    path = stage_path(spark, "warc-empty")
    warc.write_archive(spark.createDataFrame([], PAGES), path)
    assert warc.read_archive(spark, path).collect() == []
