r"""WARC: a content-addressed archive.

Payload bytes are stored once, under their SHA-256; the exact header bytes of every
record are stored apart. Reading joins the two, checks the digests and rebuilds the
records as a WARC/1.1 file has them: header, blank line, payload, two line ends.

Of records with equal payloads, that with the largest page_id is the response and the
others revisit it; payloads below ``min_revisit`` bytes are all responses (their bytes
are still stored once). A revisit's block is empty, as its profile says: its payload is that of
the record it refers to, found by the digest. Record ids are the page_id and a number of the row, so rows that
share a page_id have different ones. Pages have no time of capture; ``date`` is written as every record's.

Payloads travel compressed and move between machines twice: once to be stored
under their digest (copies are dropped before the shuffle) and once to meet their
headers. A payload with very many records is copied to them by a join whose large
partitions Spark may split, never gathered.

Defined results: null html is the empty payload; a null url is read back as null; a url with line ends is
kept exactly in a header of its own; a null page_id sorts lowest and is written as an empty id; rows of equal
payload that share the largest page_id are all responses; payloads may be of any length that fits in a
row; an empty table gives an empty archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.common import stage_path

_HEADS = "page_id long, row long, url string, payload_bytes long, sha256 binary, sha1 binary"
_HEAD_FIELDS = [("page_id", pa.int64()), ("row", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("sha256", pa.binary()), ("sha1", pa.binary())]


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [(x or "").encode() for x in b.column("html").to_pylist()]
        cols = [b.column("page_id"), b.column("row"), b.column("url"), [len(x) for x in data], [hashlib.sha256(x).digest() for x in data], [hashlib.sha1(x).digest() for x in data]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c.cast(t) for c, (_, t) in zip(cols, _HEAD_FIELDS, strict=True)], names=[n for n, _ in _HEAD_FIELDS])


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct payloads, compressed; of the last few thousand digests none twice."""
    seen: OrderedDict[bytes, None] = OrderedDict()
    press = zstandard.ZstdCompressor(level=6)
    for b in batches:
        keys, packed = [], []
        for x in b.column("html").to_pylist():
            data = (x or "").encode()
            key = hashlib.sha256(data).digest()
            if key in seen:
                continue
            seen[key] = None
            if len(seen) > 8192:
                seen.popitem(last=False)
            keys.append(key)
            packed.append(press.compress(data))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], names=["sha256", "packed"])


def _id(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def _header(r: dict, date: str) -> bytes:
    """The header of a record, up to its blank line; a response's block is its payload, a revisit's is empty."""
    kind = "response" if r["refers_to"] is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(r['page_id'], r['row'])}", f"WARC-Date: {date}"]
    if r["url"] is not None:
        lines.append("WARC-Target-URI: " + r["url"].replace("\r", "%0D").replace("\n", "%0A"))
        if "\r" in r["url"] or "\n" in r["url"]:
            lines.append("X-Target-URI-Base64: " + base64.b64encode(r["url"].encode()).decode())
    lines.append(f"WARC-Payload-Digest: sha1:{base32(r['sha1'])}")
    if r["refers_to"] is not None:
        lines += [f"WARC-Refers-To: {_id(r['refers_to'], r['refers_row'])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {r['payload_bytes'] if r['refers_to'] is None else 0}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _records(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [_header(r, date) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("sha256"), pa.array(heads, pa.binary())], names=["page_id", "sha256", "header"])

    return run


def write_archive(pages: DataFrame, path: str, min_revisit: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes ``path``/records and ``path``/payloads."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), F.monotonically_increasing_id().alias("row"), "url", "html")
    heads_path = stage_path(spark, "warc-heads")
    pages.mapInArrow(_heads, _HEADS).write.parquet(heads_path)
    heads = spark.read.parquet(heads_path)
    latest = heads.groupBy("sha256").agg(F.max(F.struct("page_id", "row")).alias("to"), F.count("*").alias("n")).where("n > 1").select(F.col("sha256").alias("_k"), F.col("to.page_id").alias("latest"), F.col("to.row").alias("refers_row"))
    refers = F.when((F.col("payload_bytes") >= min_revisit) & (F.coalesce("page_id", F.lit(-(2**63))) < F.col("latest")), F.col("latest"))
    heads.join(latest, F.col("sha256") == F.col("_k"), "left").select(*heads.columns, refers.alias("refers_to"), "refers_row").mapInArrow(_records(date), "page_id long, sha256 binary, header binary").write.option("compression", "zstd").parquet(f"{path}/records")
    packed = pages.select("html").mapInArrow(_payloads, "sha256 binary, packed binary")
    packed.groupBy("sha256").agg(F.first("packed").alias("packed")).write.option("compression", "uncompressed").parquet(f"{path}/payloads")


_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _page_of(record_id: str) -> int | None:
    number = record_id.removeprefix("<urn:page:").split(":")[0]
    return int(number) if number else None


def _parse(with_record: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last: tuple[bytes, bytes, str] = (b"", b"", "")
        for b in batches:
            out: list[tuple] = []
            raw: list[bytes] = []
            payloads: list[bytes] = []
            for key, header, packed in zip(*(b.column(c).to_pylist() for c in ("sha256", "header", "packed")), strict=True):
                if key != last[0]:
                    data = unpack.decompress(packed)
                    if hashlib.sha256(data).digest() != key:
                        raise ValueError(f"payload {key.hex()} does not have its digest")
                    last = (key, data, base32(hashlib.sha1(data).digest()))
                fields = dict(x.split(": ", 1) for x in header.decode().split("\r\n")[1:] if x)
                block = last[1] if fields["WARC-Type"] == "response" else b""
                said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if said != last[2] or int(fields["Content-Length"]) != len(block):
                    raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                exact = fields.get("X-Target-URI-Base64")
                url = base64.b64decode(exact).decode() if exact else fields.get("WARC-Target-URI")
                out.append((_page_of(fields["WARC-Record-ID"]), url, fields["WARC-Type"], _page_of(fields.get("WARC-Refers-To", "")), len(last[1]), said))
                raw.append(header + block + b"\r\n\r\n")
                if with_record:
                    payloads.append(last[1])
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
            arrays = [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]
            if with_record:
                arrays, names = [*arrays, pa.array(raw, pa.binary()), pa.array(payloads, pa.binary())], [*names, "record", "payload"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def read_archive(spark: SparkSession, path: str, with_record: bool = True) -> DataFrame:
    """Every record, verified; ``record`` has the bytes of the whole WARC record, ``payload`` those it has or refers to."""
    records, payloads = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    joined = records.join(payloads.withColumnRenamed("sha256", "_k"), F.col("sha256") == F.col("_k")).select("sha256", "header", "packed")
    return joined.mapInArrow(_parse(with_record), _RECORD + (", record binary, payload binary" if with_record else ""))
