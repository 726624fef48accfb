"""Media columns: content-defined chunks, stored once each.

A payload is cut where a gear hash, rolling over its last 32 bytes, has its top bits at zero,
so an edit moves only the cuts near it. The hash of all positions comes from five doubling
steps over whole arrays. A chunk is named by its SHA-256.

Storing. The media are the distinct payloads. A *manifest* lists each row's payload digest,
sizes and chunk digests; a join on the digests finds which chunks several media share. A
*pack* holds a medium's ordered chunk list and its own chunks, the *pool* holds each shared
chunk once. So every
chunk's bytes are stored once, and those of unshared chunks lie where they are read.

Reading. Packs that share nothing are complete; the others get the shared chunks from a
join on the digest. Chunks are verified against their digests, put in order, and give the
payload. Shared chunks travel by joins that Spark may split, and a payload is in memory
one at a time.

The stored form of a medium is its ordered chunk list (one digest and length after another)
followed by the chunks' bytes as stored, i.e. compressed.

Defined results: null text is the empty payload, padded like any other; copies share one
medium and get equal values; repeated rows give repeated results; an empty table gives an
empty store. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.common import release

UNIT = 576
PAD = b"\xff"
CUT_BITS, LEAST, MOST = 12, 1024, 16384
#: The store is written in so many waves of media, so that only a part of the payloads is in shuffle files at once.
WAVES = 2


def _gear() -> np.ndarray:
    """256 random 32-bit values, by a counter through a fixed mixer."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(32)).astype(np.uint32)


with np.errstate(over="ignore"):
    GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear(data[i - k]) << k over k < 32: five doublings of the window."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if h.size > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks, the last being the payload's length."""
    n = len(payload)
    if n <= LEAST:
        return [n]
    marks = np.flatnonzero(rolling(np.frombuffer(payload, np.uint8)) >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, at = [], 0
    for m in [*marks.tolist(), n]:
        while m - at > MOST:
            at += MOST
            out.append(at)
        if m - at >= LEAST or m == n and m > at:
            out.append(m)
            at = m
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text in UTF-8, padded to a positive multiple of ``UNIT``, and its own length."""
    raw = (text or "").encode()
    return raw + PAD * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def chunks_of(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_MANIFEST = "media binary, n_bytes long, payload_bytes long, digests array<binary>, lengths array<int>"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for text in b.column("text").to_pylist():
            payload, n = payload_of(text)
            parts = chunks_of(payload)
            rows.append((hashlib.sha256(payload).digest(), n, len(payload), [hashlib.sha256(x).digest() for x in parts], [len(x) for x in parts]))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
        names = ["media", "n_bytes", "payload_bytes", "digests", "lengths"]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *names])


_CHUNKS = pa.list_(pa.struct([("digest", pa.binary()), ("length", pa.int32()), ("bytes", pa.binary())]))


def _compressed(wave: int):
    """The compressed chunks of the media of one wave, told by the first byte of their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=15, write_checksum=False, write_content_size=True)
        for b in batches:
            media, chunks = [], []
            for text in b.column("text").to_pylist():
                payload, _ = payload_of(text)
                key = hashlib.sha256(payload).digest()
                if key[0] % WAVES != wave:
                    continue
                media.append(key)
                parts = chunks_of(payload)
                # the digest of an only chunk is the medium's
                chunks.append([{"digest": hashlib.sha256(x).digest() if len(parts) > 1 else None, "length": len(x), "bytes": press.compress(x)} for x in parts])
            yield pa.RecordBatch.from_arrays([pa.array(media, pa.binary()), pa.array(chunks, _CHUNKS)], names=["media", "chunks"])

    return run


def write_store(docs: DataFrame, path: str) -> None:
    """Writes ``path``/manifest (a row for each input row) and ``path``/chunks (packs and pool)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    docs.mapInArrow(_describe, f"doc_id {dict(docs.dtypes)['doc_id']}, {_MANIFEST}").write.option("compression", "zstd").parquet(f"{path}/manifest")
    manifest = spark.read.parquet(f"{path}/manifest")
    media = manifest.groupBy("media").agg(F.first("digests").alias("digests"))
    uses = media.select("media", F.posexplode("digests").alias("seq", "digest"))
    place = F.struct(F.col("media").alias("m"), F.col("seq").alias("s"))
    shared = uses.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared.write.parquet(f"{path}/shared")
    shared = spark.read.parquet(f"{path}/shared").select(F.col("digest").alias("_d"), "first")
    lends = uses.join(shared, F.col("digest") == F.col("_d")).select("media", "seq", "digest", (F.col("first") == place).alias("own"))
    lends = lends.groupBy(F.col("media").alias("_m")).agg(F.collect_list(F.struct("seq", "digest", "own")).alias("lent"))
    lends.write.parquet(f"{path}/lent")
    lends = spark.read.parquet(f"{path}/lent")
    for wave in range(WAVES):
        packed = docs.select("text").mapInArrow(_compressed(wave), "media binary, chunks array<struct<digest:binary,length:int,bytes:binary>>").groupBy("media").agg(F.first("chunks").alias("chunks"))
        packed = packed.join(lends, F.col("media") == F.col("_m"), "left")
        _stored_rows(packed).write.mode("append").partitionBy("kind").option("compression", "uncompressed").parquet(f"{path}/chunks")
        del packed
        release(spark)


def _stored_rows(packed: DataFrame) -> DataFrame:
    """A pack of each medium, and the shared chunks that it is the first to have, for the pool."""
    none = F.array().cast("array<struct<seq:int,digest:binary,own:boolean>>")
    packed = packed.select("media", "chunks", F.coalesce("lent", none).alias("lent"))
    empty = F.lit(None).cast("binary")
    # lent places and all places, sorted together: a lent place stands right before its chunk
    place = lambda seq, whole: F.struct(seq.cast("int").alias("seq"), F.lit(whole).alias("whole"))
    sides = F.sort_array(F.concat(F.transform("lent", lambda x: place(x["seq"], 1)), F.transform("chunks", lambda c, i: place(i, 2))))
    before = F.concat(F.array(place(F.lit(-1), 2)), sides)
    marked = F.filter(F.arrays_zip(sides.alias("at"), before.alias("before")), lambda z: z["at"]["whole"] == 2)
    gone = F.transform(marked, lambda z: z["before"]["whole"] == 1)
    kept = F.transform(
        F.arrays_zip(F.col("chunks"), gone.alias("gone")),
        lambda z: F.struct(z["chunks"]["digest"].alias("digest"), z["chunks"]["length"].alias("length"), F.when(z["gone"], empty).otherwise(z["chunks"]["bytes"]).alias("bytes")),
    )
    pack = F.struct(F.lit("pack").alias("kind"), F.col("media").alias("key"), kept.alias("chunks"), (F.size("lent") > 0).alias("shares"))
    pool = F.transform(
        F.filter("lent", lambda x: x["own"]),
        lambda x: F.struct(F.lit("pool").alias("kind"), x["digest"].alias("key"), F.array(F.element_at("chunks", x["seq"] + 1)).alias("chunks"), F.lit(False).alias("shares")),
    )
    return packed.select(F.inline(F.concat(F.array(pack), pool)))


_STORED = "key binary, chunks array<struct<digest:binary,length:int,bytes:binary>>, shares boolean, kind string"
_READ = "media binary, n_chunks int, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def feature_of(payload: bytes) -> str:
    """Mean, spread and 16-bin histogram of the samples."""
    x = np.frombuffer(payload, np.uint8)
    return f"{x.mean():.4f};{x.std():.4f};" + ",".join(map(str, np.bincount(x >> 4, minlength=16).tolist()))


def _assemble(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows: list[tuple] = []
            payloads: list[bytes] = []
            for media, chunks, borrowed in zip(*(b.column(c).to_pylist() for c in ("media", "chunks", "borrowed")), strict=True):
                got = {x["seq"]: x["chunk"] for x in borrowed or ()}
                digests, lengths = [c["digest"] or media for c in chunks], [c["length"] for c in chunks]
                stored = [got[i] if c["bytes"] is None else c["bytes"] for i, c in enumerate(chunks)]
                plain = [unpack.decompress(x) for x in stored]
                if any(hashlib.sha256(x).digest() != d or len(x) != n for x, d, n in zip(plain, digests, lengths, strict=True)):
                    raise ValueError(f"a chunk of {media.hex()} does not have its digest")
                payload = b"".join(plain)
                digest = hashlib.sha256(payload).digest()
                if digest != media:
                    raise ValueError(f"{media.hex()} does not have its digest")
                listing = b"".join(d + n.to_bytes(4, "big") for d, n in zip(digests, lengths, strict=True))
                form = listing + b"".join(stored)
                rows.append((media, len(stored), len(payload), digest, zlib.crc32(payload[-32:]), len(form), hashlib.sha256(form).digest(), feature_of(payload)))
                if with_payload:
                    payloads.append(payload)
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            names = ["media", "n_chunks", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            arrays = [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]
            if with_payload:
                arrays, names = [*arrays, pa.array(payloads, pa.binary())], [*names, "payload"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def read_media(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every distinct medium, verified and read back, with its figures."""
    chunks = spark.read.schema(_STORED).parquet(f"{path}/chunks")
    packs = chunks.where("kind = 'pack'").select(F.col("key").alias("media"), "chunks", "shares")
    pool = chunks.where("kind = 'pool'").select(F.col("key").alias("_d"), F.element_at("chunks", 1)["bytes"].alias("chunk"))
    lent = spark.read.parquet(f"{path}/lent").select(F.col("_m").alias("media"), F.inline("lent")).select("media", "seq", "digest")
    borrowed = lent.join(pool, F.col("digest") == F.col("_d")).groupBy(F.col("media").alias("_m")).agg(F.collect_list(F.struct("seq", "chunk")).alias("borrowed"))
    kind = "array<struct<seq:int,chunk:binary>>"
    whole = packs.where("not shares").withColumn("borrowed", F.lit(None).cast(kind))
    partial = packs.where("shares").join(borrowed, F.col("media") == F.col("_m")).drop("_m")
    rows = whole.unionByName(partial).select("media", "chunks", "borrowed")
    return rows.mapInArrow(_assemble(with_payload), _READ + (", payload binary" if with_payload else ""))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The figures of every row's medium; rows of one medium share them."""
    media = read_media(spark, path, with_payload=False).drop("n_chunks", "payload_sha256").withColumnRenamed("media", "_m")  # the digest is the verified key
    rows = spark.read.parquet(f"{path}/manifest").select("doc_id", "n_bytes", "media")
    rows = rows.join(media, F.col("media") == F.col("_m"))
    text = lambda c: F.lower(F.hex(c))
    return rows.select("doc_id", "n_bytes", "payload_bytes", text("media").alias("payload_sha256"), "tail_crc32", "media_bytes", text("media_sha256").alias("media_sha256"), "feature")
