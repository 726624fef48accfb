import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import media
from kerbline.llm.common import stage_path
from kerbline.llm.queries import QUERIES


def slow_hash(data, i):
    return sum(int(media.GEAR[data[i - k]]) << k for k in range(32) if i >= k) & 0xFFFFFFFF


def test_rolling_hash_and_cuts():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(60_000)) + b"a" * 40_000
    h = media.rolling(np.frombuffer(data, np.uint8))
    for i in (0, 1, 30, 31, 32, 33, 1000, 99_999):
        assert int(h[i]) == slow_hash(data, i)
    ends = media.cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(data) and max(sizes) <= media.MOST and min(sizes[:-1]) >= media.LEAST
    edited = data[:20_000] + b"edit" + data[20_000:]
    shared = {hashlib.sha256(x).digest() for x in media.chunks_of(data)} & {hashlib.sha256(x).digest() for x in media.chunks_of(edited)}
    assert len(shared) >= len(ends) - 4  # an edit moves only the cuts near it


def padded(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (576 if not raw else -len(raw) % 576)


def expected(doc, text):
    """All but the stored form's figures, without the operator's own functions."""
    payload = padded(text)
    x = list(payload)
    mean = sum(x) / len(x)
    spread = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x)) if len(x) < 5000 else float(np.std(np.array(x, float)))
    bins = Counter(v // 16 for v in x)
    feature = f"{mean:.4f};{spread:.4f};" + ",".join(str(bins[k]) for k in range(16))
    return doc, len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature


def got(rows):
    return [(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["feature"]) for r in rows]


def key(r):
    return (r[0] is not None, r[0] or 0, r[3])


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op4_media"](spark, sf).collect()
    assert sorted(got(rows), key=key) == sorted((expected(*d) for d in docs), key=key)
    forms = {}
    for r in rows:
        assert forms.setdefault(r["payload_sha256"], (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])


def test_shared_chunks_are_stored_once_and_read_back(spark, docs_of, odd):
    rng = random.Random(2)
    base = " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randrange(999)) for _ in range(8000))
    rows = [*odd, (20, base), (21, base[:30_000] + " edit " + base[30_000:]), (22, base), (23, base[20_000:] + base[:20_000]), (24, "ab" * 50_000)]
    path = stage_path(spark, "media-test")
    media.write_store(docs_of(rows), path)
    back = media.read_media(spark, path).collect()
    payloads = {padded(t) for _, t in (r[:2] for r in rows)}
    assert {bytes(r["payload"]) for r in back} == payloads and len(back) == len(payloads)
    assert sorted(got(media.read_features(spark, path).collect()), key=key) == sorted((expected(*r[:2]) for r in rows), key=key)
    every = {hashlib.sha256(c).digest() for p in payloads for c in media.chunks_of(p)}
    stored = spark.read.parquet(f"{path}/chunks").select(F.explode("chunks").alias("c")).where("c.bytes is not null").count()
    assert stored == len(every)


def test_damage_is_found(spark, docs_of):
    path = stage_path(spark, "media-damage")
    media.write_store(docs_of([(1, "good")]), path)
    bad = spark.read.parquet(f"{path}/chunks").withColumn("key", F.unhex(F.lit("00" * 32))).cache()
    bad.count()
    bad.write.mode("overwrite").partitionBy("kind").parquet(f"{path}-2/chunks")
    for part in ("manifest", "lent", "shared"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{path}-2/{part}")
    with pytest.raises(Exception, match="digest"):
        media.read_media(spark, f"{path}-2").collect()


def test_empty_table(spark, docs_of):
    path = stage_path(spark, "media-empty")
    media.write_store(docs_of([(1, "x")]).where(F.lit(False)), path)
    assert media.read_features(spark, path).collect() == []


def test_many_shared_chunks_take_linear_time(spark, docs_of):
    rng = random.Random(6)
    base = "".join(chr(rng.randrange(97, 123)) for _ in range(3_000_000))
    rows = [(1, base), (2, base + "x"), (3, base[:1_500_000] + "y" + base[1_500_000:])]
    path = stage_path(spark, "media-shared")
    began = time.perf_counter()
    media.write_store(docs_of(rows), path)
    back = {bytes(r["payload"]) for r in media.read_media(spark, path).collect()}
    assert back == {padded(t) for _, t in rows} and time.perf_counter() - began < 60
