"""Shared plumbing of the ``llm`` operators: shared-folder staging and text keys."""

from __future__ import annotations

import gc
import time
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = "\\x20\\x09-\\x0D"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it.

    Only a session without ``spark.checkpoint.dir`` (tests, a laptop) gets one
    below its warehouse folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/kerbline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stage`` wrote for this table, once nothing will read it any more; other tables are left alone."""
    at = df.__dict__.pop("staged_at", None)
    if at:
        _delete(df.sparkSession, at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps that nothing refers to any more.

    It acts on garbage collections of the driver. The first may come while the events of the
    last step, which refer to its plan, still wait for their listeners; so there are two.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def discard_stages(spark: SparkSession) -> None:
    """Delete what this application staged; call it once results are written."""
    _delete(spark, f"{shared_root(spark)}/kerbline/{spark.sparkContext.applicationId}")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal id modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null: 0."""
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(blank, " +"), "")).cast("long")


def row_hash(df: DataFrame, seed: int) -> Column:
    """A 64-bit hash of all columns, nulls told apart; maps, which Spark doesn't hash, by their JSON."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(F.lit(seed), *plain, *[F.col(f"`{f.name}`").isNull() for f in df.schema.fields])


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a variant that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


# ---- vectorised token keys -------------------------------------------------

#: Odd multiplier of the polynomial token hash, and its finaliser.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if _POWERS.size < n:
        size = 1 << max(16, int(n).bit_length())
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
            _INVERSES = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse, np.uint64)]), dtype=np.uint64)
    return _POWERS, _INVERSES


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MIX
        x = (x ^ (x >> np.uint64(32))) * _MIX
        return x ^ (x >> np.uint64(32))


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key for each byte span of ``data``; equal bytes, equal keys."""
    powers, inverses = _tables(data.size + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(data.size + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: data.size], out=prefix[1:])
        return mix64((prefix[ends] - prefix[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, for tables keyed by it alone: eight bytes a step through a mixer; long spans by XXH64.

    A span of up to eight bytes has a hash of its own among those of its length; beyond, two of k different
    spans share one with a chance of about k^2 / 2^65 (spans made to collide aside).
    """
    wide = np.zeros(data.size + 8, np.uint8)
    wide[: data.size] = data
    words = np.ndarray((data.size + 1,), "<u8", wide, strides=(1,))
    sizes = ends - starts
    out = mix64(sizes.astype(np.uint64) + _BASE)
    left = np.flatnonzero(sizes <= 64)
    with np.errstate(over="ignore"):
        for k in range(0, 64, 8):
            left = left[sizes[left] > k]
            if not left.size:
                break
            rest = np.minimum(sizes[left] - k, 8).astype(np.uint64)
            part = words[starts[left] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rest * np.uint64(8)))
            out[left] = mix64(out[left] * _BASE + part)
    for i in np.flatnonzero(sizes > 64).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 42)
    return out


def word_spans(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


#: Byte tables: A-Z lowered; which bytes are words for the white-space rule.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
