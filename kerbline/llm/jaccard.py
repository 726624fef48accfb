"""Exact Jaccard similarity of word shingles, for candidate pairs of texts.

Texts are equal, and have one key (64 bits), if they are after lowering ASCII letters and
taking white space as one blank. Of fewer words than a shingle the whole text is one; a text
without words is only similar to others without. Shingles are compared by their XXH64 values, each
text's computed once; the comparison itself is an array function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import stage

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_key(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + "\t\n\x0b\x0c\r", _UPPER.lower() + "     ")
    return F.xxhash64(F.trim(F.regexp_replace(plain, " +", " ")))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different values, sorted, of the text's shingles."""
    tokens = (text or "").encode().lower().split()
    digest = xxhash.xxh64_digest
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    return np.unique(np.frombuffer(b"".join(map(digest, shingles)), np.int64))


def shingle_sets(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(key, shingles) of the texts that stand in ``pairs`` (a, b); docs: ``_key``, ``text``, of equal keys one is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x, words) for x in b.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([x.size for x in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([b.column("key"), lists], names=["key", "shingles"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_wanted")).distinct()
    texts = docs.join(wanted, F.col("_key") == F.col("_wanted"), "left_semi").groupBy(F.col("_key").alias("key")).agg(F.min("text").alias("text"))
    return stage(texts.mapInArrow(run, "key long, shingles array<long>"), "jaccard-sets")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts have a similarity of ``least`` or more."""
    one = sets.select(F.col("key").alias("_a"), F.col("shingles").alias("s_a"))
    two = sets.select(F.col("key").alias("_b"), F.col("shingles").alias("s_b"))
    sizes = F.size("s_a") + F.size("s_b")
    fits = F.least(F.size("s_a"), F.size("s_b")) >= F.lit(least) * F.greatest(F.size("s_a"), F.size("s_b"))
    both = pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")).where(fits)
    shared = both.select("a", "b", sizes.alias("n"), F.size(F.array_intersect("s_a", "s_b")).alias("shared"))
    return shared.where((F.col("n") > 0) & (F.col("shared") >= F.lit(least) * (F.col("n") - F.col("shared")))).select("a", "b")
