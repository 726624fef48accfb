"""The corpus pipeline: five stages over ``documents``, each written and read again.

Language ID and the quality classifier drop what they reject, near-duplicate groups keep one
document, documents with a benchmark passage go, and what is left is mixed to target
weights. All stages but the last return the columns of ``documents``; the last adds ``copies``
and ``position`` and sorts by it. A classifier cannot be written in SQL, so there is none.

Near-duplicates are candidates of the generalised pigeonhole search over five SimHash fingerprints of a text (word
5-shingles, 9 bits), decided by a Jaccard similarity of 0.8 or more.

Defined results: rows of null, empty or letterless text go in the first stage; of repeated rows one stays; rows without
an id or with the same one are rows like any other, of a near-duplicate group the smallest id stays, a null one last;
texts are taken whole, of any length that fits in a row; other columns are kept whatever their names (where one is
called ``copies`` or ``position``, the new one ends in ``_``); empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kerbline.llm import decontam, langid, mixing, quality, simhash
from kerbline.llm.common import discard, stage

#: Rows handed to a Python worker at once: their texts, and what is made of them, lie in its memory together.
BATCH_ROWS = 2000
#: A language must be this sure, a text this good (as the quality query predicts 1).
LEAST_LANGUAGE, LEAST_QUALITY = 0.5, 0.7


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return langid.keep_confident(docs, langid.fit(docs), LEAST_LANGUAGE)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels), LEAST_QUALITY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return decontam.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", tell_language),
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, function) in enumerate(STAGES):
        before, docs = docs, function(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{k}")
            discard(before)
    return docs
