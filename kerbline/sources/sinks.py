"""Sinks: detections, country tables, named results, event clips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_detections(rows: DataFrame, path: str, buckets: int = 256) -> None:
    """Append to a detections table, in as many folders as ``buckets`` (by a hash of the video), however many videos there are."""
    bucket = F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int")
    rows.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_results(results: dict[str, DataFrame], folder: str) -> None:
    """Every result as a Parquet table under its name."""
    for name, rows in results.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def rewrite_mapping(mapping: DataFrame, source: str, target: str) -> None:
    """An enriched mapping goes to a new path: Spark can't overwrite what it reads."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("the target must differ from the source")
    mapping.write.mode("overwrite").csv(target, header=True, escape='"')


def event_clips(events: DataFrame, time: str, duration: str, before: float = 5, after: float = 5) -> DataFrame:
    """t0 and t1 of the clip around each event, inside the recording."""
    return events.withColumns({"t0": F.greatest(F.lit(0.0), F.col(time) - before), "t1": F.least(F.col(duration).cast("double"), F.col(time) + after)})
