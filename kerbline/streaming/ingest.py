"""Structured Streaming: detections appended as they come, and track trails as state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def stream_detections(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New detection files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has come so far to a table, each file exactly once, and stop."""
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def trails(rows: DataFrame, points: int = 30, idle_ms: int = 600_000) -> DataFrame:
    """The last positions of a track of a segment after each batch.

    A track's state is at most ``points`` positions, and is dropped when nothing came for ``idle_ms``; a track
    that goes on after that begins anew.
    """

    def update(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        xs, ys = map(list, state.get) if state.exists else ([], [])
        for frame in frames:
            frame = frame.sort_values("row_idx")
            xs, ys = (xs + frame["x"].tolist())[-points:], (ys + frame["y"].tolist())[-points:]
        state.update((xs, ys))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"video_id": [key[0]], "start_time": [key[1]], "unique_id": [key[2]], "xs": [xs], "ys": [ys]})

    grouped = rows.where("unique_id is not null").groupBy("video_id", "start_time", "unique_id")
    return grouped.applyInPandasWithState(update, "video_id string, start_time int, unique_id long, xs array<double>, ys array<double>", "xs array<double>, ys array<double>", "update", GroupStateTimeout.ProcessingTimeTimeout)
