"""Scans of detections, dimension tables, label files, indicators and configuration."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.functions.scalars import segment_of_stem
from kerbline.operators.mapping import parse_videos
from kerbline.sources.schemas import DETECTION_CSV, INDICATOR, LABEL_TXT, MAPPING_CSV


def _existing(spark: SparkSession, folders: Sequence[str]) -> list[str]:
    """Folders that are there, in order; Hadoop's file system answers, so any store will do."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return [f for f in folders if (p := jvm.org.apache.hadoop.fs.Path(f)).getFileSystem(conf).exists(p)]


def scan_detections(spark: SparkSession, folders: Sequence[str], mapping: DataFrame, countries: Sequence[str] = ()) -> DataFrame:
    """Detection CSVs of the folders as one table, with video_id, start_time and row_idx.

    Files whose video isn't in the mapping are left out, as are those whose first mapping row
    is of a country not listed (no list: all; case ignored). Of files with the same stem
    that of the last folder counts. Damaged files are skipped. row_idx (the
    place of the file's split, then of the row in it) sorts as the file's rows stand.
    """
    found = _existing(spark, folders)
    empty = "video_id string, start_time int, row_idx struct<block:long,row:long>, yolo_id int, x double, y double, width double, height double, unique_id long, frame_count int"
    if not found:
        return spark.createDataFrame([], empty)
    parts = []
    for rank, folder in enumerate(found):
        rows = spark.read.option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.csv").option("mode", "PERMISSIVE").schema(DETECTION_CSV).csv(folder, header=True, enforceSchema=True)
        meta = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
        parts.append(meta.withColumn("_rank", F.lit(rank)).withColumn("row_idx", F.struct(F.col("_block").alias("block"), F.monotonically_increasing_id().alias("row"))))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    stem = F.regexp_replace("_file", r"\.csv$", "")
    rows = rows.select("*", segment_of_stem(stem).alias("_s")).select("*", "_s.video_id", "_s.start_time").where("start_time is not null")
    wanted = allowed_videos(mapping, countries)
    rows = rows.join(wanted, "video_id", "left_semi").join(_last_files(spark, found), ["_file", "_rank"], "left_semi")
    return rows.select("video_id", "start_time", "row_idx", "yolo_id", "x", "y", "width", "height", F.col("unique_id").cast("long").alias("unique_id"), "frame_count")


def _last_files(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """_file and _rank, the number of the last folder that has a file of this name; from the listings, no file is read."""
    names = None
    for rank, folder in enumerate(folders):
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("_file"), F.lit(rank).alias("_rank"))
        names = listed if names is None else names.unionByName(listed)
    return names.groupBy("_file").agg(F.max("_rank").alias("_rank"))


def allowed_videos(mapping: DataFrame, countries: Sequence[str] = ()) -> DataFrame:
    """video_id of every video whose first mapping row is of an allowed country; mapping has row_idx."""
    videos = mapping.select("row_idx", "iso3", F.explode(parse_videos(F.col("videos"))).alias("video_id"))
    first = videos.groupBy("video_id").agg(F.min(F.struct("row_idx", "iso3")).alias("m"))
    if countries:
        first = first.where(F.lower("m.iso3").isin([c.lower() for c in countries]))
    return first.select("video_id")


def scan_mapping(spark: SparkSession, path: str, countries: Sequence[str] = ()) -> DataFrame:
    """The city table with row_idx; an allow-list of iso3 codes is matched as written."""
    rows = spark.read.schema(MAPPING_CSV).csv(path, header=True, escape='"', enforceSchema=False).withColumn("row_idx", F.monotonically_increasing_id())
    return allow_countries(rows, countries)


def allow_countries(mapping: DataFrame, countries: Sequence[str] = ()) -> DataFrame:
    return mapping.where(F.col("iso3").isin(list(countries))) if countries else mapping


def scan_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label files label_{n}.txt as detections with frame_count n, in frame and row order."""
    rows = spark.read.option("sep", " ").schema(LABEL_TXT).csv(folder, pathGlobFilter="label_*.txt")
    rows = rows.select("*", F.regexp_extract("_metadata.file_name", r"label_(\d+)\.txt", 1).cast("int").alias("frame_count"), F.monotonically_increasing_id().alias("_row"))
    return rows.withColumn("row_idx", F.struct("frame_count", "_row")).drop("_row")


def scan_indicator(spark: SparkSession, path: str) -> DataFrame:
    """An indicator feed dropped as CSV: iso3, name, year, value."""
    return spark.read.schema(INDICATOR).csv(path, header=True)


def latest_per_key(rows: DataFrame, key: str = "iso3", order: str = "year") -> DataFrame:
    """The newest row of each key; ties go to the largest value."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in rows.columns if c not in (key, order)])
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def scan_result(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A named result of an earlier run."""
    return spark.read.parquet(f"{folder}/{name}")


def scan_heights(spark: SparkSession, path: str) -> DataFrame:
    """The country height table; two of its columns differ only by case, so they are named by position."""
    names = "place pop2023 growth_rate area country cca3 cca2 ccn3 region subregion land_area_km density density_mi pop_rank year height_male height_female height_rank".split()
    text = {"place", "country", "cca3", "cca2", "region", "subregion"}
    return spark.read.schema(", ".join(f"{n} {'string' if n in text else 'double'}" for n in names)).csv(path, header=True, enforceSchema=True)


def missing_segments(segments: DataFrame, present: DataFrame) -> DataFrame:
    """Mapped segments without a detection file."""
    return segments.join(present, ["video_id", "start_time"], "left_anti")


@dataclasses.dataclass(frozen=True)
class Config:
    """Run settings; unknown keys are kept in ``more``."""

    data: tuple[str, ...] = ()
    mapping: str = "mapping.csv"
    countries_analyse: tuple[str, ...] = ()
    always_analyse: bool = True
    boundary_left: float = 0.45
    boundary_right: float = 0.55
    confidence: float = 0.0
    more: dict = dataclasses.field(default_factory=dict)


def load_config(text: str, defaults: str | None = None) -> Config:
    """A Config from JSON text. It must have at least as many keys as the defaults."""
    given = json.loads(text)
    if defaults is not None and len(given) < len(json.loads(defaults)):
        raise ValueError("the configuration has fewer keys than the defaults")
    names = {f.name for f in dataclasses.fields(Config)} - {"more"}
    own = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in names}
    return Config(**own, more={k: v for k, v in given.items() if k not in names})


def secret(text: str, key: str):
    """One entry of a JSON secrets file."""
    return json.loads(text)[key]
