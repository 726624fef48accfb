"""Normalising the city table: nested list literals to one row per video segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_FPS = 30.0


def split_videos(videos: Column) -> Column:
    """Items of a bracketed list, trimmed, quotes kept."""
    return F.transform(F.split(F.regexp_replace(videos, r"^[\[\]]+|[\[\]]+$", ""), ","), lambda v: F.trim(v))


def parse_videos(videos: Column) -> Column:
    """Video ids of a bracketed list, quoted or not."""
    return F.regexp_extract_all(videos, F.lit(r"([\w-]+)"), 1)


def parse_nested(values: Column) -> Column:
    return F.from_json(values, "array<array<int>>")


def parse_fps(values: Column) -> Column:
    """Frame rates; None and 0 become the default."""
    rates = F.from_json(F.replace(values, F.lit("None"), F.lit("null")), "array<double>")
    return F.transform(rates, lambda x: F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(DEFAULT_FPS)))


def explode_segments(mapping: DataFrame) -> DataFrame:
    """Every (video, start) of every row, lists cut to the shortest; mapping has row_idx.

    Adds vpos and spos, the places in the lists, and duration.
    """
    lists = {"_v": parse_videos(F.col("videos")), "_s": parse_nested(F.col("start_time")), "_e": parse_nested(F.col("end_time")), "_t": parse_nested(F.col("time_of_day")), "_f": parse_fps(F.col("fps_list"))}
    rows = mapping.withColumns(lists).drop("videos", "start_time", "end_time", "time_of_day", "fps_list")
    count = F.least(*[F.size(c) for c in lists])
    rows = rows.select("*", F.posexplode(F.slice(F.arrays_zip(*lists), 1, F.greatest(count, F.lit(0)))).alias("vpos", "z")).drop(*lists)
    inner = F.least(F.size("z._s"), F.size("z._e"), F.size("z._t"))
    rows = rows.select("*", F.posexplode(F.slice(F.arrays_zip(F.col("z._s"), F.col("z._e"), F.col("z._t")), 1, F.greatest(inner, F.lit(0)))).alias("spos", "y"))
    out = rows.withColumns({"video_id": F.col("z._v"), "fps": F.col("z._f"), "start_time": F.col("y._s"), "end_time": F.col("y._e"), "time_of_day": F.col("y._t")})
    return out.withColumn("duration", F.col("end_time") - F.col("start_time")).drop("z", "y")


def first_match(segments: DataFrame) -> DataFrame:
    """One row for each (video_id, start_time): the first in row, video and start order; null state is 'unknown'."""
    order = Window.partitionBy("video_id", "start_time").orderBy("row_idx", "vpos", "spos")
    rows = segments.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return rows.withColumn("state", F.coalesce("state", F.lit("unknown"))) if "state" in rows.columns else rows


def first_video_position(segments: DataFrame) -> DataFrame:
    """City lookup by a row's first occurrence of the video only."""
    first = segments.groupBy("row_idx", "video_id").agg(F.min("vpos").alias("vpos"))
    return first_match(segments.join(first, ["row_idx", "video_id", "vpos"], "left_semi"))


def total_seconds(mapping: DataFrame) -> DataFrame:
    """Seconds of all listed segments, repeats counted."""
    starts, ends = parse_nested(F.col("start_time")), parse_nested(F.col("end_time"))
    rows = mapping.select(F.explode(F.slice(F.arrays_zip(starts.alias("s"), ends.alias("e")), 1, F.greatest(F.least(F.size(starts), F.size(ends)), F.lit(0)))).alias("z"))
    rows = rows.select(F.explode(F.slice(F.arrays_zip(F.col("z.s"), F.col("z.e")), 1, F.greatest(F.least(F.size("z.s"), F.size("z.e")), F.lit(0)))).alias("y"))
    return rows.agg(F.coalesce(F.sum(F.col("y.e") - F.col("y.s")), F.lit(0)).cast("long").alias("total_seconds"))


def total_videos(mapping: DataFrame, fix_known_defects: bool = False) -> DataFrame:
    """Distinct list items; unless fixed, brackets stay on the first and last, so these count apart."""
    items = F.regexp_replace("videos", r"[\[\]]", "") if fix_known_defects else F.col("videos")
    return mapping.select(F.explode(F.transform(F.split(items, ","), lambda v: F.trim(v))).alias("v")).agg(F.countDistinct("v").alias("total_videos"))


def videos_per_row(videos: Column) -> Column:
    inner = F.regexp_replace(videos, r"^[\[\]]+|[\[\]]+$", "")
    return F.when(inner.isNull() | (inner == ""), F.lit(0)).otherwise(F.size(F.split(inner, ",")))


def unique_values(rows: DataFrame, column: str) -> DataFrame:
    """Number of distinct values, null being one."""
    c = F.col(column)
    return rows.agg((F.countDistinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))).cast("long").alias("n_values"))


def lookup(keys: DataFrame, table: DataFrame, on: dict[str, str], target: str, order: str = "row_idx") -> DataFrame:
    """First ``target`` of the table whose columns match, blanks and case ignored; 'unknown' or null matches null.

    on: key column -> table column. Keys without a match get null.
    """
    norm = lambda c: F.lower(F.trim(c.cast("string")))
    side = table.select(*[F.nullif(norm(F.col(t)), F.lit("unknown")).alias(f"_{k}") for k, t in on.items()], F.struct(F.col(order), F.col(target).alias("v")).alias("m"))
    side = side.groupBy(*[f"_{k}" for k in on]).agg(F.min("m").alias("m"))
    match = None
    for k in on:
        same = F.nullif(norm(F.col(k)), F.lit("unknown")).eqNullSafe(F.col(f"_{k}"))
        match = same if match is None else match & same
    return keys.join(side, match, "left").withColumn(target, F.col("m.v")).drop("m", *[f"_{k}" for k in on])


def search_key(entries: DataFrame, search_for: str, nested: bool = False) -> DataFrame:
    """First key (by pos) whose value contains the text or is contained in it; values may be arrays."""
    near = lambda v: F.contains(v, F.lit(search_for)) | F.contains(F.lit(search_for), v)
    hit = F.exists("value", near) if nested else near(F.col("value"))
    return entries.where(hit).agg(F.min_by("key", "pos").alias("key"))


def place_query(rows: DataFrame) -> Column:
    """The words a place is looked up by: city, state if there is one, country."""
    return F.concat_ws(", ", "city", F.when(F.lower("state") != "nan", F.col("state")), "country")


def locate(mapping: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """lat and lon of cities without them, from the first row of the gazetteer of the same name."""
    places = gazetteer.groupBy(place_query(gazetteer).alias("_place")).agg(F.min(F.struct("lat", "lon")).alias("_at"))
    rows = mapping.withColumn("_query", place_query(mapping)).join(places, F.col("_query") == F.col("_place"), "left")
    new = F.col("lat").isNull() | F.col("lon").isNull() | F.isnan("lat") | F.isnan("lon")
    return rows.withColumns({c: F.when(new, F.col(f"_at.{c}")).otherwise(F.col(c)) for c in ("lat", "lon")}).drop("_query", "_place", "_at")


def screenshot_of(mapping: DataFrame, files: DataFrame) -> DataFrame:
    """id, file: the first file, by name, that is called as the city, case ignored; files: ``file``."""
    named = files.groupBy(F.lower(F.regexp_replace("file", r"\.[^.]*$", "")).alias("_city")).agg(F.min("file").alias("file"))
    return mapping.join(named, F.lower("city") == F.col("_city")).select("id", "file")
