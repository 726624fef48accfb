"""Track events: crossings, their time and speed, hesitation before them, equipment in view.

A track is all rows of one ``unique_id`` inside one segment (video_id, start_time), in row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.sources.schemas import EQUIPMENT, PERSON, POOLED, TRAFFIC_LIGHT

SEGMENT = ["video_id", "start_time"]
TRACK = [*SEGMENT, "unique_id"]


def crossings(detections: DataFrame, left: float = 0.45, right: float = 0.55, person: int = PERSON) -> DataFrame:
    """Person tracks seen at or left of ``left`` and at or right of ``right``."""
    people = detections.where((F.col("yolo_id") == person) & F.col("unique_id").isNotNull())
    ends = people.groupBy(*TRACK).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"))
    return ends.where((F.col("min_x") <= left) & (F.col("max_x") >= right)).select(*TRACK)


def crossing_counts(crossed: DataFrame) -> DataFrame:
    return crossed.groupBy(*SEGMENT).agg(F.count("*").alias("crossings"))


def crossing_rows(detections: DataFrame, crossed: DataFrame) -> DataFrame:
    """All rows of the tracks that crossed, of any class."""
    return detections.join(crossed.select(*TRACK), TRACK, "left_semi")


def track_shapes(detections: DataFrame, left: float = 0.45, right: float = 0.55, person: int = PERSON) -> DataFrame:
    """All that is asked of the tracks that cross, from one pass over the detections and one shuffle by track.

    low, high and height of all its rows, of any class; at_low and at_high, the numbers of the first rows at
    these; first_row and last_row. Whether it crosses is told by its person rows.
    """
    along = Window.partitionBy(*TRACK).orderBy("row_idx")
    as_person = F.when(F.col("yolo_id") == person, F.col("x"))
    rows = detections.where("unique_id is not null").select(*TRACK, "row_idx", "x", "height", as_person.alias("px"), F.row_number().over(along).alias("rn"))
    shapes = rows.groupBy(*TRACK).agg(
        F.min("px").alias("from_x"), F.max("px").alias("to_x"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("height").alias("height"),
        F.min_by("rn", F.struct("x", "rn")).alias("at_low"), F.min_by("rn", F.struct(-F.col("x"), "rn")).alias("at_high"),
        F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"),
    )
    return shapes.where((F.col("from_x") <= left) & (F.col("to_x") >= right)).drop("from_x", "to_x")


def crossing_times(shapes: DataFrame, segments: DataFrame) -> DataFrame:
    """Seconds between a track's first extreme positions: rows from one to the other over the frame rate."""
    where = segments.select(*SEGMENT, "country", F.col("time_of_day").alias("condition"), "fps", "avg_height")
    return shapes.join(where, SEGMENT).withColumn("crossing_time_s", (F.abs(F.col("at_low") - F.col("at_high")) + 1) / F.col("fps"))


def crossing_speeds(times: DataFrame, limit: float = 1.42, fix_known_defects: bool = False) -> DataFrame:
    """Metres a second from a track's width in units of its mean box height; faster ones are rejected."""
    metres = F.try_divide(F.col("high") - F.col("low"), F.col("height") / F.col("avg_height"))
    rows = times.withColumn("speed", F.try_divide(metres, F.col("crossing_time_s")) / 100)
    keep = F.col("speed") <= limit
    return rows.where(keep if fix_known_defects else keep | F.isnan("speed")).select(*TRACK, "country", "condition", "speed")


def mean_by_condition(values: DataFrame, value: str, name: str) -> DataFrame:
    """Mean by country and condition, and over both conditions as condition 2."""
    sets = values.groupingSets([["country", "condition"], ["country"]], "country", "condition")
    return sets.agg(F.grouping("condition").alias("_all"), F.avg(value).alias(name)).select("country", F.when(F.col("_all") == 1, POOLED).otherwise(F.col("condition")).cast("int").alias("condition"), name)


def hesitation_times(detections: DataFrame, segments: DataFrame, person: int = PERSON, step: int = 10, least: int = 3, digits: int | None = None, slack: float = 0.0, fix_known_defects: bool = False) -> DataFrame:
    """Seconds that a person track stands still before it moves.

    Every ``step`` rows x is compared with x a step on. A step is still if it moves no
    further than a tenth of the mean box height; the first run of ``least`` or more still steps
    counts if a moving step ends it and it isn't longer than 0.9 of the frame rate. Tracks
    that start in the right half never emit unless ``fix_known_defects``: the test
    there is reversed, so it only holds where the margin is 0. digits and slack
    round the margin and widen it, for comparisons across engines.
    """
    w = Window.partitionBy(*TRACK).orderBy("row_idx")
    whole = Window.partitionBy(*TRACK)
    margin = 0.1 * F.avg("height").over(whole)
    if digits is not None:
        margin = F.round(margin, digits)
    people = detections.where((F.col("yolo_id") == person) & F.col("unique_id").isNotNull())
    rows = people.select(*TRACK, "row_idx", "x", F.row_number().over(w).alias("rn"), F.lead("x", step).over(w).alias("next"), F.first("x").over(w).alias("x0"), margin.alias("m"))
    rows = rows.where(f"(rn - 1) % {step} = 0 and next is not null")
    m = F.col("m") + slack
    still = (F.col("next") >= F.col("x") - m) & (F.col("next") <= F.col("x") + m)
    if not fix_known_defects:
        still = F.when(F.col("x0") < 0.5, still).otherwise((F.col("next") <= F.col("x") - m) & (F.col("next") >= F.col("x") + m))
    rows = rows.withColumn("still", F.coalesce(still, F.lit(False)))
    rows = rows.withColumn("run", F.sum((~F.col("still")).cast("int")).over(Window.partitionBy(*TRACK).orderBy("rn")))
    rows = rows.withColumn("runs", F.max("run").over(whole))
    runs = rows.where("still and run < runs").groupBy(*TRACK, "run").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    first = runs.groupBy(*TRACK).agg(F.min_by("n", "run").alias("n"))
    where = segments.select(*SEGMENT, "country", F.col("time_of_day").alias("condition"), "fps")
    return first.join(where, SEGMENT).where("n <= 0.9 * fps").select(*TRACK, "country", "condition", (F.col("n") / (F.col("fps") / step)).alias("hesitation_s"))


def crossings_with_equipment(detections: DataFrame, shapes: DataFrame, classes: Sequence[int] = EQUIPMENT) -> DataFrame:
    """Whether any row between a track's first and last row of the segment is of the classes.

    Only the tracks' first rows and the equipment's are put in order: looking back from the segment's end, the
    last equipment row passed is the next one after a track began. So there is no range join, and the
    other detections aren't shuffled.
    """
    marks = detections.where(F.col("yolo_id").isin(list(classes))).select(*SEGMENT, "row_idx", F.col("row_idx").alias("at"))
    began = shapes.select(*SEGMENT, F.col("first_row").alias("row_idx"), "unique_id", "last_row")
    back = Window.partitionBy(*SEGMENT).orderBy(F.col("row_idx").desc(), F.col("unique_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    rows = began.unionByName(marks, allowMissingColumns=True).withColumn("next", F.min("at").over(back))
    return rows.where("unique_id is not null").select(*TRACK, F.coalesce(F.col("next") <= F.col("last_row"), F.lit(False)).alias("equipped"))


def equipment_by_condition(equipped: DataFrame, segments: DataFrame) -> DataFrame:
    """Crossings with and without equipment and the seconds of all segments, by country and condition."""
    per = equipped.groupBy(*SEGMENT).agg(F.count_if("equipped").alias("with"), F.count_if(~F.col("equipped")).alias("without"))
    rows = segments.join(per, SEGMENT, "left").withColumn("condition", F.col("time_of_day"))
    return rows.groupBy("country", "condition").agg(F.coalesce(F.sum("with"), F.lit(0)).alias("with_equipment"), F.coalesce(F.sum("without"), F.lit(0)).alias("without_equipment"), F.sum("duration").cast("long").alias("seconds"))


def light_share(detections: DataFrame, shapes: DataFrame, segments: DataFrame) -> DataFrame:
    """Percentage of crossings without a traffic light, each segment's counts being rates a minute."""
    lit_ = crossings_with_equipment(detections, shapes, (TRAFFIC_LIGHT,))
    per = lit_.groupBy(*SEGMENT).agg(F.count_if("equipped").alias("a"), F.count_if(~F.col("equipped")).alias("b"))
    rows = per.join(segments, SEGMENT).withColumn("condition", F.col("time_of_day"))
    rows = rows.groupBy("country", "condition").agg(F.sum(F.col("a") * 60 / F.col("duration")).alias("a"), F.sum(F.col("b") * 60 / F.col("duration")).alias("b"))
    return rows.where("a + b <> 0").select("country", "condition", (100 * F.col("b") / (F.col("a") + F.col("b"))).alias("without_light_pct"))


def per_minute_and_person(counts: DataFrame, persons: DataFrame) -> DataFrame:
    """with/without counts a minute and for each person, where both sides have the group."""
    rate = lambda c: F.try_divide(F.try_divide(F.col(c) * 60, F.col("seconds")), F.col("persons"))
    return counts.join(persons, ["country", "condition"]).select("country", "condition", rate("with_equipment").alias("with_rate"), rate("without_equipment").alias("without_rate"))


def crossings_by_condition(counts: DataFrame, segments: DataFrame) -> DataFrame:
    """Crossings by country and condition; segments without any count as 0."""
    rows = segments.join(counts, SEGMENT, "left").withColumn("condition", F.col("time_of_day"))
    return rows.groupBy("country", "condition").agg(F.coalesce(F.sum("crossings"), F.lit(0)).alias("crossings"))


def trails(detections: DataFrame, points: int = 30) -> DataFrame:
    """The last positions of a track up to each row."""
    w = Window.partitionBy(*TRACK).orderBy("row_idx").rowsBetween(1 - points, 0)
    return detections.where("unique_id is not null").select(*TRACK, "row_idx", F.collect_list(F.struct("x", "y")).over(w).alias("trail"))
