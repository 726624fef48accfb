"""Counts and rates by segment, city, and country and condition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.events import SEGMENT
from kerbline.sources.schemas import BICYCLE, BUS, CAR, CELLPHONE, CLASS_NAMES, EQUIPMENT, MOTORCYCLE, PERSON, TRUCK


def class_tracks(detections: DataFrame) -> DataFrame:
    """Every class and id of a segment once, equipment rows one by one: what all counts need of the detections."""
    equipment = F.when(F.col("yolo_id").isin(list(EQUIPMENT)), F.col("row_idx"))
    return detections.select(*SEGMENT, "yolo_id", "unique_id", equipment.alias("row_idx")).distinct()


def object_counts(detections: DataFrame) -> DataFrame:
    """Distinct tracks of every class by segment, one column a class; of detections or their ``class_tracks``."""
    once = detections.where("unique_id is not null").select(*SEGMENT, "yolo_id", "unique_id").distinct()
    return once.groupBy(*SEGMENT).agg(*[F.count_if(F.col("yolo_id") == k).alias(name) for k, name in CLASS_NAMES.items()])


def city_totals(counts: DataFrame, segments: DataFrame) -> DataFrame:
    """Counts and seconds by city id, and over all as id null."""
    rows = counts.join(segments.select(*SEGMENT, "id", "duration"), SEGMENT)
    return rows.rollup("id").agg(*[F.sum(n).cast("long").alias(n) for n in CLASS_NAMES.values()], F.sum("duration").cast("long").alias("total_time"))


def distinct_with_null(value: Column, when: Column) -> Column:
    """Distinct values under a condition, null being one of them."""
    return F.countDistinct(F.when(when, value)) + F.coalesce(F.max(F.when(when, value.isNull().cast("int"))), F.lit(0))


def traffic_classes(person: bool = False, bicycle: bool = False, motorcycle: bool = False, car: bool = False, bus: bool = False, truck: bool = False, fix_known_defects: bool = False) -> tuple[int, ...]:
    """The class codes a choice of flags counts; unless fixed, car and motorcycle codes are swapped when asked alone."""
    if motorcycle and car and bus and truck:
        return (CAR, MOTORCYCLE, BUS, TRUCK)
    swap = not fix_known_defects
    chosen = ((person, PERSON), (bicycle, BICYCLE), (motorcycle, CAR if swap else MOTORCYCLE), (car, MOTORCYCLE if swap else CAR), (bus, BUS), (truck, TRUCK))
    return tuple(code for flag, code in chosen if flag)


def segment_rates(detections: DataFrame, segments: DataFrame, classes: Sequence[int], fix_known_defects: bool = False) -> DataFrame:
    """Distinct ids of the classes a minute, for every segment that has detections."""
    is_one = F.col("yolo_id").isin(list(classes))
    n = F.countDistinct(F.when(is_one, F.col("unique_id"))) if fix_known_defects else distinct_with_null(F.col("unique_id"), is_one)
    rows = detections.groupBy(*SEGMENT).agg(n.alias("n")).join(segments, SEGMENT)
    return rows.select(*SEGMENT, "country", F.col("time_of_day").alias("condition"), "n", "duration", (F.col("n") * 60 / F.col("duration")).alias("rate"))


def halving_mean(rates: DataFrame) -> DataFrame:
    """(previous + next) / 2 over a group's segments in order, as a weighted sum.

    Of k rates the first two weigh 2^(1 - k), and each later one twice the one before.
    """
    order = Window.partitionBy("country", "condition").orderBy(*SEGMENT)
    rows = rates.select("country", "condition", "rate", F.row_number().over(order).alias("i"), F.count("*").over(Window.partitionBy("country", "condition")).alias("k"))
    weight = F.pow(F.lit(2.0), F.greatest(F.col("i"), F.lit(2)) - F.col("k") - 1)
    return rows.groupBy("country", "condition").agg(F.sum(F.col("rate") * F.when(F.col("k") == 1, 1.0).otherwise(weight)).alias("traffic"))


def pooled_rate(rates: DataFrame, name: str) -> DataFrame:
    """Objects a minute over all seconds of a group."""
    return rates.groupBy("country", "condition").agg((F.sum("n") * 60 / F.sum("duration")).alias(name))


def traffic(detections: DataFrame, segments: DataFrame, classes: Sequence[int], fix_known_defects: bool = False) -> DataFrame:
    rates = segment_rates(detections, segments, classes, fix_known_defects)
    return pooled_rate(rates, "traffic") if fix_known_defects else halving_mean(rates)


def last_crossings(counts: DataFrame) -> DataFrame:
    """One row: the crossings of the last segment in order that has any."""
    return counts.agg(F.coalesce(F.max_by("crossings", F.struct(*SEGMENT)), F.lit(0)).alias("last"))


def traffic_signs(detections: DataFrame, segments: DataFrame, last: DataFrame, fix_known_defects: bool = False) -> DataFrame:
    """Equipment a minute; unless fixed, divided by the crossing count of the last segment seen (``last_crossings``)."""
    rates = segment_rates(detections, segments, EQUIPMENT, fix_known_defects)
    if fix_known_defects:
        return pooled_rate(rates, "traffic_signs")
    order = Window.partitionBy("country", "condition").orderBy(*SEGMENT)
    rows = rates.withColumn("i", F.row_number().over(order)).groupBy("country", "condition")
    rows = rows.agg(F.count("*").alias("k"), F.max(F.when(F.col("i") == 1, F.col("rate"))).alias("v1"), F.sum(F.when(F.col("i") > 1, F.col("rate"))).alias("rest"))
    value = F.when(F.col("k") == 1, F.col("v1")).when(F.col("last") == 0, F.lit(0.0)).otherwise(F.try_divide("rest", F.col("last") * (F.col("k") - 1)))
    return rows.crossJoin(F.broadcast(last)).select("country", "condition", value.alias("traffic_signs"))  # last is one row


def cell_phones(counts: DataFrame, segments: DataFrame) -> DataFrame:
    """Phones a minute and for a thousand persons, over segments that have both."""
    rows = counts.where("person > 0 and cellphone > 0").join(segments, SEGMENT).withColumn("condition", F.col("time_of_day"))
    return rows.groupBy("country", "condition").agg((F.sum("cellphone") * 60 / F.sum("duration") / F.sum("person") * 1000).alias("cell_phones"))


__all__ = ["CELLPHONE", "cell_phones", "city_totals", "class_tracks", "distinct_with_null", "halving_mean", "last_crossings", "object_counts", "pooled_rate", "segment_rates", "traffic", "traffic_classes", "traffic_signs"]
