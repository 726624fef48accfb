"""Country roll-up, write-back of metrics, enrichment, orders and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.scalars import title_case
from kerbline.sources.schemas import DAY, NIGHT, POOLED

# The columns of the country table by how they are rolled up.
FIRST = ("country", "continent", "population_country", "traffic_mortality", "literacy_rate", "avg_height", "gini", "traffic_index")
LISTS = ("videos", "time_of_day", "start_time", "end_time", "vehicle_type", "upload_date", "fps_list")
SUMS = ("person", "bicycle", "car", "motorcycle", "bus", "truck", "cellphone", "traffic_light", "stop_sign", "total_time", "total_videos")
MEANS = (
    "speed_crossing", "speed_crossing_day", "speed_crossing_night", "time_crossing", "time_crossing_day", "time_crossing_night", "speed_crossing_avg", "time_crossing_avg",
    "with_trf_light_day", "with_trf_light_night", "without_trf_light_day", "without_trf_light_night",
    "with_trf_light_norm_day", "with_trf_light_norm_night", "without_trf_light_norm_day", "without_trf_light_norm_night",
)


def first_value(column: str, order: str) -> Column:
    """The first value that isn't null."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def ordered_list(column: str, order: str) -> Column:
    """All values in order, nulls kept."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("v")))), lambda s: s["v"])


def roll_up(rows: DataFrame, key: str = "iso3", order: str = "row_idx", first: Sequence[str] = FIRST, lists: Sequence[str] = LISTS, sums: Sequence[str] = SUMS, means: Sequence[str] = MEANS) -> DataFrame:
    """One row for each key that isn't null: first, list, sum (nothing: 0) and mean columns."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[first_value(c, order).alias(c) for c in first],
        *[ordered_list(c, order).alias(c) for c in lists],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        *[F.avg(c).alias(c) for c in means],
    )


def write_back(rows: DataFrame, metric: DataFrame, value: str, name: str, pooled: bool = False) -> DataFrame:
    """{name}_day and {name}_night (and {name}_avg of the pooled level) by country; 0 where there is none."""
    wide = metric.groupBy("country").pivot("condition", [DAY, NIGHT, POOLED] if pooled else [DAY, NIGHT]).agg(F.first(value))
    names = {str(DAY): f"{name}_day", str(NIGHT): f"{name}_night"} | ({str(POOLED): f"{name}_avg"} if pooled else {})
    wide = wide.withColumnsRenamed(names)
    return rows.join(F.broadcast(wide), "country", "left").withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names.values()})


def enrich(rows: DataFrame, feed: DataFrame, value: str, key: str = "iso3") -> DataFrame:
    """The feed's value where it has one, else the old one."""
    new = feed.select(key, F.col(value).alias("_new"))
    return rows.join(F.broadcast(new), key, "left").withColumn(value, F.coalesce("_new", value) if value in rows.columns else F.col("_new")).drop("_new")


def overwrite(rows: DataFrame, feed: DataFrame, value: str, key: str = "iso3") -> DataFrame:
    """The feed's value, null where it has none."""
    return rows.drop(value).join(F.broadcast(feed.select(key, value)), key, "left")


def by_continent(rows: DataFrame, then: str) -> DataFrame:
    return rows.orderBy(F.col("continent").asc_nulls_last(), F.col(then).asc_nulls_last())


def country_table(rows: DataFrame) -> DataFrame:
    """The final product: rolled up, sorted by continent and country, names in title case."""
    return by_continent(roll_up(rows), "country").withColumn("country", title_case(F.col("country")))


def day_night(metric: DataFrame, value: str) -> DataFrame:
    """country, day, night, diff of countries that have both."""
    wide = metric.groupBy("country").pivot("condition", [DAY, NIGHT]).agg(F.first(value)).withColumnsRenamed({"0": "day", "1": "night"})
    return wide.na.drop(subset=["day", "night"]).withColumn("diff", F.abs(F.col("day") - F.col("night")))


def extremes(rows: DataFrame, by: str = "diff", k: int = 5, tie: str = "country") -> tuple[DataFrame, DataFrame]:
    """Top k in falling order, and the last k of that order."""
    top = rows.orderBy(F.col(by).desc(), F.col(tie)).limit(k)
    bottom = rows.orderBy(F.col(by).asc(), F.col(tie).desc()).limit(k).orderBy(F.col(by).desc(), F.col(tie))
    return top, bottom


def derived_row(rows: DataFrame, column: str, source: str, target: str, keep: Sequence[str]) -> DataFrame:
    """Adds the source's row again under the target's name, other columns null."""
    extra = rows.where(F.col(column) == source).select(F.lit(target).alias(column), *[c for c in keep if c != column])
    return rows.unionByName(extra, allowMissingColumns=True)


def two_columns(rows: DataFrame, *order: Column) -> DataFrame:
    """side: 0 for the first half (the larger), 1 for the second; place inside the side."""
    w = Window.orderBy(*order)
    half = F.ceil(F.count("*").over(Window.partitionBy()) / 2)
    rows = rows.withColumn("_n", F.row_number().over(w))
    return rows.withColumns({"side": F.when(F.col("_n") <= half, 0).otherwise(1), "place": F.when(F.col("_n") <= half, F.col("_n")).otherwise(F.col("_n") - half).cast("int")}).drop("_n")
