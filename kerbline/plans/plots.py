"""Figures as tables: what a chart would draw, one row for each mark.

Windows without a partition number the rows of a chart, i.e. as many as countries or cities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import scalars as S
from kerbline.functions import stats as T
from kerbline.operators import rollup as R


def nonzero(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.coalesce(column, F.lit(0.0)) != 0)


def without_nan(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows that have a number in each of the columns, neither null nor NaN."""
    for c in columns:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c))
    return rows


def hover_columns(rows: DataFrame, hidden: Sequence[str]) -> list[str]:
    """What a chart shows of a row: all columns but the hidden ones, in order."""
    return [c for c in rows.columns if c not in set(hidden)]


def finite_rows(rows: DataFrame) -> DataFrame:
    """Rows without a null, NaN or infinity in any column."""
    numbers = [c for c, t in rows.dtypes if t in ("double", "float")]
    cleaned = rows.withColumns({c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)) for c in numbers})
    return cleaned.na.drop("any")


def per_million(count: Column, seconds: Column, persons: Column, slack: float = 0.0) -> Column:
    """count a second and person times a million, two decimals; ties may differ by 0.01 from binary rounding."""
    return F.round(F.try_divide(F.try_divide(count, seconds), persons) * 1_000_000 + slack, 2)


def alternate(rows: DataFrame, order: str) -> DataFrame:
    """Labels above and below their points in turn."""
    n = F.row_number().over(Window.orderBy(order))
    return rows.withColumn("position", F.when(n % 2 == 1, "top").otherwise("bottom"))


def choropleth(rows: DataFrame, color: str, name: str = "country", source: str = "Denmark", target: str = "Greenland", code: str = "GRL") -> DataFrame:
    """Coloured countries; the target takes its source's colour."""
    out = R.derived_row(nonzero(rows, color), name, source, target, [name, color])
    return out.withColumn("iso3", F.when(F.col(name) == target, code).otherwise(F.col("iso3")))


def city_points(mapping: DataFrame, names: dict[str, str]) -> DataFrame:
    return mapping.where("lon is not null and lat is not null").select("city", "lon", "lat").replace(names, subset=["city"])


def joined_metrics(speed: DataFrame, time: DataFrame) -> DataFrame:
    """Speed and time of the countries and conditions that have both."""
    return without_nan(speed.join(time, ["country", "condition"]), "speed", "time")


def paired_bars(speed: DataFrame, time: DataFrame) -> DataFrame:
    """Day and night speed and time of countries that have both metrics in a condition, dealt to two columns."""
    wide = T.wide_features(joined_metrics(speed, time), ["speed", "time"])
    return R.two_columns(wide, F.substring("country", 1, 1), F.col("country"))


def stacked_bars(metric: DataFrame, value: str, order_by: str = "alphabetical", data_view: str = "combined", least: float = 0.005) -> DataFrame:
    """country, day, night, mean and place of the bars of one metric, smaller ones left out."""
    if value not in ("speed", "time"):
        raise ValueError("the metric is speed or time")
    wide = without_nan(metric, value).groupBy("country").pivot("condition", [0, 1]).agg(F.first(value)).withColumnsRenamed({"0": "day", "1": "night"})
    wide = wide.withColumn("mean", S.safe_average("day", "night"))
    shown = {"day": ["day"], "night": ["night"], "combined": ["day", "night"]}[data_view]
    keep = F.lit(False)
    for c in shown:
        keep = keep | (F.coalesce(c, F.lit(0.0)) >= least)
    by = {"day": F.col("day"), "night": F.col("night"), "combined": F.col("mean")}[data_view]
    order = Window.orderBy("country") if order_by == "alphabetical" else Window.orderBy(by.desc_nulls_last(), "country")
    return wide.where(keep).withColumn("place", F.row_number().over(order))


def crossing_bars(counts: DataFrame, slack: float = 0.0) -> DataFrame:
    """Crossings by day and night a million seconds and persons, in two columns by falling mean."""
    rates = counts.select("country", "condition", per_million(F.col("crossings"), F.col("seconds"), F.col("persons"), slack).alias("rate"))
    wide = rates.groupBy("country").pivot("condition", [0, 1]).agg(F.first("rate")).withColumnsRenamed({"0": "day", "1": "night"})
    return R.two_columns(wide, S.safe_average("day", "night").desc(), F.col("country"))


def correlations(features: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The rank correlation matrix in long form, as a whole or by continent."""
    return T.spearman(features, columns, by)


def scatter(rows: DataFrame, key: str, x: str, y: str, factor: float = 1.0, order: str | None = None) -> DataFrame:
    """Complete points with thinned labels, positions in turn."""
    points = T.thin_labels(finite_rows(rows), key, x, y, factor)
    return alternate(points, order or key)


def hist(rows: DataFrame, columns: Sequence[str], bins: int, low: float, high: float, color: str | None = None) -> DataFrame:
    """Bin counts; one column may be split by a colour."""
    if color and len(columns) > 1:
        raise ValueError("a colour needs a single column")
    if len(columns) == 1:
        return T.histogram(rows, columns[0], bins, low, high, [color] if color else [])
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])).alias("z")).select("z.*")
    return T.histogram(long, "value", bins, low, high, ["variable"])
