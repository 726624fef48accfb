"""Statistics: rank correlation, thinning, histograms, regression, quartiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spearman(rows: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(row, col, rho) of every pair, over rows that have both; null where one side is constant.

    One pass for all pairs: rows are spread over the pairs they are complete in, ranked
    within their pair with ties at their mean rank, and correlated by group.
    """
    numbers = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in features]
    pairs = F.array(*[F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), numbers[i].alias("x"), numbers[j].alias("y")) for i, a in enumerate(features) for j, b in enumerate(features)])
    long = rows.select(*by, F.explode(pairs).alias("p")).select(*by, "p.*").where("x is not null and y is not null")
    group = [*by, "row", "col"]

    def ranked(c: str):
        mean = F.rank().over(Window.partitionBy(*group).orderBy(c)) + (F.count("*").over(Window.partitionBy(*group, c)) - 1) / 2
        return mean.cast("double")

    both = long.withColumn("rx", ranked("x")).withColumn("ry", ranked("y"))
    sums = both.groupBy(*group).agg(F.count("*").alias("n"), F.covar_pop("rx", "ry").alias("c"), F.stddev_pop("rx").alias("a"), F.stddev_pop("ry").alias("b"))
    return sums.select(*group, F.try_divide("c", F.col("a") * F.col("b")).alias("rho"))


def wide_features(metrics: DataFrame, features: Sequence[str], zero: Sequence[str] = ()) -> DataFrame:
    """country and {feature}_{condition}; what is missing is 0 for the features named so, else null."""
    wide = metrics.groupBy("country").pivot("condition", [0, 1]).agg(*[F.first(f).alias(f) for f in features])
    if len(features) == 1:
        wide = wide.withColumnsRenamed({"0": f"0_{features[0]}", "1": f"1_{features[0]}"})
    wide = wide.withColumnsRenamed({f"{c}_{f}": f"{f}_{c}" for c in (0, 1) for f in features})
    return wide.withColumns({f"{f}_{c}": F.coalesce(f"{f}_{c}", F.lit(0.0)) for f in zero for c in (0, 1)}) if zero else wide


def select_features(columns: Sequence[str], mark: str = "0", without: Sequence[str] = ("speed_val", "time_val", "continent")) -> list[str]:
    """Columns whose name has the mark and none of the words."""
    return [c for c in columns if mark in c and not any(w in c for w in without)]


def _grid_level(points: DataFrame, left: DataFrame, key: str, cells: int) -> DataFrame:
    """Nearest other point of ``left`` in its own and the adjoining cells of a grid; side of a cell as _s."""
    size = F.when(F.col("side") > 0, F.col("side") / cells).otherwise(F.lit(1.0))

    def binned(rows: DataFrame) -> DataFrame:
        cell = lambda c, low: F.floor((F.col(c) - F.col(low)) / size)
        return rows.select("*", size.alias("_s"), cell("_x", "_ax").alias("_i"), cell("_y", "_ay").alias("_j"))

    shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = binned(left).select("*", F.explode(shifts).alias("_d")).withColumns({"_i": F.col("_i") + F.col("_d.a"), "_j": F.col("_j") + F.col("_d.b")}).drop("_d")
    other = binned(points).select(F.col(key).alias("_k"), F.col("_x").alias("_u"), F.col("_y").alias("_v"), F.col("_i").alias("_a"), F.col("_j").alias("_b"))
    far = F.sqrt((F.col("_x") - F.col("_u")) * (F.col("_x") - F.col("_u")) + (F.col("_y") - F.col("_v")) * (F.col("_y") - F.col("_v")))
    met = near.join(other, (F.col("_i") == F.col("_a")) & (F.col("_j") == F.col("_b")) & (F.col(key) != F.col("_k")), "left")
    return met.groupBy(key, "_x", "_y", "_ax", "_ay", "side", "_s").agg(F.min(far).alias("d"))


def _grids(n: int) -> list[int]:
    """Cells along a side, from well below one point a cell to the whole, by steps of eight."""
    finest = 1
    while finest * finest < 64 * n:
        finest *= 8
    return [finest >> k for k in range(0, finest.bit_length(), 3)]


def thin_labels(points: DataFrame, key: str, x: str, y: str, factor: float = 1.0, grids: Sequence[int] | None = None) -> DataFrame:
    """Distance to the nearest other point, and whether it exceeds the mean distance by the factor.

    Places that several points share have distance 0. The different places are binned to a grid, so fine that most
    cells are empty (``_grids`` of their number), and meet those of their own and the adjoining cells by an
    equi-join; a hit within a cell's side is proven nearest. The others go on to a
    coarser grid. They lie apart by more than a cell's side, so they are at most 64 for
    each coarser cell, and a level costs no more than a few times the places. One point
    alone is infinitely far.
    """
    spot = points.select(key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    places = spot.groupBy("_x", "_y").agg(F.count("*").alias("_n"))
    if grids is None:
        grids = _grids(places.count())
    box = places.agg(F.min("_x").alias("_ax"), F.min("_y").alias("_ay"), F.greatest(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y")).alias("side"))
    rows = places.select(F.struct("_x", "_y").alias("_p"), "_x", "_y", "_n").crossJoin(F.broadcast(box))  # box is one row
    left, nearest = rows.where("_n = 1").drop("_n"), rows.where("_n > 1").select("_p", F.lit(0.0).alias("d"))
    every = rows.drop("_n")
    for cells in grids:
        met = _grid_level(every, left, "_p", cells)
        sure = met.select("_p", "d") if cells == grids[-1] else met.where("d <= _s").select("_p", "d")
        nearest = nearest.unionByName(sure)
        left = met.where("d is null or d > _s").drop("_s", "d")
    found = nearest.select(F.col("_p._x").alias("_u"), F.col("_p._y").alias("_v"), F.coalesce("d", F.lit(float("inf"))).alias("d"))
    each = spot.join(found, (F.col("_x") == F.col("_u")) & (F.col("_y") == F.col("_v"))).select(key, "d")
    mean = each.agg((F.avg("d") * factor).alias("_m"))
    return points.join(each.crossJoin(F.broadcast(mean)).select(key, F.col("d").alias("nn_distance"), (F.col("d") > F.col("_m")).alias("labelled")), key)


def trend(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line and its r squared."""
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def quartiles(rows: DataFrame, column: str) -> DataFrame:
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.agg(q.alias("q")).select(*[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def histogram(rows: DataFrame, column: str, bins: int, low: float, high: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows by bin 1..bins of equal width; 0 and bins + 1 hold what lies outside."""
    return rows.where(F.col(column).isNotNull()).groupBy(*by, F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def spread(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation, which is 0 for one value."""
    there = rows.where(F.col(column).isNotNull())
    return there.groupBy(*by).agg(F.avg(column).alias("mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("sd"))


def arg_extremes(rows: DataFrame, name: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Names of the largest and smallest value; ties go to the first name."""
    low = F.min(F.struct(F.col(value).alias("v"), F.col(name).alias("n")))
    high = F.min(F.struct((-F.col(value)).alias("v"), F.col(name).alias("n")))
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(high["n"].alias("argmax"), low["n"].alias("argmin"))


def axis_max(rows: DataFrame, *columns: str) -> DataFrame:
    """Largest sum of a row's bars; nothing counts as 0."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return rows.agg(F.coalesce(F.max(total), F.lit(0.0)).alias("axis_max"))
