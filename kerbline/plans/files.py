"""Registered queries that write files and read them back, and those of ids with no query of their own in ``registry``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import scalars as S
from kerbline.functions import stats as T
from kerbline.operators import events as E
from kerbline.operators import mapping as M
from kerbline.operators import rollup as R
from kerbline.plans import plots
from kerbline.plans import views as V
from kerbline.plans.registry import _HESITATION, _PAIRED, _with, query
from kerbline.sources import scans, sinks
from kerbline.sources.staging import shared_path


def _named_files(rows: DataFrame, folder: str, name: str, write) -> None:
    """One file for each value of ``name``, called so: Spark's part files are moved, one a segment of the fixture."""
    spark = rows.sparkSession
    write(rows.coalesce(1).write.partitionBy(name), f"{folder}-parts")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for status in fs.globStatus(path(f"{folder}-parts/{name}=*/part-*")):
        at = status.getPath()
        fs.rename(at, path(f"{folder}/{re.sub(f'^{name}=', '', at.getParent().getName())}"))


# ---- sources and sinks -------------------------------------------------------


@query("SRC1F", _with(V.DETECTIONS, V.MAPPING) + """, videos AS (SELECT row_idx, iso3, unnest(regexp_extract_all(videos, '[\\w-]+')) AS video_id FROM mapping),
  wanted AS (SELECT video_id FROM (SELECT * FROM videos QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY row_idx) = 1) WHERE lower(iso3) IN ('ame', 'asi'))
SELECT video_id, start_time, count(*) AS n, sum(yolo_id)::BIGINT AS codes, count(unique_id) AS tracked, round(sum(x), 6) AS x FROM detections WHERE video_id IN (SELECT video_id FROM wanted) AND NOT (video_id = 'v2' AND event_id_odd) GROUP BY ALL""".replace("event_id_odd", "start_time = 0 AND row_idx % 2 = 1"))
def src1f(spark, sf):
    """Detection files of two folders: of a segment in both, that of the second counts."""
    rows = V.detections(spark, sf)
    head = rows.select(F.concat("video_id", F.lit("_"), F.col("start_time").cast("string"), F.lit(".csv")).alias("file"), "yolo_id", "x", "y", F.lit(0.1).alias("width"), "height", "unique_id", F.lit(1).alias("frame_count"), "video_id", "start_time", "row_idx")
    csv = lambda w, at: w.option("header", True).csv(at)
    one, two = shared_path(spark, "detections-1"), shared_path(spark, "detections-2")
    _named_files(head.drop("video_id", "start_time", "row_idx"), one, "file", csv)
    _named_files(head.where("video_id = 'v2' and start_time = 0 and row_idx % 2 = 0").drop("video_id", "start_time", "row_idx"), two, "file", csv)
    read = scans.scan_detections(spark, [one, f"{one}-absent", two], V.mapping(spark, sf), ["ame", "ASI"])
    return read.groupBy("video_id", "start_time").agg(F.count("*").alias("n"), F.sum("yolo_id").cast("long").alias("codes"), F.count("unique_id").alias("tracked"), F.round(F.sum("x"), 6).alias("x"))


_MAP_COLUMNS = "id, city, state, country, continent, iso3, videos, start_time, end_time, time_of_day, fps_list, gini, lat"


def _written_mapping(spark: SparkSession, sf: str) -> str:
    path = shared_path(spark, "mapping")
    from kerbline.sources.schemas import MAPPING_CSV

    rows = V.mapping(spark, sf)
    full = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in MAPPING_CSV.fields])
    sinks.rewrite_mapping(full, "elsewhere", path)
    return path


@query("SRC2", _with(V.MAPPING) + f"SELECT {_MAP_COLUMNS} FROM mapping WHERE iso3 IN ('AFR', 'ASI')")
def src2(spark, sf):
    return scans.scan_mapping(spark, _written_mapping(spark, sf), ["AFR", "ASI"]).select(*_MAP_COLUMNS.split(", "))


@query("SNK4", _with(V.MAPPING) + f"SELECT {_MAP_COLUMNS} FROM mapping")
def snk4(spark, sf):
    return scans.scan_mapping(spark, _written_mapping(spark, sf)).select(*_MAP_COLUMNS.split(", "))


@query("SRC4", _with(V.DETECTIONS) + "SELECT (row_idx % 20)::INT AS frame_count, count(*) AS n, sum(yolo_id)::BIGINT AS codes, round(sum(x), 6) AS x, count(unique_id) AS tracked FROM detections GROUP BY ALL")
def src4(spark, sf):
    rows = V.detections(spark, sf).select(F.concat(F.lit("label_"), (F.col("row_idx") % 20).cast("string"), F.lit(".txt")).alias("file"), "yolo_id", "x", "y", F.lit(0.1).alias("width"), "height", "unique_id")
    folder = shared_path(spark, "labels")
    _named_files(rows, folder, "file", lambda w, at: w.option("sep", " ").csv(at))
    return scans.scan_labels(spark, folder).groupBy("frame_count").agg(F.count("*").alias("n"), F.sum("yolo_id").cast("long").alias("codes"), F.round(F.sum("x"), 6).alias("x"), F.count("unique_id").alias("tracked"))


_CONFIG = '{"data": ["one", "two"], "mapping": "m.csv", "countries_analyse": ["AFR"], "boundary_left": 0.4, "other": 1}'


@query("SRC5", "SELECT 'm.csv' AS mapping, 2 AS folders, 'AFR' AS countries, 0.4::DOUBLE AS boundary_left, 0.55::DOUBLE AS boundary_right")
def src5(spark, sf):
    c = scans.load_config(_CONFIG, '{"data": 0, "mapping": 0}')
    return spark.range(1).select(F.lit(c.mapping).alias("mapping"), F.lit(len(c.data)).alias("folders"), F.lit(",".join(c.countries_analyse)).alias("countries"), F.lit(c.boundary_left).alias("boundary_left"), F.lit(c.boundary_right).alias("boundary_right"))


def _result(spark, sf, name):
    folder = shared_path(spark, "results")
    sinks.write_results({"speeds": V.metrics(spark, sf).select("country", "condition", "speed"), "times": V.metrics(spark, sf).select("country", "condition", "time")}, folder)
    return scans.scan_result(spark, folder, name)


@query("SRC6", _with(V.METRICS) + "SELECT country, condition, speed FROM metrics")
def src6(spark, sf):
    return _result(spark, sf, "speeds")


@query("SNK3", _with(V.METRICS) + "SELECT country, condition, time FROM metrics")
def snk3(spark, sf):
    return _result(spark, sf, "times")


@query("SRC7", "SELECT substr(n_name, 8) AS iso3, r_name AS name, 2020 + r_regionkey AS year, n_nationkey / 2.0::DOUBLE AS value FROM nation JOIN region ON n_regionkey >= r_regionkey QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY r_regionkey DESC) = 1")
def src7(spark, sf):
    """An indicator feed of several years a country, dropped as CSV; the newest year counts."""
    n, r = V.table(spark, sf, "nation"), V.table(spark, sf, "region")
    feed = n.join(r, n.n_regionkey >= r.r_regionkey).select(F.substring("n_name", 8, 99).alias("iso3"), F.col("r_name").alias("name"), (2020 + F.col("r_regionkey")).cast("int").alias("year"), (F.col("n_nationkey") / 2).alias("value"))
    path = shared_path(spark, "feed")
    sinks.write_csv(feed, path)
    return scans.latest_per_key(scans.scan_indicator(spark, path))


@query("SRC11", "SELECT r_name AS country, n_name AS cca3, 160.0::DOUBLE + n_nationkey AS height_male, 150.5::DOUBLE + n_nationkey AS height_female, n_nationkey::DOUBLE AS height_rank FROM nation JOIN region ON n_regionkey = r_regionkey")
def src11(spark, sf):
    n, r = V.table(spark, sf, "nation"), V.table(spark, sf, "region")
    k = F.col("n_nationkey")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("place"), k.alias("pop2023"), F.lit(0.1).alias("growthRate"), k.alias("area"), F.col("r_name").alias("country"), F.col("n_name").alias("cca3"), F.lit("X").alias("cca2"), k.alias("ccn3"), F.lit("R").alias("region"), F.lit("S").alias("subregion"), k.alias("landAreaKm"), k.alias("density"), k.alias("densityMi"), k.alias("pop_rank"), F.lit(2019).alias("year"), (160.0 + k).alias("meanHeightMale"), (150.5 + k).alias("meanHeightFemale"), k.alias("rank"))
    path = shared_path(spark, "heights")
    sinks.write_csv(rows, path)
    return scans.scan_heights(spark, path).select("country", "cca3", "height_male", "height_female", "height_rank")


@query("SNK1", _with(V.DETECTIONS) + "SELECT video_id, start_time, row_idx, yolo_id, x, unique_id FROM detections")
def snk1(spark, sf):
    rows = V.detections(spark, sf).select("video_id", "start_time", "row_idx", "yolo_id", "x", "unique_id")
    path = shared_path(spark, "appended")
    for half in (0, 1):
        sinks.append_detections(rows.where(F.col("row_idx") % 2 == half), path)
    return spark.read.parquet(path).select(rows.columns)


@query("SNK2", _with(V.METRICS) + "SELECT country, condition, people FROM metrics")
def snk2(spark, sf):
    path = shared_path(spark, "report")
    sinks.write_csv(V.metrics(spark, sf).select("country", "condition", "people"), path)
    return spark.read.schema("country string, condition int, people long").csv(path, header=True)


# ---- filters, projections, sets ----------------------------------------------


@query("FLT8", _with(V.METRICS) + "SELECT country, condition, speed FROM metrics WHERE people % 3 <> 0")
def flt8(spark, sf):
    m = V.metrics(spark, sf).withColumn("speed", F.when(F.col("people") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("speed")))
    return plots.without_nan(m, "speed").select("country", "condition", "speed")


@query("FLT11", _with(V.MAPPING) + "SELECT id, traffic_index FROM mapping WHERE traffic_index <> 0")
def flt11(spark, sf):
    return plots.nonzero(V.mapping(spark, sf), "traffic_index").select("id", "traffic_index")


@query("PRJ3", _with(V.METRICS, _PAIRED) + """SELECT country, speed_0 AS "Speed by day", speed_1 AS "Speed at night" FROM paired""")
def prj3(spark, sf):
    return T.wide_features(V.metrics(spark, sf), ["speed"]).withColumnsRenamed({"speed_0": "Speed by day", "speed_1": "Speed at night"})


@query("PRJ6", _with(V.MAPPING) + "SELECT * EXCLUDE (lat, lon, videos, start_time, end_time, time_of_day, fps_list) FROM mapping")
def prj6(spark, sf):
    rows = V.mapping(spark, sf)
    return rows.select(plots.hover_columns(rows, ["lat", "lon", "videos", "start_time", "end_time", "time_of_day", "fps_list", "absent"]))


@query("SET3", "SELECT unnest(['o_orderstatus', 'o_orderpriority', 'o_totalprice']) AS name")
def set3(spark, sf):
    rows = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return spark.createDataFrame([(c,) for c in plots.hover_columns(rows, ["o_orderkey", "o_custkey"])], "name string")


@query("STA4", "SELECT unnest(['speed_0', 'time_0', 'gini_0']) AS name")
def sta4(spark, sf):
    names = ["speed_0", "speed_1", "time_0", "speed_val_0", "gini_0", "continent_0", "avg_day_night_speed"]
    return spark.createDataFrame([(c,) for c in T.select_features(names)], "name string")


@query("STA9", _with(V.METRICS) + "SELECT country, abs(max(speed) FILTER (condition = 0) - max(speed) FILTER (condition = 1)) AS diff FROM metrics GROUP BY country HAVING diff IS NOT NULL")
def sta9(spark, sf):
    return R.day_night(V.metrics(spark, sf), "speed").select("country", "diff")


# ---- joins and windows -------------------------------------------------------


@query("JN4", _with(V.METRICS) + "SELECT a.country, a.condition, a.speed, b.time FROM metrics a JOIN metrics b USING (country, condition) WHERE b.condition = 0 OR b.people % 2 = 0")
def jn4(spark, sf):
    m = V.metrics(spark, sf)
    times = m.where("condition = 0 or people % 2 = 0").select("country", "condition", "time")
    both = plots.joined_metrics(m.select("country", "condition", "speed"), times)
    return both.select("country", "condition", "speed", "time")


@query("JN11", "WITH p AS (SELECT c_custkey AS id, c_acctbal AS x, (c_custkey * 7919 % 10007)::DOUBLE AS y FROM customer) SELECT a.id, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS distance FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id")
def jn11(spark, sf):
    """Each customer's nearest other one in the plane of balance and a scrambled key."""
    points = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 7919 % 10007).cast("double").alias("y"))
    return T.thin_labels(points, "id", "x", "y").select("id", F.round("nn_distance", 6).alias("distance"))


@query("JN12", _with(V.MAPPING) + "SELECT id, min(lower(city) || '.' || e) AS file FROM mapping, (SELECT unnest(['png', 'jpg']) AS e) WHERE id % 3 <> 1 GROUP BY id")
def jn12(spark, sf):
    mapping = V.mapping(spark, sf)
    files = mapping.where("id % 3 <> 1").select(F.explode(F.array(*[F.concat(F.lower("city"), F.lit(f".{e}")) for e in ("png", "jpg")])).alias("file"))
    return M.screenshot_of(mapping, files)


@query("WIN3", _with(V.SLOW_TRACKS, V.SEGMENTS, _HESITATION) + "SELECT unique_id, n::BIGINT AS n FROM hesitation JOIN (SELECT DISTINCT unique_id AS u FROM slow_tracks) ON u = unique_id")
def win3(spark, sf):
    got = E.hesitation_times(V.slow_tracks(spark, sf), V.segments(spark, sf).withColumn("fps", F.col("fps")), digits=9, slack=1e-9)
    fps = V.segments(spark, sf).select(*E.SEGMENT, "fps")
    return got.join(fps, E.SEGMENT).select("unique_id", F.round(F.col("hesitation_s") * F.col("fps") / 10).cast("long").alias("n"))


@query("WIN5", _with(V.DETECTIONS) + "SELECT row_idx, round(list_sum(list(x) OVER w), 6) AS x, round(list_sum(list(y) OVER w), 6) AS y FROM detections WHERE unique_id IS NOT NULL WINDOW w AS (PARTITION BY video_id, start_time, unique_id ORDER BY row_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def win5(spark, sf):
    total = lambda c: F.round(F.aggregate("trail", F.lit(0.0), lambda s, p: s + p[c]), 6).alias(c)
    return E.trails(V.detections(spark, sf)).select("row_idx", total("x"), total("y"))


# ---- driver-side helpers of figures ------------------------------------------


@query("SCL24")
def scl24(spark, sf):
    """Labels of the first cities, raised where they are near an earlier one; a step depends on those before, so there is no SQL."""
    rows = V.mapping(spark, sf).where("lat is not null").orderBy("id").select("city", (F.col("lon") / 180).alias("x"), (F.col("lat") / 90).alias("y")).collect()  # a chart's labels
    return spark.createDataFrame([(a["city"], a["x"], a["y"]) for a in S.adjust_annotations([r.asDict() for r in rows])], "city string, x double, y double")


@query("SCL25", "SELECT r_name AS item, 0.1::DOUBLE AS x, round(0.9::DOUBLE - 0.05::DOUBLE * (row_number() OVER (ORDER BY r_name) - 1), 9) AS y FROM region")
def scl25(spark, sf):
    names = [r[0] for r in V.table(spark, sf, "region").select("r_name").orderBy("r_name").collect()]  # five regions
    placed = spark.createDataFrame(S.legend_positions(names, 0.1, 0.9, 0.05), "item string, x double, y double")
    return placed.withColumn("y", F.round("y", 9))
