"""The driver's tables seen as the engine's inputs, as DataFrames and as the same SQL.

``detections`` are the events: a user is a track, ten groups of users are segments.
``mapping`` has a city for each nation, with list literals; ``metrics`` are day and night
figures by country, from the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators import mapping as M


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    code = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "error", 9).otherwise(11)
    seg = F.col("user_id") % 10
    return e.select(
        F.concat(F.lit("v"), F.floor(seg / 2).cast("string")).alias("video_id"),
        ((seg % 2) * 60).cast("int").alias("start_time"),
        F.col("event_id").alias("row_idx"),
        code.alias("yolo_id"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("x"),
        (F.col("event_id") % 7 / 7).alias("y"),
        ((F.col("event_id") % 9 + 1) / 10).alias("height"),
        F.when(F.col("event_id") % 97 != 0, F.col("user_id")).alias("unique_id"),
    )


DETECTIONS = """detections AS (
  SELECT 'v' || ((user_id % 10) // 2) AS video_id, ((user_id % 10) % 2 * 60)::INT AS start_time, event_id AS row_idx,
         CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 9 ELSE 11 END AS yolo_id,
         least(value / 100, 1.0::DOUBLE) AS x, (event_id % 7)::DOUBLE / 7 AS y, (event_id % 9 + 1)::DOUBLE / 10 AS height,
         CASE WHEN event_id % 97 <> 0 THEN user_id END AS unique_id
  FROM events)"""


def slow_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long tracks that often stand still: line items by supplier, in five segments."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select(F.concat(F.lit("v"), (F.col("l_suppkey") % 5).cast("string")).alias("video_id"), F.lit(0).alias("start_time"), order.alias("row_idx"), F.lit(0).alias("yolo_id"), F.col("l_discount").alias("x"), (F.col("l_quantity") / 50).alias("height"), F.col("l_suppkey").alias("unique_id"))


SLOW_TRACKS = """slow_tracks AS (
  SELECT 'v' || (l_suppkey % 5) AS video_id, 0 AS start_time,
         struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_extendedprice) AS row_idx,
         0 AS yolo_id, l_discount AS x, l_quantity / 50 AS height, l_suppkey AS unique_id
  FROM lineitem)"""


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    rows = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    return rows.select(
        k.cast("long").alias("row_idx"), k.cast("long").alias("id"), F.col("n_name").alias("city"),
        F.when(k % 3 != 0, text("S", k % 4)).alias("state"), F.col("r_name").alias("country"),
        text("K", F.col("n_regionkey") % 2).alias("continent"), F.when(k != 24, F.substring("r_name", 1, 3)).alias("iso3"),
        text("[v", k % 5, ", 'w", k, "']").alias("videos"),
        F.when(k % 4 == 3, "[[0, 60], [10]]").otherwise("[[0, 60, 90], [10]]").alias("start_time"),
        F.lit("[[30, 95], [40], [7]]").alias("end_time"), F.when(k % 2 == 0, "[[0, 1], [1]]").otherwise("[[1, 0], [0]]").alias("time_of_day"),
        F.when(k % 2 == 0, "[25, None]").otherwise("[None, 0]").alias("fps_list"),
        text("[", k % 3, "]").alias("vehicle_type"), F.when(k % 5 != 0, text("[", k, "]")).alias("upload_date"),
        (F.lit(160.0) + k).alias("avg_height"), F.when(k % 4 != 0, k * 1.5).alias("gini"), F.when(k % 6 != 0, k / 2).alias("traffic_mortality"),
        (k * 1000 + 500).cast("double").alias("population_country"), F.when(k % 7 != 0, 50.0 + k).alias("literacy_rate"), (k % 10).cast("double").alias("traffic_index"),
        F.when(k % 8 != 0, (k * 3 % 90).cast("double")).alias("lat"), F.when(k % 8 != 0, (k * 7 % 180).cast("double")).alias("lon"),
    )


MAPPING = """mapping AS (
  SELECT n_nationkey::BIGINT AS row_idx, n_nationkey::BIGINT AS id, n_name AS city, CASE WHEN n_nationkey % 3 <> 0 THEN 'S' || (n_nationkey % 4) END AS state,
         r_name AS country, 'K' || (n_regionkey % 2) AS continent, CASE WHEN n_nationkey <> 24 THEN substr(r_name, 1, 3) END AS iso3,
         '[v' || (n_nationkey % 5) || ', ''w' || n_nationkey || ''']' AS videos,
         CASE WHEN n_nationkey % 4 = 3 THEN '[[0, 60], [10]]' ELSE '[[0, 60, 90], [10]]' END AS start_time, '[[30, 95], [40], [7]]' AS end_time,
         CASE WHEN n_nationkey % 2 = 0 THEN '[[0, 1], [1]]' ELSE '[[1, 0], [0]]' END AS time_of_day,
         CASE WHEN n_nationkey % 2 = 0 THEN '[25, None]' ELSE '[None, 0]' END AS fps_list,
         '[' || (n_nationkey % 3) || ']' AS vehicle_type, CASE WHEN n_nationkey % 5 <> 0 THEN '[' || n_nationkey || ']' END AS upload_date,
         160.0::DOUBLE + n_nationkey AS avg_height, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 1.5::DOUBLE END AS gini,
         CASE WHEN n_nationkey % 6 <> 0 THEN n_nationkey::DOUBLE / 2 END AS traffic_mortality, (n_nationkey * 1000 + 500)::DOUBLE AS population_country,
         CASE WHEN n_nationkey % 7 <> 0 THEN 50.0::DOUBLE + n_nationkey END AS literacy_rate, (n_nationkey % 10)::DOUBLE AS traffic_index,
         CASE WHEN n_nationkey % 8 <> 0 THEN (n_nationkey * 3 % 90)::DOUBLE END AS lat, CASE WHEN n_nationkey % 8 <> 0 THEN (n_nationkey * 7 % 180)::DOUBLE END AS lon
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def all_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.explode_segments(mapping(spark, sf_dir))


ALL_SEGMENTS = (
    MAPPING
    + """, parsed AS (
  SELECT *, regexp_extract_all(videos, '[\\w-]+') AS vs, start_time::INT[][] AS ss, end_time::INT[][] AS es, time_of_day::INT[][] AS ts, replace(fps_list, 'None', 'NULL')::DOUBLE[] AS fs
  FROM mapping
), by_video AS (
  SELECT *, unnest(generate_series(1, least(len(vs), len(ss), len(es), len(ts), len(fs)))) AS v FROM parsed
), by_start AS (
  SELECT *, unnest(generate_series(1, least(len(ss[v]), len(es[v]), len(ts[v])))) AS s FROM by_video
), all_segments AS (
  SELECT row_idx, id, city, state, country, continent, iso3, avg_height, population_country, (v - 1)::INT AS vpos, (s - 1)::INT AS spos, vs[v] AS video_id,
         coalesce(nullif(fs[v], 0), 30.0::DOUBLE) AS fps, ss[v][s] AS start_time, es[v][s] AS end_time, ts[v][s] AS time_of_day, es[v][s] - ss[v][s] AS duration
  FROM by_start)"""
)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_match(all_segments(spark, sf_dir))


SEGMENTS = (
    ALL_SEGMENTS
    + """, segments AS (
  SELECT * REPLACE (coalesce(state, 'unknown') AS state) FROM all_segments
  QUALIFY row_number() OVER (PARTITION BY video_id, start_time ORDER BY row_idx, vpos, spos) = 1)"""
)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """country, condition, speed, time, people: sums and shares that either engine gets exactly."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.select("o_custkey", "o_orderkey", "o_orderpriority").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("n_name").alias("country"), "n_nationkey", (F.col("o_orderkey") % 2).cast("int").alias("condition"), "o_orderkey", "o_orderpriority")
    rows = rows.where((F.col("n_nationkey") % 6 != 5) | (F.col("condition") == 0))
    return rows.groupBy("country", "condition").agg(
        (F.sum(F.col("o_orderkey") % 13) / F.count("*")).alias("speed"),
        (F.sum(F.col("o_orderkey") % 7) / F.count("*")).alias("time"),
        F.count("*").alias("people"),
        (F.count_if(F.substring("o_orderpriority", 1, 1) == "1") / F.count("*")).alias("urgent"),
    )


METRICS = """metrics AS (
  SELECT n_name AS country, (o_orderkey % 2)::INT AS condition, sum(o_orderkey % 13)::DOUBLE / count(*) AS speed, sum(o_orderkey % 7)::DOUBLE / count(*) AS time,
         count(*) AS people, (count(*) FILTER (substr(o_orderpriority, 1, 1) = '1'))::DOUBLE / count(*) AS urgent
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE n_nationkey % 6 <> 5 OR o_orderkey % 2 = 0
  GROUP BY ALL)"""
