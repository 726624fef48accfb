"""Registered queries, by their ids in the operator inventory, and the SQL each is checked against.

Every query is an operator of the package run over whole driver tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.functions import scalars as S
from kerbline.functions import stats as T
from kerbline.operators import events as E
from kerbline.operators import mapping as M
from kerbline.operators import metrics as G
from kerbline.operators import rollup as R
from kerbline.plans import plots
from kerbline.plans import views as V
from kerbline.sources import scans, sinks
from kerbline.sources.schemas import CLASS_NAMES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Bounds that not every track of the events crosses.
LEFT, RIGHT = 0.05, 0.97


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


# ---- scans -------------------------------------------------------------------


@query("SRC1", _with(V.DETECTIONS, V.MAPPING) + """, videos AS (SELECT row_idx, iso3, unnest(regexp_extract_all(videos, '[\\w-]+')) AS video_id FROM mapping),
  wanted AS (SELECT video_id FROM (SELECT * FROM videos QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY row_idx) = 1) WHERE lower(iso3) IN ('ame', 'asi'))
SELECT video_id, start_time, count(*) AS n FROM detections WHERE video_id IN (SELECT video_id FROM wanted) GROUP BY ALL""")
def src1(spark, sf):
    wanted = scans.allowed_videos(V.mapping(spark, sf), ["ame", "ASI"])
    return V.detections(spark, sf).join(wanted, "video_id", "left_semi").groupBy("video_id", "start_time").agg(F.count("*").alias("n"))


@query("SRC3", _with(V.MAPPING) + "SELECT id, city, iso3 FROM mapping WHERE iso3 IN ('AFR', 'EUR')")
def src3(spark, sf):
    return scans.allow_countries(V.mapping(spark, sf), ["AFR", "EUR", "asi"]).select("id", "city", "iso3")


@query("SRC12", _with(V.DETECTIONS, V.SEGMENTS) + "SELECT s.video_id, s.start_time FROM segments s ANTI JOIN detections d ON s.video_id = d.video_id AND s.start_time = d.start_time")
def src12(spark, sf):
    present = V.detections(spark, sf).select("video_id", "start_time").distinct()
    return scans.missing_segments(V.segments(spark, sf), present).select("video_id", "start_time")


@query("SRC10", _with(V.MAPPING) + ", g AS (SELECT n_name AS city, n_nationkey * 2.0::DOUBLE AS glat, n_regionkey * 5.0::DOUBLE AS glon FROM nation WHERE n_nationkey % 3 = 0) SELECT id, concat_ws(', ', mapping.city, state, country) AS query, coalesce(lat, glat) AS lat, coalesce(lon, glon) AS lon FROM mapping LEFT JOIN g ON mapping.city = g.city")
def src10(spark, sf):
    """A gazetteer of a third of the cities, so that some stay without a place."""
    n, mapping = V.table(spark, sf, "nation").where("n_nationkey % 3 = 0"), V.mapping(spark, sf)
    known = n.select(F.col("n_name").alias("city"), (F.col("n_nationkey") * 2.0).alias("lat"), (F.col("n_regionkey") * 5.0).alias("lon"))
    gazetteer = known.join(mapping.select("city", "state", "country"), "city")
    return M.locate(mapping, gazetteer).select("id", M.place_query(mapping).alias("query"), "lat", "lon")


@query("SNK6", _with(V.DETECTIONS, V.SEGMENTS) + "SELECT detections.row_idx, greatest(0.0::DOUBLE, x * 60 - 5) AS t0, least(duration::DOUBLE, x * 60 + 5) AS t1 FROM detections JOIN segments USING (video_id, start_time) WHERE yolo_id = 9")
def snk6(spark, sf):
    rows = V.detections(spark, sf).where("yolo_id = 9").join(V.segments(spark, sf).select("video_id", "start_time", "duration"), ["video_id", "start_time"])
    return sinks.event_clips(rows.withColumn("t", F.col("x") * 60), "t", "duration").select("row_idx", "t0", "t1")


# ---- mapping -----------------------------------------------------------------


@query("MAP1", _with(V.MAPPING) + "SELECT id, unnest(list_transform(string_split(trim(videos, '[]'), ','), lambda x: trim(x))) AS video FROM mapping")
def map1(spark, sf):
    return V.mapping(spark, sf).select("id", F.explode(M.split_videos(F.col("videos"))).alias("video"))


@query("MAP2", _with(V.MAPPING) + "SELECT id, unnest(regexp_extract_all(videos, '[\\w-]+')) AS video FROM mapping")
def map2(spark, sf):
    return V.mapping(spark, sf).select("id", F.explode(M.parse_videos(F.col("videos"))).alias("video"))


@query("MAP4", _with(V.MAPPING) + "SELECT id, len(start_time::INT[][])::INT AS lists, list_sum(flatten(start_time::INT[][]))::BIGINT AS total FROM mapping")
def map4(spark, sf):
    starts = M.parse_nested(F.col("start_time"))
    return V.mapping(spark, sf).select("id", F.size(starts).alias("lists"), F.aggregate(F.flatten(starts), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("MAP5", _with(V.MAPPING) + "SELECT id, unnest(list_transform(replace(fps_list, 'None', 'NULL')::DOUBLE[], lambda x: coalesce(nullif(x, 0), 30.0::DOUBLE))) AS fps FROM mapping")
def map5(spark, sf):
    return V.mapping(spark, sf).select("id", F.explode(M.parse_fps(F.col("fps_list"))).alias("fps"))


_SEGMENT_COLUMNS = "video_id, start_time, end_time, time_of_day, id, city, state, country, continent, iso3, avg_height, fps, duration"


@query("MAP6", _with(V.SEGMENTS) + f"SELECT {_SEGMENT_COLUMNS} FROM segments")
def map6(spark, sf):
    return V.segments(spark, sf).select(*_SEGMENT_COLUMNS.split(", "))


@query("MAP7", _with(V.SEGMENTS) + "SELECT video_id, start_time, id FROM segments")
def map7(spark, sf):
    return M.first_video_position(V.all_segments(spark, sf)).select("video_id", "start_time", "id")


@query("MAP8", _with(V.SEGMENTS) + "SELECT video_id, start_time, duration FROM segments")
def map8(spark, sf):
    return V.segments(spark, sf).select("video_id", "start_time", "duration")


@query("MAP9", _with(V.MAPPING) + """, z AS (SELECT start_time::INT[][] AS a, end_time::INT[][] AS b FROM mapping), y AS (SELECT *, unnest(generate_series(1, least(len(a), len(b)))) AS i FROM z),
  x AS (SELECT *, unnest(generate_series(1, least(len(a[i]), len(b[i])))) AS j FROM y) SELECT sum(b[i][j] - a[i][j])::BIGINT AS total_seconds FROM x""")
def map9(spark, sf):
    return M.total_seconds(V.mapping(spark, sf))


@query("MAP10", _with(V.MAPPING) + "SELECT count(DISTINCT v)::BIGINT AS total_videos FROM (SELECT trim(unnest(string_split(videos, ','))) AS v FROM mapping)")
def map10(spark, sf):
    return M.total_videos(V.mapping(spark, sf))


@query("MAP11", _with(V.MAPPING) + "SELECT id, len(string_split(trim(videos, '[]'), ','))::INT AS total_videos FROM mapping")
def map11(spark, sf):
    return V.mapping(spark, sf).select("id", M.videos_per_row(F.col("videos")).alias("total_videos"))


@query("MAP12", _with(V.MAPPING) + "SELECT (count(DISTINCT state) + max((state IS NULL)::INT))::BIGINT AS n_values FROM mapping")
def map12(spark, sf):
    return M.unique_values(V.mapping(spark, sf), "state")


@query("MAP13", _with(V.MAPPING) + """SELECT c_custkey, (SELECT min_by(id, row_idx) FROM mapping m WHERE lower(trim(m.country)) = lower(trim(k.country)) AND lower(trim(m.state)) IS NOT DISTINCT FROM nullif(k.state, 'unknown')) AS id
FROM (SELECT c_custkey, ' ' || lower(r_name) AS country, CASE c_custkey % 5 WHEN 4 THEN 'unknown' ELSE 's' || (c_custkey % 5) END AS state FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) k""")
def map13(spark, sf):
    c, n, r = (V.table(spark, sf, t) for t in ("customer", "nation", "region"))
    keys = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    state = F.when(F.col("c_custkey") % 5 == 4, "unknown").otherwise(F.concat(F.lit("s"), (F.col("c_custkey") % 5).cast("string")))
    keys = keys.select("c_custkey", F.concat(F.lit(" "), F.lower("r_name")).alias("country"), state.alias("state"))
    return M.lookup(keys, V.mapping(spark, sf), {"country": "country", "state": "state"}, "id").select("c_custkey", "id")


@query("MAP14", "SELECT (SELECT min_by(n_name, n_nationkey) FROM nation WHERE contains(n_name, 'N_1') OR contains('N_1', n_name)) AS key")
def map14(spark, sf):
    n = V.table(spark, sf, "nation")
    return M.search_key(n.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("key"), F.col("n_name").alias("value")), "N_1")


# ---- filters and projections -------------------------------------------------


@query("FLT1", _with(V.DETECTIONS) + "SELECT row_idx FROM detections WHERE yolo_id = 0")
def flt1(spark, sf):
    return V.detections(spark, sf).where("yolo_id = 0").select("row_idx")


@query("FLT2", _with(V.DETECTIONS) + "SELECT row_idx FROM detections WHERE yolo_id IN (9, 11)")
def flt2(spark, sf):
    return V.detections(spark, sf).where(F.col("yolo_id").isin(9, 11)).select("row_idx")


@query("FLT4", "SELECT l_orderkey, l_linenumber, l_discount * 20 AS speed FROM lineitem WHERE NOT l_discount * 20 > 1.42")
def flt4(spark, sf):
    speed = F.col("l_discount") * 20
    return V.table(spark, sf, "lineitem").where(~(speed > 1.42) | F.isnan(speed)).select("l_orderkey", "l_linenumber", speed.alias("speed"))


@query("FLT5", _with(V.MAPPING) + "SELECT id, gini FROM mapping WHERE coalesce(gini, 0) <> 0")
def flt5(spark, sf):
    return plots.nonzero(V.mapping(spark, sf), "gini").select("id", "gini")


@query("FLT6", "SELECT p_partkey, p_retailprice / nullif(p_size % 5, 0) AS ratio FROM part WHERE p_size % 5 <> 0")
def flt6(spark, sf):
    rows = V.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.lit(float("inf"))).otherwise(F.try_divide("p_retailprice", F.col("p_size") % 5)).alias("ratio"))
    return plots.finite_rows(rows)


@query("FLT7", _with(V.METRICS) + "SELECT country, condition, urgent FROM metrics WHERE coalesce(urgent, 0) >= 0.2")
def flt7(spark, sf):
    return V.metrics(spark, sf).where(F.coalesce("urgent", F.lit(0.0)) >= 0.2).select("country", "condition", "urgent")


@query("FLT9", _with(V.METRICS) + "SELECT country, max(speed) FILTER (condition = 0) AS day, max(speed) FILTER (condition = 1) AS night, abs(day - night) AS diff FROM metrics GROUP BY country HAVING day IS NOT NULL AND night IS NOT NULL")
def flt9(spark, sf):
    return R.day_night(V.metrics(spark, sf), "speed")


@query("FLT10", _with(V.METRICS) + "SELECT a.country, a.condition, a.speed, b.time FROM metrics a JOIN metrics b USING (country, condition) WHERE a.speed > 5.9 AND b.time > 2.9")
def flt10(spark, sf):
    m = V.metrics(spark, sf)
    return m.where("speed > 5.9").select("country", "condition", "speed").join(m.where("time > 2.9").select("country", "condition", "time"), ["country", "condition"])


@query("PRJ1", _with(V.MAPPING) + "SELECT id, country, iso3 FROM mapping")
def prj1(spark, sf):
    return V.mapping(spark, sf).select("id", "country", "iso3", "city", "lat").drop("city", "state", "lat", "lon")


@query("PRJ2", "SELECT n_nationkey AS iso3, n_regionkey AS value FROM nation")
def prj2(spark, sf):
    return V.table(spark, sf, "nation").select("n_nationkey", "n_regionkey").toDF("iso3", "value")


@query("PRJ4", "SELECT c_custkey, c_acctbal / 1000 AS thousands FROM customer")
def prj4(spark, sf):
    return V.table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("thousands"))


@query("PRJ5", _with(V.METRICS) + "SELECT country, condition, round(speed / time / people * 1000000 + 1e-9, 2) AS rate FROM metrics")
def prj5(spark, sf):
    return V.metrics(spark, sf).select("country", "condition", plots.per_million(F.col("speed") + F.lit(0.0), F.col("time"), F.col("people"), slack=1e-9).alias("rate"))


@query("PRJ7", _with(V.METRICS) + "SELECT n_name AS country, coalesce(speed, 0.0::DOUBLE) AS speed FROM nation LEFT JOIN metrics ON n_name = country AND condition = 1")
def prj7(spark, sf):
    night = V.metrics(spark, sf).where("condition = 1").select("country", "speed")
    return V.table(spark, sf, "nation").select(F.col("n_name").alias("country")).join(night, "country", "left").select("country", F.coalesce("speed", F.lit(0.0)).alias("speed"))


@query("PRJ8", "SELECT n_nationkey, CASE n_name WHEN 'NATION_7' THEN 'Nation Seven' ELSE n_name END AS country FROM nation")
def prj8(spark, sf):
    return V.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("country")).replace({"NATION_7": "Nation Seven"}, subset=["country"])


# ---- track events ------------------------------------------------------------

_CROSSED = f"crossed AS (SELECT video_id, start_time, unique_id FROM detections WHERE yolo_id = 0 AND unique_id IS NOT NULL GROUP BY ALL HAVING min(x) <= {LEFT} AND max(x) >= {RIGHT})"
_TIMES = """ranked AS (SELECT d.*, row_number() OVER (PARTITION BY video_id, start_time, unique_id ORDER BY row_idx) AS rn FROM detections d SEMI JOIN crossed USING (video_id, start_time, unique_id)),
  ends AS (SELECT video_id, start_time, unique_id, avg(height) AS h, min(x) AS a, max(x) AS b, min(rn) FILTER (x = lo) AS pa, min(rn) FILTER (x = hi) AS pb
    FROM (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM ranked WINDOW w AS (PARTITION BY video_id, start_time, unique_id)) GROUP BY ALL),
  times AS (SELECT e.*, (abs(pa - pb) + 1) / fps AS crossing_time_s, country, time_of_day AS condition, avg_height FROM ends e JOIN segments USING (video_id, start_time))"""
_SPEEDS = "speeds AS (SELECT video_id, start_time, unique_id, country, condition, (b - a) / (h / avg_height) / crossing_time_s / 100 AS speed FROM times WHERE (b - a) / (h / avg_height) / crossing_time_s / 100 <= 1.42)"
_BASE = (V.DETECTIONS, V.SEGMENTS, _CROSSED)


def _crossed(spark, sf):
    return E.crossings(V.detections(spark, sf), LEFT, RIGHT)


def _shapes(spark, sf, left=LEFT, right=RIGHT):
    return E.track_shapes(V.detections(spark, sf), left, right)


def _times(spark, sf, left=LEFT, right=RIGHT):
    return E.crossing_times(_shapes(spark, sf, left, right), V.segments(spark, sf))


def _speeds(spark, sf):
    return E.crossing_speeds(_times(spark, sf))


@query("EVT1", _with(V.DETECTIONS, _CROSSED) + "SELECT * FROM crossed")
def evt1(spark, sf):
    return _crossed(spark, sf)


@query("FLT3", _with(V.DETECTIONS, _CROSSED) + "SELECT video_id, start_time, count(*) AS crossings FROM crossed GROUP BY ALL")
def flt3(spark, sf):
    return E.crossing_counts(_crossed(spark, sf))


@query("EVT2", _with(*_BASE, _TIMES) + "SELECT video_id, start_time, unique_id, crossing_time_s FROM times")
def evt2(spark, sf):
    return _times(spark, sf).select(*E.TRACK, "crossing_time_s")


@query("EVT3", _with(*_BASE, _TIMES, _SPEEDS) + "SELECT video_id, start_time, unique_id, country, condition, round(speed, 9) AS speed FROM speeds")
def evt3(spark, sf):
    return _speeds(spark, sf).withColumn("speed", F.round("speed", 9))


@query("EVT4", _with(*_BASE, _TIMES, _SPEEDS) + "SELECT country, condition, round(avg(speed), 9) AS speed FROM speeds GROUP BY ALL")
def evt4(spark, sf):
    return _speeds(spark, sf).groupBy("country", "condition").agg(F.round(F.avg("speed"), 9).alias("speed"))


@query("EVT5", _with(*_BASE, _TIMES, _SPEEDS) + "SELECT country, CASE WHEN grouping(condition) = 1 THEN 2 ELSE condition END AS condition, round(avg(speed), 9) AS speed FROM speeds GROUP BY GROUPING SETS ((country, condition), (country))")
def evt5(spark, sf):
    return E.mean_by_condition(_speeds(spark, sf), "speed", "speed").withColumn("speed", F.round("speed", 9))


@query(
    "crossing_time",
    _with(V.DETECTIONS, V.SEGMENTS, _CROSSED.replace(f"<= {LEFT}", "<= 0.45").replace(f">= {RIGHT}", ">= 0.55"), _TIMES)
    + "SELECT country, CASE WHEN grouping(condition) = 1 THEN 2 ELSE condition END AS condition, round(avg(crossing_time_s), 9) AS crossing_time_s FROM times GROUP BY GROUPING SETS ((country, condition), (country))",
)
def crossing_time(spark, sf):
    """Mean crossing time by country and time of day, and over both."""
    return E.mean_by_condition(_times(spark, sf, 0.45, 0.55), "crossing_time_s", "crossing_time_s").withColumn("crossing_time_s", F.round("crossing_time_s", 9))


flagship = crossing_time

_HESITATION = """w AS (SELECT *, row_number() OVER o AS rn, lead(x, 10) OVER o AS nx, first_value(x) OVER o AS x0, round(0.1 * avg(height) OVER (PARTITION BY unique_id), 9) + 1e-9 AS m
    FROM slow_tracks WINDOW o AS (PARTITION BY unique_id ORDER BY row_idx)),
  st AS (SELECT *, CASE WHEN x0 < 0.5 THEN nx >= x - m AND nx <= x + m ELSE false END AS still FROM w WHERE (rn - 1) % 10 = 0 AND nx IS NOT NULL),
  isl AS (SELECT *, sum((NOT still)::INT) OVER (PARTITION BY unique_id ORDER BY rn) AS g FROM st),
  cl AS (SELECT *, max(g) OVER (PARTITION BY unique_id) AS gm FROM isl),
  ru AS (SELECT video_id, start_time, unique_id, g, count(*) AS n FROM cl WHERE still AND g < gm GROUP BY ALL HAVING count(*) >= 3),
  hesitation AS (SELECT f.*, country, time_of_day AS condition, n / (fps / 10) AS hesitation_s FROM (SELECT * FROM ru QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY g) = 1) f JOIN segments USING (video_id, start_time) WHERE n <= 0.9 * fps)"""


def _hesitation(spark, sf):
    return E.hesitation_times(V.slow_tracks(spark, sf), V.segments(spark, sf), digits=9, slack=1e-9)


@query("EVT6", _with(V.SLOW_TRACKS, V.SEGMENTS, _HESITATION) + "SELECT video_id, start_time, unique_id, country, condition, round(hesitation_s, 9) AS hesitation_s FROM hesitation")
def evt6(spark, sf):
    return _hesitation(spark, sf).withColumn("hesitation_s", F.round("hesitation_s", 9))


@query("EVT7", _with(V.SLOW_TRACKS, V.SEGMENTS, _HESITATION) + "SELECT country, condition, round(avg(hesitation_s), 9) AS hesitation_s FROM hesitation GROUP BY ALL")
def evt7(spark, sf):
    return _hesitation(spark, sf).groupBy("country", "condition").agg(F.round(F.avg("hesitation_s"), 9).alias("hesitation_s"))


@query("EVT8", _with(V.SLOW_TRACKS, V.SEGMENTS, _HESITATION) + "SELECT country, CASE WHEN grouping(condition) = 1 THEN 2 ELSE condition END AS condition, round(avg(hesitation_s), 9) AS hesitation_s FROM hesitation GROUP BY GROUPING SETS ((country, condition), (country))")
def evt8(spark, sf):
    return E.mean_by_condition(_hesitation(spark, sf), "hesitation_s", "hesitation_s").withColumn("hesitation_s", F.round("hesitation_s", 9))


_EQUIPPED = """span AS (SELECT video_id, start_time, unique_id, min(row_idx) AS a, max(row_idx) AS b FROM detections SEMI JOIN crossed USING (video_id, start_time, unique_id) GROUP BY ALL),
  seen AS (SELECT video_id, start_time, row_idx FROM {source} WHERE yolo_id IN ({codes})),
  equipped AS (SELECT s.video_id, s.start_time, s.unique_id, coalesce(min(r.row_idx) <= any_value(s.b), false) AS equipped FROM span s
    LEFT JOIN seen r ON r.video_id = s.video_id AND r.start_time = s.start_time AND r.row_idx >= s.a AND r.row_idx <= s.b GROUP BY ALL)"""
_EQ_ANY, _EQ_LIGHT = _EQUIPPED.format(source="detections", codes="9, 11"), _EQUIPPED.format(source="detections", codes="9")
_BY_CONDITION = "eqc AS (SELECT country, time_of_day AS condition, coalesce(sum(w), 0)::BIGINT AS with_equipment, coalesce(sum(o), 0)::BIGINT AS without_equipment, sum(duration)::BIGINT AS seconds FROM segments LEFT JOIN (SELECT video_id, start_time, count(*) FILTER (equipped) AS w, count(*) FILTER (NOT equipped) AS o FROM equipped GROUP BY ALL) e USING (video_id, start_time) GROUP BY ALL)"
_PERSONS = "pc AS (SELECT country, time_of_day AS condition, count(DISTINCT (video_id, start_time, unique_id)) AS persons FROM detections JOIN segments USING (video_id, start_time) WHERE yolo_id = 0 AND unique_id IS NOT NULL GROUP BY ALL)"
_SHARE = "p AS (SELECT video_id, start_time, count(*) FILTER (equipped) AS a, count(*) FILTER (NOT equipped) AS b FROM equipped GROUP BY ALL), g AS (SELECT country, time_of_day AS condition, sum(a * 60.0::DOUBLE / duration) AS a, sum(b * 60.0::DOUBLE / duration) AS b FROM p JOIN segments USING (video_id, start_time) GROUP BY ALL) SELECT country, condition, round(100 * b / (a + b), 9) AS without_light_pct FROM g WHERE a + b <> 0"


@query("EVT9", _with(*_BASE, _EQ_ANY, _BY_CONDITION) + "SELECT * FROM eqc")
def evt9(spark, sf):
    return E.equipment_by_condition(E.crossings_with_equipment(V.detections(spark, sf), _shapes(spark, sf)), V.segments(spark, sf))


@query("JN3", _with(*_BASE, _EQ_ANY) + "SELECT * FROM equipped")
def jn3(spark, sf):
    return E.crossings_with_equipment(V.detections(spark, sf), _shapes(spark, sf))


@query("EVT10", _with(*_BASE, _EQ_LIGHT) + ", " + _SHARE)
def evt10(spark, sf):
    return E.light_share(V.detections(spark, sf), _shapes(spark, sf), V.segments(spark, sf)).withColumn("without_light_pct", F.round("without_light_pct", 9))


@query("EVT11", _with(*_BASE, _EQ_ANY, _BY_CONDITION, _PERSONS) + "SELECT country, condition, with_equipment * 60.0::DOUBLE / seconds / persons AS with_rate, without_equipment * 60.0::DOUBLE / seconds / persons AS without_rate FROM eqc JOIN pc USING (country, condition)")
def evt11(spark, sf):
    people = V.detections(spark, sf).where("yolo_id = 0 and unique_id is not null").select(*E.TRACK).distinct().join(V.segments(spark, sf), E.SEGMENT)
    return E.per_minute_and_person(evt9(spark, sf), people.groupBy("country", F.col("time_of_day").alias("condition")).agg(F.count("*").alias("persons")))


# the events have equipment in every stretch; beside the queries above, the same on equipment so rare that crossings without it occur
_SELDOM = "seldom AS (SELECT * FROM detections WHERE yolo_id NOT IN (9, 11) OR row_idx % 211 = 0)"


def _seldom(spark, sf):
    return V.detections(spark, sf).where("yolo_id not in (9, 11) or row_idx % 211 = 0")


@query("JN3_seldom", _with(*_BASE, _SELDOM, _EQUIPPED.format(source="seldom", codes="9, 11")) + "SELECT * FROM equipped")
def jn3_seldom(spark, sf):
    return E.crossings_with_equipment(_seldom(spark, sf), _shapes(spark, sf))


@query("EVT10_seldom", _with(*_BASE, _SELDOM, _EQUIPPED.format(source="seldom", codes="9")) + ", " + _SHARE)
def evt10_seldom(spark, sf):
    return E.light_share(_seldom(spark, sf), _shapes(spark, sf), V.segments(spark, sf)).withColumn("without_light_pct", F.round("without_light_pct", 9))


@query("EVT12", _with(*_BASE) + "SELECT country, time_of_day AS condition, coalesce(sum(n), 0)::BIGINT AS crossings FROM segments LEFT JOIN (SELECT video_id, start_time, count(*) AS n FROM crossed GROUP BY ALL) c USING (video_id, start_time) GROUP BY ALL")
def evt12(spark, sf):
    return E.crossings_by_condition(E.crossing_counts(_crossed(spark, sf)), V.segments(spark, sf))


@query("EVT13", _with(V.DETECTIONS) + "SELECT row_idx, count(*) OVER w AS points, first_value(x) OVER w AS oldest FROM detections WHERE unique_id IS NOT NULL WINDOW w AS (PARTITION BY video_id, start_time, unique_id ORDER BY row_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def evt13(spark, sf):
    return E.trails(V.detections(spark, sf)).select("row_idx", F.size("trail").cast("long").alias("points"), F.element_at("trail", 1)["x"].alias("oldest"))


# ---- aggregations ------------------------------------------------------------

_COUNTS = "counts AS (SELECT video_id, start_time, " + ", ".join(f"count(DISTINCT unique_id) FILTER (yolo_id = {k}) AS {n}" for k, n in CLASS_NAMES.items()) + " FROM detections WHERE unique_id IS NOT NULL GROUP BY ALL)"


@query("AGG1", _with(V.DETECTIONS, _COUNTS) + "SELECT * FROM counts")
def agg1(spark, sf):
    return G.object_counts(V.detections(spark, sf))


_TOTALS = ", ".join(f"sum({n})::BIGINT AS {n}" for n in CLASS_NAMES.values())


@query("AGG2", _with(V.DETECTIONS, V.SEGMENTS, _COUNTS) + f"SELECT id, {_TOTALS}, sum(duration)::BIGINT AS total_time FROM counts JOIN segments USING (video_id, start_time) GROUP BY ROLLUP (id)")
def agg2(spark, sf):
    return G.city_totals(G.object_counts(V.detections(spark, sf)), V.segments(spark, sf))


@query("AGG3", _with(V.DETECTIONS, V.SEGMENTS) + "SELECT id, sum(duration)::BIGINT AS total_time FROM segments SEMI JOIN detections USING (video_id, start_time) GROUP BY id")
def agg3(spark, sf):
    seen = V.detections(spark, sf).select("video_id", "start_time").distinct()
    return V.segments(spark, sf).join(seen, E.SEGMENT, "left_semi").groupBy("id").agg(F.sum("duration").cast("long").alias("total_time"))


_RATES = "rates AS (SELECT video_id, start_time, country, time_of_day AS condition, duration, count(DISTINCT unique_id) FILTER (yolo_id IN ({codes})) + coalesce(max((unique_id IS NULL)::INT) FILTER (yolo_id IN ({codes})), 0) AS n FROM detections JOIN segments USING (video_id, start_time) GROUP BY ALL), ordered AS (SELECT *, n * 60.0::DOUBLE / duration AS rate, row_number() OVER (PARTITION BY country, condition ORDER BY video_id, start_time) AS i, count(*) OVER (PARTITION BY country, condition) AS k FROM rates)"


@query("AGG4", _with(V.DETECTIONS, V.SEGMENTS, _RATES.format(codes="2, 3, 5, 7")) + "SELECT country, condition, round(sum(rate * CASE WHEN k = 1 THEN 1 ELSE pow(2.0::DOUBLE, greatest(i, 2) - k - 1) END), 9) AS traffic FROM ordered GROUP BY ALL")
def agg4(spark, sf):
    codes = G.traffic_classes(motorcycle=True, car=True, bus=True, truck=True)
    return G.traffic(V.detections(spark, sf), V.segments(spark, sf), codes).withColumn("traffic", F.round("traffic", 9))


@query("AGG4_car", _with(V.DETECTIONS, V.SEGMENTS, _RATES.format(codes="3")) + "SELECT country, condition, round(sum(rate * CASE WHEN k = 1 THEN 1 ELSE pow(2.0::DOUBLE, greatest(i, 2) - k - 1) END), 9) AS traffic FROM ordered GROUP BY ALL")
def agg4_car(spark, sf):
    return G.traffic(V.detections(spark, sf), V.segments(spark, sf), G.traffic_classes(car=True)).withColumn("traffic", F.round("traffic", 9))


@query("WIN6", _with(V.DETECTIONS, V.SEGMENTS, _RATES.format(codes="2")) + "SELECT country, condition, round(sum(n) * 60.0::DOUBLE / sum(duration), 9) AS traffic FROM (SELECT country, condition, duration, (SELECT count(DISTINCT unique_id) FROM detections d WHERE d.video_id = ordered.video_id AND d.start_time = ordered.start_time AND yolo_id = 2) AS n FROM ordered) GROUP BY ALL")
def win6(spark, sf):
    return G.traffic(V.detections(spark, sf), V.segments(spark, sf), G.traffic_classes(car=True, fix_known_defects=True), fix_known_defects=True).withColumn("traffic", F.round("traffic", 9))


@query("AGG5", _with(V.DETECTIONS, V.SEGMENTS, _CROSSED, _RATES.format(codes="9, 11")) + ", l AS (SELECT max_by(n, (video_id, start_time)) AS last FROM (SELECT video_id, start_time, count(*) AS n FROM crossed GROUP BY ALL)) SELECT country, condition, round(CASE WHEN max(k) = 1 THEN max(rate) ELSE sum(rate) FILTER (i > 1) / (max(last) * (max(k) - 1)) END, 9) AS traffic_signs FROM ordered, l GROUP BY ALL")
def agg5(spark, sf):
    return G.traffic_signs(V.detections(spark, sf), V.segments(spark, sf), G.last_crossings(E.crossing_counts(_crossed(spark, sf)))).withColumn("traffic_signs", F.round("traffic_signs", 9))


_PHONES = "phones AS (SELECT * REPLACE (CASE WHEN yolo_id = 3 THEN 67 ELSE yolo_id END AS yolo_id) FROM detections)"


@query("AGG6", _with(V.DETECTIONS, V.SEGMENTS, _PHONES, _COUNTS.replace("FROM detections", "FROM phones")) + "SELECT country, time_of_day AS condition, round(sum(cellphone) * 60.0::DOUBLE / sum(duration) / sum(person) * 1000, 9) AS cell_phones FROM counts JOIN segments USING (video_id, start_time) WHERE person > 0 AND cellphone > 0 GROUP BY ALL")
def agg6(spark, sf):
    seen = V.detections(spark, sf).withColumn("yolo_id", F.when(F.col("yolo_id") == 3, 67).otherwise(F.col("yolo_id")))
    return G.cell_phones(G.object_counts(seen), V.segments(spark, sf)).withColumn("cell_phones", F.round("cell_phones", 9))


# counts and means that the mapping has not, nulls among them: each column's by its place
_MADE_SUMS = {c: f"CASE WHEN row_idx % 5 <> {j % 5} THEN row_idx * {j + 1} % 17 END" for j, c in enumerate(R.SUMS)}
_MADE_MEANS = {c: f"CASE WHEN row_idx % 3 <> {j % 3} THEN row_idx * 0.25 + {j} END" for j, c in enumerate(R.MEANS)}
_ROLLED = ", ".join(
    [f"min_by({c}, row_idx) FILTER ({c} IS NOT NULL) AS {c}" for c in R.FIRST]
    + [f"string_agg(coalesce({c}, '-'), '|' ORDER BY row_idx) AS {c}" for c in R.LISTS]
    + [f"coalesce(sum({sql}), 0)::BIGINT AS {c}" for c, sql in _MADE_SUMS.items()]
    + [f"round(avg(({sql})::DOUBLE), 9) AS {c}" for c, sql in _MADE_MEANS.items()]
)


@query("AGG7", _with(V.MAPPING) + f"SELECT iso3, {_ROLLED} FROM mapping WHERE iso3 IS NOT NULL GROUP BY iso3")
def agg7(spark, sf):
    """The whole country table: 8 first values, 7 lists, 11 sums and 16 means beside the code."""
    rows = V.mapping(spark, sf).withColumns({c: F.expr(sql) for c, sql in _MADE_SUMS.items()} | {c: F.expr(f"cast({sql} as double)") for c, sql in _MADE_MEANS.items()})
    out = R.roll_up(rows)
    joined = {c: F.array_join(c, "|", "-") for c in R.LISTS}
    return out.withColumns(joined | {c: F.round(c, 9) for c in R.MEANS} | {c: F.col(c).cast("long") for c in R.SUMS})


@query("AGG8", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) = 1")
def agg8(spark, sf):
    return scans.latest_per_key(V.table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", "c_custkey")


@query("AGG9", "SELECT c_nationkey, round(avg(c_acctbal), 6) AS mean, round(coalesce(stddev_samp(c_acctbal), 0), 6) AS sd FROM customer GROUP BY ALL")
def agg9(spark, sf):
    return T.spread(V.table(spark, sf, "customer"), "c_acctbal", ["c_nationkey"]).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("AGG10", _with(V.METRICS) + "SELECT condition, (SELECT country FROM metrics b WHERE b.condition = a.condition ORDER BY speed DESC, country LIMIT 1) AS argmax, (SELECT country FROM metrics b WHERE b.condition = a.condition ORDER BY speed, country LIMIT 1) AS argmin FROM metrics a GROUP BY condition")
def agg10(spark, sf):
    return T.arg_extremes(V.metrics(spark, sf), "country", "speed", ["condition"])


_WIDE = "wide AS (SELECT n_name AS country, max(speed) FILTER (condition = 0) AS day, max(speed) FILTER (condition = 1) AS night FROM nation LEFT JOIN metrics ON n_name = country GROUP BY n_name)"


def _wide(spark, sf, value="speed"):
    wide = V.metrics(spark, sf).groupBy("country").pivot("condition", [0, 1]).agg(F.first(value)).withColumnsRenamed({"0": "day", "1": "night"})
    return V.table(spark, sf, "nation").select(F.col("n_name").alias("country")).join(wide, "country", "left")


@query("AGG11", _with(V.METRICS, _WIDE) + "SELECT country, coalesce(CASE WHEN day IS NULL THEN night WHEN night IS NULL THEN day ELSE (day + night) / 2 END, 0) AS mean FROM wide")
def agg11(spark, sf):
    return _wide(spark, sf).select("country", S.safe_average("day", "night").alias("mean"))


@query("AGG13", _with(V.METRICS, _WIDE) + "SELECT country, CASE WHEN day IS NULL THEN night WHEN night IS NULL THEN day ELSE (day + night) / 2 END AS mean FROM wide")
def agg13(spark, sf):
    return _wide(spark, sf).select("country", S.row_mean("day", "night").alias("mean"))


@query("AGG15", _with(V.MAPPING) + "SELECT iso3, string_agg(city, ',' ORDER BY city) AS cities FROM mapping GROUP BY iso3")
def agg15(spark, sf):
    return V.mapping(spark, sf).groupBy("iso3").agg(F.array_join(F.sort_array(F.collect_list("city")), ",").alias("cities"))


@query("AGG14", _with(V.METRICS) + "SELECT condition, max(speed) AS highest, min(speed) AS lowest, round(avg(speed), 9) AS mean, round(coalesce(stddev_samp(speed), 0), 9) AS sd FROM metrics GROUP BY condition")
def agg14(spark, sf):
    m = V.metrics(spark, sf)
    ends = m.groupBy("condition").agg(F.max("speed").alias("highest"), F.min("speed").alias("lowest"))
    return ends.join(T.spread(m, "speed", ["condition"]), "condition").withColumns({"mean": F.round("mean", 9), "sd": F.round("sd", 9)})


# ---- statistics --------------------------------------------------------------

_FEATURES = ("traffic_mortality", "gini", "literacy_rate", "traffic_index", "constant")


@query("STA1", _with(V.MAPPING) + """, long AS (SELECT a.f AS "row", b.f AS col, a.v AS x, b.v AS y FROM
    (SELECT row_idx, unnest(['traffic_mortality', 'gini', 'literacy_rate', 'traffic_index', 'constant']) AS f, unnest([traffic_mortality, gini, literacy_rate, traffic_index, 1.0::DOUBLE]) AS v FROM mapping) a JOIN
    (SELECT row_idx, unnest(['traffic_mortality', 'gini', 'literacy_rate', 'traffic_index', 'constant']) AS f, unnest([traffic_mortality, gini, literacy_rate, traffic_index, 1.0::DOUBLE]) AS v FROM mapping) b USING (row_idx) WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
  r AS (SELECT "row", col, rank() OVER (PARTITION BY "row", col ORDER BY x) + (count(*) OVER (PARTITION BY "row", col, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY "row", col ORDER BY y) + (count(*) OVER (PARTITION BY "row", col, y) - 1) / 2.0::DOUBLE AS ry FROM long)
SELECT "row", col, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 9) AS rho FROM r GROUP BY ALL""")
def sta1(spark, sf):
    return T.spearman(V.mapping(spark, sf).withColumn("constant", F.lit(1.0)), _FEATURES).withColumn("rho", F.round("rho", 9))


@query("STA2", _with(V.METRICS, _WIDE) + """, w2 AS (SELECT n_name AS country, max(time) FILTER (condition = 0) AS day, max(time) FILTER (condition = 1) AS night FROM nation LEFT JOIN metrics ON n_name = country GROUP BY n_name),
  m AS (SELECT country, CASE WHEN a.day IS NULL THEN a.night WHEN a.night IS NULL THEN a.day ELSE (a.day + a.night) / 2 END AS x, CASE WHEN b.day IS NULL THEN b.night WHEN b.night IS NULL THEN b.day ELSE (b.day + b.night) / 2 END AS y FROM wide a JOIN w2 b USING (country)),
  r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM m WHERE x IS NOT NULL AND y IS NOT NULL) SELECT round(corr(rx, ry), 9) AS rho FROM r""")
def sta2(spark, sf):
    both = _wide(spark, sf).select("country", S.row_mean("day", "night").alias("speed")).join(_wide(spark, sf, "time").select("country", S.row_mean("day", "night").alias("time")), "country")
    return T.spearman(both, ("speed", "time")).where("row = 'speed' and col = 'time'").select(F.round("rho", 9).alias("rho"))


_COUNTRY_FEATURES = ("speed", "time", "people", "urgent")


@query("STA2M", _with(V.METRICS) + """, w AS (SELECT n_name AS country, condition, unnest(['speed', 'time', 'people', 'urgent']) AS f, unnest([speed, time, people::DOUBLE, urgent]) AS v FROM nation LEFT JOIN metrics ON n_name = country),
  m AS (SELECT country, f, max(v) FILTER (condition = 0) AS day, max(v) FILTER (condition = 1) AS night, CASE WHEN day IS NULL THEN night WHEN night IS NULL THEN day ELSE (day + night) / 2 END AS v FROM w GROUP BY country, f),
  long AS (SELECT a.f AS "row", b.f AS col, a.v AS x, b.v AS y FROM m a JOIN m b USING (country) WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
  r AS (SELECT "row", col, rank() OVER (PARTITION BY "row", col ORDER BY x) + (count(*) OVER (PARTITION BY "row", col, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY "row", col ORDER BY y) + (count(*) OVER (PARTITION BY "row", col, y) - 1) / 2.0::DOUBLE AS ry FROM long)
SELECT "row", col, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 9) AS rho FROM r GROUP BY ALL""")
def sta2m(spark, sf):
    """The whole matrix that STA2 takes one cell of."""
    m = V.metrics(spark, sf).groupBy("country").pivot("condition", [0, 1]).agg(*[F.first(f).alias(f) for f in _COUNTRY_FEATURES])
    mean = [S.row_mean(f"0_{f}", f"1_{f}").alias(f) for f in _COUNTRY_FEATURES]
    both = V.table(spark, sf, "nation").select(F.col("n_name").alias("country")).join(m, "country", "left").select("country", *mean)
    return T.spearman(both, _COUNTRY_FEATURES).withColumn("rho", F.round("rho", 9))


@query("STA3", _with(V.METRICS) + "SELECT country, coalesce(max(speed) FILTER (condition = 0), 0) AS speed_0, max(time) FILTER (condition = 0) AS time_0, coalesce(max(speed) FILTER (condition = 1), 0) AS speed_1, max(time) FILTER (condition = 1) AS time_1 FROM metrics GROUP BY country")
def sta3(spark, sf):
    return T.wide_features(V.metrics(spark, sf), ["speed", "time"], zero=["speed"])


@query("STA5", _with(V.MAPPING) + """, p AS (SELECT id, lat, lon FROM mapping WHERE lat IS NOT NULL), d AS (SELECT a.id, coalesce(min(sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat))), 'infinity'::DOUBLE) AS d FROM p a LEFT JOIN p b ON a.id <> b.id GROUP BY a.id)
SELECT id, round(d, 9) AS nn_distance, d > (SELECT avg(d) FROM d) * 1.1 AS labelled FROM d""")
def sta5(spark, sf):
    return T.thin_labels(V.mapping(spark, sf).where("lat is not null").select("id", "lat", "lon"), "id", "lon", "lat", 1.1).select("id", F.round("nn_distance", 9).alias("nn_distance"), "labelled")


@query("AGG12", _with(V.MAPPING) + ", p AS (SELECT id, lat, lon FROM mapping WHERE lat IS NOT NULL) SELECT round(avg(d), 9) AS mean_distance FROM (SELECT a.id, min(sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat))) AS d FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id)")
def agg12(spark, sf):
    thin = T.thin_labels(V.mapping(spark, sf).where("lat is not null").select("id", "lat", "lon"), "id", "lon", "lat")
    return thin.agg(F.round(F.avg("nn_distance"), 9).alias("mean_distance"))


@query("STA6", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem GROUP BY ALL")
def sta6(spark, sf):
    out = T.trend(V.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 4), "r2": F.round("r2", 9)})


@query("STA7", "SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders")
def sta7(spark, sf):
    return T.quartiles(V.table(spark, sf, "orders"), "o_totalprice")


@query("STA8", "SELECT l_returnflag, CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 50 THEN 11 ELSE floor(l_quantity / 5)::INT + 1 END::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def sta8(spark, sf):
    return T.histogram(V.table(spark, sf, "lineitem"), "l_quantity", 10, 0, 50, ["l_returnflag"])


@query("STA10", _with(V.METRICS, _WIDE) + "SELECT coalesce(max(coalesce(day, 0) + coalesce(night, 0)), 0) AS axis_max FROM wide")
def sta10(spark, sf):
    return T.axis_max(_wide(spark, sf), "day", "night")


# ---- joins -------------------------------------------------------------------


@query("JN1", _with(V.DETECTIONS, V.SEGMENTS) + "SELECT detections.row_idx, country, time_of_day AS condition FROM detections JOIN segments USING (video_id, start_time)")
def jn1(spark, sf):
    where = V.segments(spark, sf).select("video_id", "start_time", "country", F.col("time_of_day").alias("condition"))
    return V.detections(spark, sf).join(where, E.SEGMENT).select("row_idx", "country", "condition")


@query("JN2", _with(V.DETECTIONS, _CROSSED) + "SELECT row_idx FROM detections SEMI JOIN crossed USING (video_id, start_time, unique_id)")
def jn2(spark, sf):
    return E.crossing_rows(V.detections(spark, sf), _crossed(spark, sf)).select("row_idx")


@query("JN5", _with(V.METRICS) + "SELECT n_nationkey, n_name AS country, coalesce(max(speed) FILTER (condition = 0), 0) AS speed_day, coalesce(max(speed) FILTER (condition = 1), 0) AS speed_night FROM nation LEFT JOIN metrics ON n_name = country GROUP BY ALL")
def jn5(spark, sf):
    rows = V.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return R.write_back(rows, V.metrics(spark, sf), "speed", "speed")


_FEED = "feed AS (SELECT substr(r_name, 1, 3) AS iso3, r_regionkey * 10.5::DOUBLE AS gini FROM region WHERE r_regionkey <> 2)"


def _feed(spark, sf):
    return V.table(spark, sf, "region").where("r_regionkey <> 2").select(F.substring("r_name", 1, 3).alias("iso3"), (F.col("r_regionkey") * 10.5).alias("gini"))


@query("JN6", _with(V.MAPPING, _FEED) + "SELECT id, mapping.iso3, coalesce(feed.gini, mapping.gini) AS gini FROM mapping LEFT JOIN feed ON mapping.iso3 = feed.iso3")
def jn6(spark, sf):
    return R.enrich(V.mapping(spark, sf).select("id", "iso3", "gini"), _feed(spark, sf), "gini")


@query("JN7", _with(V.MAPPING, _FEED) + "SELECT id, mapping.iso3, feed.gini FROM mapping LEFT JOIN feed ON mapping.iso3 = feed.iso3")
def jn7(spark, sf):
    return R.overwrite(V.mapping(spark, sf).select("id", "iso3", "gini"), _feed(spark, sf), "gini")


@query("JN8", _with(V.MAPPING) + "SELECT r_regionkey, (SELECT min_by(continent, row_idx) FROM mapping WHERE lower(trim(country)) = lower(trim(r_name))) AS continent FROM region")
def jn8(spark, sf):
    keys = V.table(spark, sf, "region").select("r_regionkey", "r_name")
    return M.lookup(keys, V.mapping(spark, sf), {"r_name": "country"}, "continent").select("r_regionkey", "continent")


@query("JN9", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def jn9(spark, sf):
    return V.table(spark, sf, "customer").join(V.table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("JN10", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def jn10(spark, sf):
    return V.table(spark, sf, "customer").join(V.table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# ---- windows, orders, sets ---------------------------------------------------


@query("WIN1", _with(V.DETECTIONS) + "SELECT video_id, start_time, unique_id, min(row_idx) AS first_row, max(row_idx) AS last_row FROM detections WHERE unique_id IS NOT NULL GROUP BY ALL")
def win1(spark, sf):
    return V.detections(spark, sf).where("unique_id is not null").groupBy(*E.TRACK).agg(F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"))


@query("WIN2", _with(V.DETECTIONS) + "SELECT row_idx, lead(x, 10) OVER (PARTITION BY video_id, start_time, unique_id ORDER BY row_idx) - x AS moved FROM detections WHERE unique_id IS NOT NULL")
def win2(spark, sf):
    w = Window.partitionBy(*E.TRACK).orderBy("row_idx")
    return V.detections(spark, sf).where("unique_id is not null").select("row_idx", (F.lead("x", 10).over(w) - F.col("x")).alias("moved"))


@query("WIN4", _with(V.DETECTIONS) + "SELECT video_id, start_time, unique_id, min_by(x, row_idx) AS x0 FROM detections WHERE unique_id IS NOT NULL GROUP BY ALL")
def win4(spark, sf):
    return V.detections(spark, sf).where("unique_id is not null").groupBy(*E.TRACK).agg(F.min_by("x", "row_idx").alias("x0"))


@query("WIN7", "SELECT n_nationkey, CASE WHEN row_number() OVER (ORDER BY n_name) % 2 = 1 THEN 'top' ELSE 'bottom' END AS position FROM nation")
def win7(spark, sf):
    return plots.alternate(V.table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_name").select("n_nationkey", "position")


@query("WIN8", "SELECT n_name, CASE WHEN k <= 13 THEN 0 ELSE 1 END AS side, CASE WHEN k <= 13 THEN k ELSE k - 13 END::INT AS place FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS k FROM nation)")
def win8(spark, sf):
    return R.two_columns(V.table(spark, sf, "nation").select("n_name"), F.col("n_name"))


@query("WIN9", _with(V.MAPPING) + "SELECT iso3, min(k) AS place FROM (SELECT iso3, row_number() OVER (ORDER BY city) AS k FROM mapping) GROUP BY iso3")
def win9(spark, sf):
    return V.mapping(spark, sf).select("iso3", F.row_number().over(Window.orderBy("city")).alias("k")).groupBy("iso3").agg(F.min("k").cast("long").alias("place"))


@query("SRT1", _with(V.MAPPING) + "SELECT city, row_number() OVER (ORDER BY continent NULLS LAST, state NULLS LAST, city) AS place FROM mapping")
def srt1(spark, sf):
    order = Window.orderBy(F.col("continent").asc_nulls_last(), F.col("state").asc_nulls_last(), "city")
    return V.mapping(spark, sf).select("city", F.row_number().over(order).cast("long").alias("place"))


@query("SRT2", _with(V.MAPPING) + "SELECT iso3, min(continent) AS continent, min(country) AS country FROM mapping WHERE iso3 IS NOT NULL GROUP BY iso3 ORDER BY 2 NULLS LAST, 3 NULLS LAST")
def srt2(spark, sf):
    rows = R.roll_up(V.mapping(spark, sf), first=("country", "continent"), lists=(), sums=(), means=())
    return R.by_continent(rows, "country")


@query("SRT4", "SELECT n_name, row_number() OVER (ORDER BY substr(n_name, 1, 1), n_nationkey) AS place FROM nation")
def srt4(spark, sf):
    return V.table(spark, sf, "nation").select("n_name", F.row_number().over(Window.orderBy(F.substring("n_name", 1, 1), "n_nationkey")).cast("long").alias("place"))


@query("SRT5", _with(V.METRICS, _WIDE) + "SELECT country, row_number() OVER (ORDER BY coalesce(CASE WHEN day IS NULL THEN night WHEN night IS NULL THEN day ELSE (day + night) / 2 END, 0) DESC, country) AS place FROM wide")
def srt5(spark, sf):
    return _wide(spark, sf).select("country", F.row_number().over(Window.orderBy(S.safe_average("day", "night").desc(), "country")).cast("long").alias("place"))


@query("SRT6", "SELECT event_id, regexp_extract('frame_' || event_id || '.jpg', '(\\d+)', 1)::INT AS frame FROM events")
def srt6(spark, sf):
    name = F.concat(F.lit("frame_"), F.col("event_id").cast("string"), F.lit(".jpg"))
    return V.table(spark, sf, "events").select("event_id", S.frame_number(name).alias("frame")).orderBy("frame")


@query("SRT3", _with(V.METRICS, _WIDE) + "SELECT country, row_number() OVER (ORDER BY country) AS place FROM wide WHERE coalesce(day, 0) >= 0.005")
def srt3(spark, sf):
    return plots.stacked_bars(V.metrics(spark, sf), "speed", order_by="alphabetical", data_view="day").select("country", F.col("place").cast("long").alias("place"))


@query("SRT7", "SELECT c_nationkey, c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey DESC) AS place FROM customer")
def srt7(spark, sf):
    # one task ranks all rows here only to show the order; the order itself is a range sort
    rows = V.table(spark, sf, "customer").select("c_nationkey", "c_custkey")
    ranks = rows.groupBy("c_nationkey").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("c_nationkey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.col("c_custkey").desc()))
    return rows.join(F.broadcast(ranks), "c_nationkey").select("c_nationkey", "c_custkey", (F.col("before") + own).alias("place")).orderBy("c_nationkey", F.col("c_custkey").desc())


@query("LIM1", _with(V.MAPPING) + "SELECT id, iso3 FROM mapping WHERE contains(videos, 'v3') ORDER BY row_idx LIMIT 1")
def lim1(spark, sf):
    return V.mapping(spark, sf).where(F.contains("videos", F.lit("v3"))).orderBy("row_idx").limit(1).select("id", "iso3")


_DIFFS = "diffs AS (SELECT country, max(speed) FILTER (condition = 0) AS day, max(speed) FILTER (condition = 1) AS night, abs(day - night) AS diff FROM metrics GROUP BY country HAVING day IS NOT NULL AND night IS NOT NULL)"


@query("TOP1", _with(V.METRICS, _DIFFS) + "(SELECT 'top' AS kind, * FROM diffs ORDER BY diff DESC, country LIMIT 5) UNION ALL (SELECT 'bottom' AS kind, * FROM diffs ORDER BY diff, country DESC LIMIT 5)")
def top1(spark, sf):
    top, bottom = R.extremes(R.day_night(V.metrics(spark, sf), "speed"))
    return top.select(F.lit("top").alias("kind"), "*").unionByName(bottom.select(F.lit("bottom").alias("kind"), "*"))


@query("SET1", _with(V.MAPPING) + "SELECT city, country, gini FROM mapping UNION ALL SELECT 'NATION_7B', NULL, gini FROM mapping WHERE city = 'NATION_7'")
def set1(spark, sf):
    return R.derived_row(V.mapping(spark, sf).select("city", "country", "gini"), "city", "NATION_7", "NATION_7B", ["city", "gini"])


@query("SET2", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set2(spark, sf):
    return V.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(V.table(spark, sf, "supplier").select("s_nationkey"))


@query("SET4", _with(V.DETECTIONS) + "SELECT DISTINCT video_id, unique_id FROM detections")
def set4(spark, sf):
    return V.detections(spark, sf).select("video_id", "unique_id").distinct()


# ---- scalar functions --------------------------------------------------------


@query("SCL1", "SELECT n_nationkey, n_name AS video_id, n_regionkey AS start_time FROM nation")
def scl1(spark, sf):
    stem = F.concat("n_name", F.lit("_"), F.col("n_regionkey").cast("string"))
    return V.table(spark, sf, "nation").select("n_nationkey", S.segment_of_stem(stem).alias("s")).select("n_nationkey", "s.*")


@query("SCL2", "SELECT n_nationkey, n_name || '_x' AS name, (n_regionkey % 2)::VARCHAR AS condition FROM nation")
def scl2(spark, sf):
    key = F.concat("n_name", F.lit("_x_"), (F.col("n_regionkey") % 2).cast("string"))
    return V.table(spark, sf, "nation").select("n_nationkey", S.key_parts(key).alias("s")).select("n_nationkey", "s.*")


@query("SCL3", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'C' || n_nationkey WHEN 1 THEN 'C' || n_nationkey ELSE 'C' || n_nationkey || ', S1' END AS label FROM nation")
def scl3(spark, sf):
    k = F.col("n_nationkey") % 3
    city = F.concat(F.lit("C"), F.col("n_nationkey").cast("string"))
    text = F.when(k == 0, city).when(k == 1, F.concat(city, F.lit("_Unknown"))).otherwise(F.concat(city, F.lit("_S1")))
    return V.table(spark, sf, "nation").select("n_nationkey", S.city_state(text).alias("label"))


@query("SCL4", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Russian Federation' WHEN 1 THEN 'Viet Nam' WHEN 2 THEN 'Turkey' ELSE n_name END AS country FROM nation")
def scl4(spark, sf):
    k = F.col("n_nationkey") % 4
    name = F.when(k == 0, "Russia").when(k == 1, "Vietnam").when(k == 2, "Türkiye").otherwise(F.col("n_name"))
    return V.table(spark, sf, "nation").select("n_nationkey", S.correct_country(name).alias("country"))


@query("SCL5", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'XKX' WHEN r_regionkey IS NULL THEN 'Country not found' ELSE substr(r_name, 1, 3) END AS iso3 FROM (SELECT *, CASE WHEN n_nationkey = 3 THEN 'Kosovo' WHEN n_nationkey % 4 = 0 THEN 'nowhere' ELSE rn END AS c FROM (SELECT n_nationkey, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey)) k LEFT JOIN region ON r_name = c")
def scl5(spark, sf):
    n, r = V.table(spark, sf, "nation"), V.table(spark, sf, "region")
    codes = r.select(F.col("r_name").alias("country"), F.substring("r_name", 1, 3).alias("cca3"), F.substring("r_name", 1, 2).alias("cca2"))
    rows = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", F.when(F.col("n_nationkey") == 3, "Kosovo").when(F.col("n_nationkey") % 4 == 0, "nowhere").otherwise(F.col("r_name")).alias("country"))
    return S.country_codes(rows, codes).select("n_nationkey", "iso3")


@query("SCL6", _with(V.MAPPING) + "SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN iso3 END, nullif(CASE WHEN id % 3 = 0 THEN '' ELSE 'OLD' END, '')) AS iso3 FROM mapping")
def scl6(spark, sf):
    found, old = F.when(F.col("id") % 2 == 0, F.col("iso3")), F.when(F.col("id") % 3 == 0, "").otherwise("OLD")
    return V.mapping(spark, sf).select("id", S.iso3_or_existing(found, old).alias("iso3"))


@query("SCL7", _with(V.MAPPING) + "SELECT id, coalesce(state, 'Unknown') AS continent FROM mapping")
def scl7(spark, sf):
    return V.mapping(spark, sf).select("id", S.continent_or_unknown(F.col("state")).alias("continent"))


@query("SCL8", _with(V.MAPPING) + "SELECT id, CASE WHEN id % 2 = 0 THEN (SELECT min(substr(r_name, 1, 2)) FROM region WHERE substr(r_name, 1, 3) = iso3) END AS iso2 FROM mapping")
def scl8(spark, sf):
    codes = V.table(spark, sf, "region").select(F.col("r_regionkey").alias("row_idx"), F.substring("r_name", 1, 3).alias("cca3"), F.substring("r_name", 1, 2).alias("iso2"))
    keys = V.mapping(spark, sf).select("id", F.when(F.col("id") % 2 == 0, F.coalesce("iso3", F.lit("?"))).otherwise("none").alias("code"))
    return M.lookup(keys, codes, {"code": "cca3"}, "iso2").select("id", "iso2")


@query("SCL9", "SELECT n_nationkey, chr(127462 - 65 + ascii(substr(n_name, 1, 1))) || chr(127462 - 65 + ascii(substr(n_name, 2, 1))) AS flag FROM nation")
def scl9(spark, sf):
    return V.table(spark, sf, "nation").select("n_nationkey", S.flag(F.substring("n_name", 1, 2)).alias("flag"))


@query("SCL10", "SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(lower(c_mktsegment || ' d''' || c_name), '[a-z]+|[^a-z]+'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '') AS title FROM customer")
def scl10(spark, sf):
    return V.table(spark, sf, "customer").select("c_custkey", S.title_case(F.concat("c_mktsegment", F.lit(" d'"), "c_name")).alias("title"))


@query("SCL11", "SELECT p_partkey, upper(substr(t, 1, 1)) || lower(substr(t, 2)) AS label FROM (SELECT p_partkey, replace(p_name, '_', ' ') AS t FROM part)")
def scl11(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", S.prettify(F.col("p_name")).alias("label"))


@query("SCL12", "SELECT p_partkey, lower(trim('  ' || p_type || ' ')) AS t FROM part")
def scl12(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", S.normalise(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("t"))


@query("SCL13", "SELECT p_partkey, len(regexp_extract_all(p_type || ', ' || p_brand, '[\\w-]+'))::INT AS n FROM part")
def scl13(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", F.size(S.tokens(F.concat("p_type", F.lit(", "), "p_brand"))).alias("n"))


@query("SCL14", "SELECT c_custkey, c_name AS video FROM customer")
def scl14(spark, sf):
    return V.table(spark, sf, "customer").select("c_custkey", S.video_of_path(F.concat(F.lit("/data/x.y/"), "c_name", F.lit(".mp4"))).alias("video"))


@query("SCL15", "SELECT o_orderkey, strftime(o_orderdate, '%d%m%Y') AS d FROM orders")
def scl15(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", S.compact_date(F.col("o_orderdate")).alias("d"))


@query("SCL16", "SELECT o_orderkey, isodow(o_orderdate) = 1 AS monday FROM orders")
def scl16(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", S.is_monday(F.col("o_orderdate")).alias("monday"))


@query("SCL17", "SELECT l_orderkey, l_linenumber, least(30.0::DOUBLE, greatest(5.0::DOUBLE, l_quantity)) AS q FROM lineitem")
def scl17(spark, sf):
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.clamp(F.col("l_quantity"), F.lit(5.0), F.lit(30.0)).alias("q"))


@query("SCL18", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 0) AS fps FROM lineitem")
def scl18(spark, sf):
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.round_rate(F.col("l_quantity") / 4).alias("fps"))


@query("SCL19", _with(V.MAPPING) + "SELECT id, len(vs)::INT AS n, coalesce(list_position(vs, 'v1'), 0)::BIGINT AS at, list_contains(vs, 'w7') AS has FROM (SELECT id, regexp_extract_all(videos, '[\\w-]+') AS vs FROM mapping)")
def scl19(spark, sf):
    vs = M.parse_videos(F.col("videos"))
    return V.mapping(spark, sf).select("id", F.size(vs).alias("n"), F.array_position(vs, "v1").alias("at"), F.array_contains(vs, "w7").alias("has"))


@query("SCL20", "SELECT p_partkey, p_retailprice / nullif(p_size % 3, 0) AS q FROM part")
def scl20(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", F.try_divide("p_retailprice", F.col("p_size") % 3).alias("q"))


@query("SCL21", _with(V.SEGMENTS) + "SELECT video_id || '_' || start_time || '.csv' AS name FROM segments")
def scl21(spark, sf):
    return V.segments(spark, sf).select(S.segment_file(F.col("video_id"), F.col("start_time")).alias("name"))


@query("SCL22", "SELECT p_partkey, printf('%.2f', p_size / 8) AS t FROM part")
def scl22(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", S.two_decimals(F.col("p_size") / 8).alias("t"))


@query("SCL23", "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def scl23(spark, sf):
    return V.table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# ---- plot-ready tables -------------------------------------------------------


@query("PLT1", _with(V.MAPPING) + "SELECT city, iso3, gini FROM mapping WHERE coalesce(gini, 0) <> 0 UNION ALL SELECT 'GREENLAND', 'GRL', gini FROM mapping WHERE city = 'NATION_7' AND coalesce(gini, 0) <> 0")
def plt1(spark, sf):
    return plots.choropleth(V.mapping(spark, sf).select("city", "iso3", "gini"), "gini", name="city", source="NATION_7", target="GREENLAND", code="GRL")


@query("PLT2", _with(V.MAPPING) + "SELECT CASE city WHEN 'NATION_7' THEN 'Nation Seven' ELSE city END AS city, lon, lat FROM mapping WHERE lon IS NOT NULL")
def plt2(spark, sf):
    return plots.city_points(V.mapping(spark, sf), {"NATION_7": "Nation Seven"})


_PAIRED = "paired AS (SELECT country, max(speed) FILTER (condition = 0) AS speed_0, max(speed) FILTER (condition = 1) AS speed_1, max(time) FILTER (condition = 0) AS time_0, max(time) FILTER (condition = 1) AS time_1 FROM metrics WHERE speed IS NOT NULL AND time IS NOT NULL GROUP BY country)"


@query("PLT3", _with(V.METRICS, _PAIRED) + ", k AS (SELECT *, row_number() OVER (ORDER BY substr(country, 1, 1), country) AS k FROM paired) SELECT * EXCLUDE k, CASE WHEN k <= ceil((SELECT count(*) FROM k) / 2) THEN 0 ELSE 1 END AS side FROM k")
def plt3(spark, sf):
    m = V.metrics(spark, sf)
    return plots.paired_bars(m.select("country", "condition", "speed"), m.select("country", "condition", "time")).drop("place")


@query("PLT4", _with(V.METRICS, _WIDE) + "SELECT country, day, night, coalesce(CASE WHEN day IS NULL THEN night WHEN night IS NULL THEN day ELSE (day + night) / 2 END, 0) AS mean, row_number() OVER (ORDER BY mean DESC, country) AS place FROM wide WHERE coalesce(day, 0) >= 0.005 OR coalesce(night, 0) >= 0.005")
def plt4(spark, sf):
    return plots.stacked_bars(V.metrics(spark, sf), "speed", order_by="average", data_view="combined").withColumn("place", F.col("place").cast("long"))


@query("PLT5", _with(V.METRICS) + "SELECT country, round(max(people) FILTER (condition = 0) / 100.0::DOUBLE / 7 * 1000000 + 1e-9, 2) AS day, round(max(people) FILTER (condition = 1) / 100.0::DOUBLE / 7 * 1000000 + 1e-9, 2) AS night FROM metrics GROUP BY country")
def plt5(spark, sf):
    m = V.metrics(spark, sf).select("country", "condition", F.col("people").alias("crossings"), F.lit(100.0).alias("seconds"), F.lit(7).alias("persons"))
    return plots.crossing_bars(m, slack=1e-9).select("country", "day", "night")


@query("PLT6", _with(*_BASE, _EQ_LIGHT, _BY_CONDITION) + "SELECT country, coalesce(max(with_equipment) FILTER (condition = 0), 0)::DOUBLE AS with_day, coalesce(max(with_equipment) FILTER (condition = 1), 0)::DOUBLE AS with_night FROM eqc GROUP BY country")
def plt6(spark, sf):
    lights = E.equipment_by_condition(E.crossings_with_equipment(V.detections(spark, sf), _shapes(spark, sf), (9,)), V.segments(spark, sf))
    countries = lights.select("country").distinct()
    wide = R.write_back(countries, lights.withColumn("v", F.col("with_equipment").cast("double")), "v", "with")
    return wide.select("country", "with_day", "with_night")


@query("PLT7", _with(V.MAPPING) + """, r AS (SELECT continent, rank() OVER (PARTITION BY continent ORDER BY gini) + (count(*) OVER (PARTITION BY continent, gini) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY continent ORDER BY traffic_index) + (count(*) OVER (PARTITION BY continent, traffic_index) - 1) / 2.0::DOUBLE AS ry FROM mapping WHERE gini IS NOT NULL)
SELECT continent, round(corr(rx, ry), 9) AS rho FROM r GROUP BY continent""")
def plt7(spark, sf):
    rho = plots.correlations(V.mapping(spark, sf), ["gini", "traffic_index"], ["continent"])
    return rho.where("row = 'gini' and col = 'traffic_index'").select("continent", F.round("rho", 9).alias("rho"))


@query("PLT7M", _with(V.MAPPING) + """, f AS (SELECT row_idx, continent, unnest(['traffic_mortality', 'gini', 'literacy_rate', 'traffic_index', 'constant']) AS f, unnest([traffic_mortality, gini, literacy_rate, traffic_index, 1.0::DOUBLE]) AS v FROM mapping),
  long AS (SELECT a.continent, a.f AS "row", b.f AS col, a.v AS x, b.v AS y FROM f a JOIN f b USING (row_idx) WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
  r AS (SELECT continent, "row", col, rank() OVER (PARTITION BY continent, "row", col ORDER BY x) + (count(*) OVER (PARTITION BY continent, "row", col, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY continent, "row", col ORDER BY y) + (count(*) OVER (PARTITION BY continent, "row", col, y) - 1) / 2.0::DOUBLE AS ry FROM long)
SELECT continent, "row", col, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 9) AS rho FROM r GROUP BY ALL""")
def plt7m(spark, sf):
    """The whole matrix of each continent, of which PLT7 takes one cell."""
    rho = plots.correlations(V.mapping(spark, sf).withColumn("constant", F.lit(1.0)), _FEATURES, ["continent"])
    return rho.withColumn("rho", F.round("rho", 9))


@query("PLT8", _with(V.MAPPING) + """, p AS (SELECT id, lon, lat FROM mapping WHERE lat IS NOT NULL), d AS (SELECT a.id, a.lon, a.lat, min(sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat))) AS d FROM p a JOIN p b ON a.id <> b.id GROUP BY ALL)
SELECT id, lon, lat, d > (SELECT avg(d) FROM d) AS labelled FROM d""")
def plt8(spark, sf):
    return plots.scatter(V.mapping(spark, sf).select("id", "lon", "lat"), "id", "lon", "lat").select("id", "lon", "lat", "labelled")


@query("PLT9", "SELECT CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 21 ELSE floor(o_totalprice / 25000)::INT + 1 END::BIGINT AS bin, count(*) AS n FROM orders GROUP BY ALL")
def plt9(spark, sf):
    return plots.hist(V.table(spark, sf, "orders"), ["o_totalprice"], 20, 0, 500_000)


from kerbline.plans import files as _files  # noqa: E402, F401  registers the queries that go through files; it needs what stands above
