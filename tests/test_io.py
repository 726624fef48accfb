"""Sources, sinks, streaming and the batch plan on small files."""

import json
import time

import pytest
from pyspark.sql import functions as F

from kerbline.functions import scalars as S
from kerbline.functions import stats as T
from kerbline.operators import mapping as M
from kerbline.plans import batch, plots
from kerbline.plans import views as V
from kerbline.sources import scans, sinks
from kerbline.sources.schemas import MAPPING_CSV
from kerbline.streaming import ingest

HEAD = "YOLO_id,X-center,Y-center,Width,Height,Unique Id,Frame Count\n"


@pytest.fixture
def mapping_rows(spark):
    row = dict.fromkeys(MAPPING_CSV.fieldNames())
    rows = [
        row | {"id": 1, "city": "A", "country": "Aland", "continent": "E", "iso3": "ALA", "videos": "[abc_x,def]", "start_time": "[[0,60],[10]]", "end_time": "[[30,95],[40]]", "time_of_day": "[[0,1],[1]]", "fps_list": "[30, None]", "avg_height": 170.0},
        row | {"id": 2, "city": "B", "state": "S", "country": "Bland", "continent": "E", "iso3": "BLA", "videos": "['def', 'ghi']", "start_time": "[[10],[5]]", "end_time": "[[99],[9]]", "time_of_day": "[[0],[0]]", "fps_list": "[25, 0]", "avg_height": 165.0},
    ]
    return spark.createDataFrame(rows, MAPPING_CSV)


def test_detections_scan(spark, tmp_path, mapping_rows):
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    two.mkdir()
    (one / "abc_x_0.csv").write_text(HEAD + "0,0.30,0.5,0.05,0.20,1,1\n9,0.80,0.2,0.02,0.05,,1\n0,0.60,0.5,0.05,0.20,1,2\n")
    (one / "def_10.csv").write_text(HEAD + "0,0.10,0.5,0.05,0.20,1,1\n")
    (two / "def_10.csv").write_text(HEAD + "2,0.20,0.5,0.05,0.20,7.0,1\n2,0.25,0.5,0.05,0.20,7.0,2\n")
    (one / "other_0.csv").write_text(HEAD + "0,0.10,0.5,0.05,0.20,1,1\n")
    (one / "nonumber.csv").write_text(HEAD + "0,0.10,0.5,0.05,0.20,1,1\n")
    (one / "abc_x_60.txt").write_text("x")
    mapping = mapping_rows.withColumn("row_idx", F.col("id"))
    folders = [str(one), str(tmp_path / "absent"), str(two)]
    rows = scans.scan_detections(spark, folders, mapping).orderBy("video_id", "row_idx").collect()
    assert [(r["video_id"], r["start_time"], r["yolo_id"], r["x"], r["unique_id"]) for r in rows] == [("abc_x", 0, 0, 0.3, 1), ("abc_x", 0, 9, 0.8, None), ("abc_x", 0, 0, 0.6, 1), ("def", 10, 2, 0.2, 7), ("def", 10, 2, 0.25, 7)]
    assert {r["video_id"] for r in scans.scan_detections(spark, folders, mapping, ["bla"]).collect()} == set()
    assert scans.scan_detections(spark, [str(tmp_path / "absent")], mapping).collect() == []


def test_mapping_round_trip_and_segments(spark, tmp_path, mapping_rows):
    path = str(tmp_path / "mapping")
    sinks.rewrite_mapping(mapping_rows.coalesce(1), "elsewhere", path)
    with pytest.raises(ValueError):
        sinks.rewrite_mapping(mapping_rows, path, path + "/")
    back = scans.scan_mapping(spark, path)
    assert back.drop("row_idx").collect() == mapping_rows.collect()
    assert scans.scan_mapping(spark, path, ["BLA"]).count() == 1
    segs = M.first_match(M.explode_segments(back)).orderBy("video_id", "start_time").collect()
    assert [(r["video_id"], r["start_time"], r["end_time"], r["time_of_day"], r["id"], r["state"], r["fps"], r["duration"]) for r in segs] == [
        ("abc_x", 0, 30, 0, 1, "unknown", 30.0, 30), ("abc_x", 60, 95, 1, 1, "unknown", 30.0, 35), ("def", 10, 40, 1, 1, "unknown", 30.0, 30), ("ghi", 5, 9, 0, 2, "S", 30.0, 4),
    ]
    assert M.total_videos(back).first()[0] == 4 and M.total_videos(back, fix_known_defects=True).first()[0] == 4
    assert [r[0] for r in back.select(M.videos_per_row(F.col("videos"))).collect()] == [2, 2]


def test_labels_indicator_heights_config(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "label_12.txt").write_text("0 0.5 0.5 0.1 0.2 3\n9 0.1 0.5 0.1 0.2\n")
    rows = scans.scan_labels(spark, str(tmp_path / "labels")).orderBy("row_idx").collect()
    assert [(r["yolo_id"], r["unique_id"], r["frame_count"]) for r in rows] == [(0, 3.0, 12), (9, None, 12)]
    (tmp_path / "feed.csv").write_text("iso3,name,year,value\nAAA,a,2019,1.5\nAAA,a,2021,2.5\nBBB,b,2020,\n")
    latest = scans.latest_per_key(scans.scan_indicator(spark, str(tmp_path / "feed.csv"))).orderBy("iso3").collect()
    assert [(r["iso3"], r["year"], r["value"]) for r in latest] == [("AAA", 2021, 2.5), ("BBB", 2020, None)]
    (tmp_path / "h.csv").write_text("place,pop2023,growthRate,area,country,cca3,cca2,ccn3,region,subregion,landAreaKm,density,densityMi,Rank,year,meanHeightMale,meanHeightFemale,rank\n356,1,0.1,3,India,IND,IN,356,Asia,S,2,4,1,1,2019,166.5,155.2,180\n")
    h = scans.scan_heights(spark, str(tmp_path / "h.csv")).first()
    assert (h["cca3"], h["pop_rank"], h["height_male"], h["height_rank"]) == ("IND", 1.0, 166.5, 180.0)
    c = scans.load_config(json.dumps({"data": ["a", "b"], "mapping": "m.csv", "extra": 1}), json.dumps({"data": 0}))
    assert c.data == ("a", "b") and c.more == {"extra": 1}
    with pytest.raises(ValueError):
        scans.load_config("{}", json.dumps({"data": 0}))
    assert scans.secret('{"key": 5}', "key") == 5


def test_sinks_and_results(spark, tmp_path):
    df = spark.range(3).withColumn("video_id", F.lit("v"))
    sinks.append_detections(df, str(tmp_path / "d"))
    sinks.append_detections(df, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 6
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3
    sinks.write_results({"a": df, "b": df.limit(1)}, str(tmp_path / "r"))
    assert scans.scan_result(spark, str(tmp_path / "r"), "b").count() == 1


def test_streams(spark, tmp_path):
    rows = [("v", 0, k, k / 100, 0.5, 1 if k % 2 else None) for k in range(100)] + [("v", 60, 200, 0.9, 0.5, 1)]
    df = spark.createDataFrame(rows, "video_id string, start_time int, row_idx long, x double, y double, unique_id long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_detections(spark, str(tmp_path / "in"), df.schema)
    ingest.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 101
    q = ingest.trails(stream).writeStream.format("memory").queryName("trails").outputMode("update").start()
    ends = time.time() + 60
    while not (got := spark.sql("select * from trails").collect()) and time.time() < ends:  # it goes on as long as a track may time out
        time.sleep(1)
    q.stop()
    assert {r["start_time"]: r["xs"] for r in got} == {0: [k / 100 for k in range(100) if k % 2][-30:], 60: [0.9]}


def test_batch(spark, small_sf):
    det = V.detections(spark, small_sf)
    mapping = V.mapping(spark, small_sf).withColumn("population_city", F.lit(1.0))
    found = batch.analyse(det, mapping)
    assert "events" not in found["countries"]._jdf.queryExecution().optimizedPlan().toString()  # the detections were read before
    assert found["traffic_signs"].count() > 0 and {"t0", "t1"} <= set(found["clips"].columns)
    few = batch.analyse(det, mapping, scans.Config(countries_analyse=("AFR",)))
    assert {r["iso3"] for r in few["countries"].collect()} == {"AFR"}
    countries = found["countries"].collect()
    assert len(countries) == V.mapping(spark, small_sf).where("iso3 is not null").select("iso3").distinct().count()
    assert len(countries[0]) == 43
    assert {"speed", "time", "traffic_cars", "light_share"} <= found.keys()
    assert found["cities"].count() == 25


def test_driver_side_helpers():
    a = [{"x": 0.5, "y": 0.5}, {"x": 0.6, "y": 0.5}, {"x": 0.55, "y": 0.55}, {"x": 0.9, "y": 0.1}]
    assert [round(b["y"], 4) for b in S.adjust_annotations(a)] == [0.5, 0.51, 0.57, 0.1]
    assert S.legend_positions(["a", "b"], 0.1, 0.9, 0.05) == [("a", 0.1, 0.9), ("b", 0.1, pytest.approx(0.85))]
    assert T.select_features(["speed_0", "speed_1", "speed_val0", "gini0"]) == ["speed_0", "gini0"]


def test_scalar_edges(spark):
    df = spark.createDataFrame([("cote d'ivoire",), ("guinea-bissau",), ("ünlü 3rd",), (None,)], "t string")
    assert [r[0] for r in df.select(S.title_case(F.col("t"))).collect()] == ["Cote D'Ivoire", "Guinea-Bissau", "Ünlü 3Rd", None]
    assert spark.range(1).select(S.flag(F.lit("nl")), S.flag(F.lit(None).cast("string"))).first()[:] == ("\U0001f1f3\U0001f1f1", "\U0001f1fd\U0001f1f0")
    assert spark.range(1).select(S.two_decimals(F.lit(0.625)), S.round_rate(F.lit(2.5))).first()[:] == ("0.62", 2.0)
    with pytest.raises(Exception, match="no video id"):
        spark.range(1).select(S.video_of_path(F.lit("/a/b.mp4"))).collect()


def test_thin_labels_against_all_pairs(spark):
    import random

    rng = random.Random(9)
    pts = [(k, rng.random() ** 3, rng.random()) for k in range(200)] + [(900, 50.0, 50.0), (901, 50.0, 50.0), (902, -70.0, 3.0)]
    got = {r["k"]: r["nn_distance"] for r in T.thin_labels(spark.createDataFrame(pts, "k int, x double, y double"), "k", "x", "y").collect()}
    for k, x, y in pts:
        assert got[k] == pytest.approx(min(((x - a) ** 2 + (y - b) ** 2) ** 0.5 for j, a, b in pts if j != k))
    assert T._grids(1) == [8, 1] and T._grids(10**6) == [32768, 4096, 512, 64, 8, 1]
    one = T.thin_labels(spark.createDataFrame([(1, 1.0, 2.0)], "k int, x double, y double"), "k", "x", "y").first()
    assert one["nn_distance"] == float("inf")


def test_places_screenshots_and_bars_without_numbers(spark):
    rows = spark.createDataFrame([(1, "A", None, "X", None, 1.0), (2, "B", "S", "X", 3.0, 4.0), (3, "C", "nan", "Y", float("nan"), 2.0), (4, "D", None, "Z", None, None)], "id int, city string, state string, country string, lat double, lon double")
    places = spark.createDataFrame([("A", None, "X", 5.0, 6.0), ("C", None, "Y", 7.0, 8.0), ("B", "S", "X", 0.0, 0.0)], "city string, state string, country string, lat double, lon double")
    got = {r["id"]: (r["lat"], r["lon"]) for r in M.locate(rows, places).collect()}
    assert got == {1: (5.0, 6.0), 2: (3.0, 4.0), 3: (7.0, 8.0), 4: (None, None)}
    files = spark.createDataFrame([("a.png",), ("A.jpg",), ("d.x.png",), ("c.png",)], "file string")
    assert {r["id"]: r["file"] for r in M.screenshot_of(rows, files).collect()} == {1: "A.jpg", 3: "c.png"}
    bars = spark.createDataFrame([("P", 0, float("nan")), ("P", 1, 0.5), ("Q", 0, float("nan")), ("R", 0, 0.3)], "country string, condition int, speed double")
    assert [(r["country"], r["day"], r["night"]) for r in plots.stacked_bars(bars, "speed", "average").orderBy("place").collect()] == [("P", None, 0.5), ("R", 0.3, None)]


def test_plot_arguments(spark):
    with pytest.raises(ValueError):
        plots.stacked_bars(spark.range(1), "height")
    with pytest.raises(ValueError):
        plots.hist(spark.range(1), ["a", "b"], 5, 0, 1, color="c")
