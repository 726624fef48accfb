"""The whole analysis: from detections and the city table to the named result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators import events as E
from kerbline.operators import mapping as M
from kerbline.operators import metrics as G
from kerbline.operators import rollup as R
from kerbline.sources import scans, sinks
from kerbline.sources.scans import Config
from kerbline.sources.schemas import CLASS_NAMES
from kerbline.sources.staging import staged


def analyse(detections: DataFrame, mapping: DataFrame, config: Config = Config(), gazetteer: DataFrame | None = None, fix_known_defects: bool = False) -> dict[str, DataFrame]:
    """Every result by name.

    The detections are read three times, whatever is asked of the results: for the classes and ids of each segment,
    for the tracks that cross, and for hesitation. These three tables are far smaller; they are
    written to the shared folder, and all results derive from them. gazetteer: city, state, country, lat, lon
    of cities the mapping has no place of.
    """
    mapping = scans.allow_countries(mapping, config.countries_analyse)
    if gazetteer is not None:
        mapping = M.locate(mapping, gazetteer)
    segments = M.first_match(M.explode_segments(mapping))
    seen = staged(G.class_tracks(detections), "class-tracks")
    shapes = staged(E.track_shapes(detections, config.boundary_left, config.boundary_right), "track-shapes")
    hesitation = staged(E.hesitation_times(detections, segments, fix_known_defects=fix_known_defects), "hesitation")
    times = E.crossing_times(shapes, segments)
    speeds = E.crossing_speeds(times, fix_known_defects=fix_known_defects)
    crossed = E.crossing_counts(shapes)
    counts = G.object_counts(seen)
    cities = G.city_totals(counts, segments).where("id is not null")
    speed = E.mean_by_condition(speeds, "speed", "speed")
    time = E.mean_by_condition(hesitation, "hesitation_s", "time")
    lit_up = E.crossings_with_equipment(seen, shapes, (9,))
    lights = E.equipment_by_condition(lit_up, segments)
    found = {
        "segments": segments,
        "crossings": times.select(*E.TRACK, "crossing_time_s"),
        "counts": counts,
        "city_totals": cities,
        "speed": speed,
        "time": time,
        "equipment": E.equipment_by_condition(E.crossings_with_equipment(seen, shapes), segments),
        "light_share": E.light_share(seen, shapes, segments),
        "crossings_by_condition": E.crossings_by_condition(crossed, segments),
        "cell_phones": G.cell_phones(counts, segments),
        "traffic_signs": G.traffic_signs(seen, segments, G.last_crossings(crossed), fix_known_defects),
        "clips": clips(times, lit_up, segments),
    }
    for name, codes in {"vehicles": G.traffic_classes(motorcycle=True, car=True, bus=True, truck=True), "bicycles": G.traffic_classes(bicycle=True), "cars": G.traffic_classes(car=True, fix_known_defects=fix_known_defects), "motorcycles": G.traffic_classes(motorcycle=True, fix_known_defects=fix_known_defects), "buses": G.traffic_classes(bus=True), "trucks": G.traffic_classes(truck=True), "persons": G.traffic_classes(person=True)}.items():
        found[f"traffic_{name}"] = G.traffic(seen, segments, codes, fix_known_defects)
    table = mapping.withColumn("total_videos", M.videos_per_row(F.col("videos"))).join(cities, "id", "left")
    table = table.withColumns({c: F.coalesce(c, F.lit(0)) for c in [*CLASS_NAMES.values(), "total_time"]})
    table = R.write_back(table, speed, "speed", "speed_crossing", pooled=True).withColumn("speed_crossing", F.lit(0.0))
    table = R.write_back(table, time, "time", "time_crossing", pooled=True).withColumn("time_crossing", F.lit(0.0))
    table = R.write_back(table, lights.withColumn("v", F.col("with_equipment").cast("double")), "v", "with_trf_light")
    table = R.write_back(table, lights.withColumn("v", F.col("without_equipment").cast("double")), "v", "without_trf_light")
    people = G.pooled_rate(G.segment_rates(seen, segments, (0,), True), "persons")
    rates = E.per_minute_and_person(lights, people)
    table = R.write_back(table, rates, "with_rate", "with_trf_light_norm")
    table = R.write_back(table, rates, "without_rate", "without_trf_light_norm")
    found["cities"] = R.by_continent(table, "city")
    found["countries"] = R.country_table(table)
    return found


def clips(times: DataFrame, lit_up: DataFrame, segments: DataFrame) -> DataFrame:
    """The stretch of the recording around each crossing with a light in view."""
    rows = times.join(lit_up.where("equipped"), E.TRACK).join(segments.select(*E.SEGMENT, "duration"), E.SEGMENT)
    at = rows.withColumn("t", F.least("at_low", "at_high") / F.col("fps"))
    return sinks.event_clips(at, "t", "duration").select(*E.TRACK, "t0", "t1")
