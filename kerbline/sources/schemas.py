"""Schemas of the engine's inputs."""

from pyspark.sql import types as T

_F = T.StructField

#: One bounding box in one frame, as the tracker's CSV has it; an untracked box has no id.
DETECTION_CSV = T.StructType([_F("yolo_id", T.IntegerType()), _F("x", T.DoubleType()), _F("y", T.DoubleType()), _F("width", T.DoubleType()), _F("height", T.DoubleType()), _F("unique_id", T.DoubleType()), _F("frame_count", T.IntegerType())])

#: A space-separated label file of one frame; its number is in its name.
LABEL_TXT = T.StructType(DETECTION_CSV.fields[:-1])

_LISTS = ("videos", "start_time", "end_time", "time_of_day", "fps_list", "vehicle_type", "upload_date")
_NUMBERS = ("gmp", "population_city", "population_country", "traffic_mortality", "literacy_rate", "avg_height", "gini", "traffic_index", "lat", "lon")
MAPPING_CSV = T.StructType([_F("id", T.LongType()), *(_F(c, T.StringType()) for c in ("city", "state", "country", "continent", "iso3", *_LISTS)), *(_F(c, T.DoubleType()) for c in _NUMBERS)])

#: Indicator feed: several years for a country.
INDICATOR = T.StructType([_F("iso3", T.StringType()), _F("name", T.StringType()), _F("year", T.IntegerType()), _F("value", T.DoubleType())])

#: COCO class codes.
PERSON, BICYCLE, CAR, MOTORCYCLE, BUS, TRUCK, TRAFFIC_LIGHT, STOP_SIGN, CELLPHONE = 0, 1, 2, 3, 5, 7, 9, 11, 67
CLASS_NAMES = {PERSON: "person", BICYCLE: "bicycle", CAR: "car", MOTORCYCLE: "motorcycle", BUS: "bus", TRUCK: "truck", CELLPHONE: "cellphone", TRAFFIC_LIGHT: "traffic_light", STOP_SIGN: "stop_sign"}
EQUIPMENT = (TRAFFIC_LIGHT, STOP_SIGN)

DAY, NIGHT, POOLED = 0, 1, 2
