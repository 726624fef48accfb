"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings and the names they stand for.
COUNTRY_NAMES = {
    "Russia": "Russian Federation",
    "Syria": "Syrian Arab Republic",
    "Korea": "Korea, Republic of",
    "South Korea": "Korea, Republic of",
    "Taiwan": "Taiwan, Province of China",
    "Turkiye": "Turkey",
    "Türkiye": "Turkey",
    "Vietnam": "Viet Nam",
    "Moldova": "Moldova, Republic of",
    "Venezuela": "Venezuela, Bolivarian Republic of",
    "Bolivia": "Bolivia, Plurinational State of",
}


def segment_of_stem(stem: Column) -> Column:
    """{video}_{start}, cut at the last underscore; null start if there is no number."""
    return F.struct(F.nullif(F.regexp_extract(stem, r"^(.*)_([0-9]+)$", 1), F.lit("")).alias("video_id"), F.nullif(F.regexp_extract(stem, r"^(.*)_([0-9]+)$", 2), F.lit("")).cast("int").alias("start_time"))


def key_parts(key: Column) -> Column:
    """Name and condition of a composite key, cut at the last underscore."""
    return F.struct(F.regexp_extract(key, r"^(.*)_([^_]*)$", 1).alias("name"), F.regexp_extract(key, r"^(.*)_([^_]*)$", 2).alias("condition"))


def city_state(value: Column) -> Column:
    """'City_State' as 'City, State'; an unknown state is left off."""
    city, state = F.split_part(value, F.lit("_"), F.lit(1)), F.split_part(value, F.lit("_"), F.lit(2))
    return F.when(~F.contains(value, F.lit("_")), value).when(F.lower(state) == "unknown", city).otherwise(F.concat(city, F.lit(", "), state))


def correct_country(country: Column) -> Column:
    out = country
    names = F.create_map(*[F.lit(x) for pair in COUNTRY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, out), out)


def country_codes(rows: DataFrame, table: DataFrame, country: str = "country") -> DataFrame:
    """iso3 and iso2 by exact name, Kosovo apart; unknown names say so."""
    codes = table.select(F.col("country").alias("_c"), F.col("cca3").alias("_3"), F.col("cca2").alias("_2")).dropDuplicates(["_c"])
    code = lambda c, kosovo: F.when(F.col(country) == "Kosovo", kosovo).otherwise(F.coalesce(c, F.lit("Country not found")))
    return rows.join(F.broadcast(codes), F.col(country) == F.col("_c"), "left").withColumns({"iso3": code("_3", "XKX"), "iso2": code("_2", "XK")}).drop("_c", "_3", "_2")


def iso3_or_existing(code: Column, existing: Column) -> Column:
    """The found code, else the existing one unless it is empty."""
    return F.coalesce(code, F.nullif(existing, F.lit("")))


def continent_or_unknown(continent: Column) -> Column:
    return F.coalesce(continent, F.lit("Unknown"))


def flag(iso2: Column) -> Column:
    """Two regional indicator symbols; null gives Kosovo's."""
    code = F.upper(F.coalesce(iso2, F.lit("XK")))
    sign = lambda i: F.concat(F.lit("F09F87"), F.hex(F.ascii(F.substring(code, i, 1)) - 65 + 0xA6))
    return F.decode(F.unhex(F.concat(sign(1), sign(2))), "UTF-8")


def title_case(text: Column) -> Column:
    """A capital after anything that isn't a letter."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), "")


def prettify(name: Column) -> Column:
    """Underscores to spaces, first letter a capital, the rest small."""
    text = F.replace(name, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1_000_000)))


def normalise(text: Column) -> Column:
    return F.lower(F.trim(text))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\w-]+)"), 1)


def video_of_path(path: Column) -> Column:
    """File name without folder and extension; an error under five characters."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.when(F.length(name) >= 5, name).otherwise(F.raise_error(F.concat(F.lit("no video id in "), path)))


def compact_date(date: Column) -> Column:
    return F.date_format(date, "ddMMyyyy")


def is_monday(date: Column) -> Column:
    return F.weekday(date) == 0


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(high, F.greatest(low, value))


def round_rate(fps: Column) -> Column:
    """Half to even, as Python rounds."""
    return F.bround(fps, 0)


def segment_file(video: Column, start: Column) -> Column:
    return F.concat(video, F.lit("_"), start.cast("string"), F.lit(".csv"))


def two_decimals(value: Column) -> Column:
    """Two decimals, ties to even."""
    return F.format_string("%.2f", F.bround(value, 2))


def frame_number(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)", 1).cast("int")


def safe_average(*columns: str) -> Column:
    """Mean of what is there, 0 if nothing is."""
    return F.coalesce(row_mean(*columns), F.lit(0.0))


def row_mean(*columns: str) -> Column:
    """Mean of the columns that are neither null nor NaN; null if there is none."""
    there = F.filter(F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there))


def adjust_annotations(annotations: list[dict], near: float = 0.2, step: float = 0.01) -> list[dict]:
    """Raises each label by a step for every earlier (raised) one near its own first place."""
    placed: list[dict] = []
    for a in annotations:
        raised = sum(abs(a["x"] - b["x"]) < near and abs(a["y"] - b["y"]) < near for b in placed)
        y = a["y"]
        for _ in range(raised):
            y += step
        placed.append({**a, "y": y})
    return placed


def legend_positions(items: list[str], x: float, y: float, spacing: float) -> list[tuple[str, float, float]]:
    """Legend entries one below another."""
    return [(item, x, y - k * spacing) for k, item in enumerate(items)]
