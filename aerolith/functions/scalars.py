"""Small Column builders: time, keys, distances, station codes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EARTH_KM = 6371
HOUR = 3600
DAY = 86400


def hour_floor(epoch: Column) -> Column:
    return epoch - F.pmod(epoch, F.lit(HOUR))


def iso_utc(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def aqi_day(epoch: Column) -> Column:
    """Date of the 01:00 to 00:00 day that an hour belongs to."""
    return F.to_date(F.timestamp_seconds(epoch - HOUR))


def row_key(station: Column, epoch: Column) -> Column:
    """Key under which a station's latest hour sorts first."""
    return F.concat_ws("#", station, (F.lit(9999999999) - epoch).cast("string"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _folds() -> tuple[str, str]:
    """Latin letters with marks and what is left without them, by Unicode's own rule."""
    pairs = {"đ": "d", "Đ": "D"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code) and base.isascii():
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


_MARKED, _PLAIN = _folds()


def ascii_fold(text: Column) -> Column:
    """Latin text without diacritics; combining marks that stand alone go."""
    return F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"\p{Mn}", "")


def station_code(city: Column, country: Column) -> Column:
    """Country and three letters of the city, filled up with X."""
    letters = F.upper(F.regexp_replace(ascii_fold(city), "[^A-Za-z]", ""))
    return F.concat_ws("_", country, F.rpad(F.substring(letters, 1, 3), 3, "X"))


def station_codes(cities: DataFrame, order: str = "city") -> DataFrame:
    """(city, country, ...) with station_id: country, three letters, running number."""
    out = cities.withColumn("__code", station_code(F.col("city"), F.col("country")))
    turn = F.row_number().over(Window.partitionBy("__code").orderBy(order))
    return out.withColumn("station_id", F.concat_ws("_", "__code", F.lpad(turn.cast("string"), 2, "0"))).drop("__code")


def is_junk_name(name: Column, words: tuple[str, ...]) -> Column:
    """Names that begin with one of the given words, whatever their case."""
    return name.rlike("(?iu)^(" + "|".join(words) + ")")


def windows(spark: SparkSession, start: str, end: str, days: int = 90) -> DataFrame:
    """window_start, window_end (exclusive), label of consecutive windows; the last is clipped."""
    if end <= start:
        raise ValueError("the end must come after the start")
    one = spark.range(1).select(F.to_date(F.lit(start)).alias("s"), F.to_date(F.lit(end)).alias("e"))
    begin = F.explode(F.sequence(F.col("s"), F.date_sub("e", 1), F.expr(f"INTERVAL {days} DAYS")))
    out = one.select(begin.alias("window_start"), "e")
    return out.select("window_start", F.least(F.date_add("window_start", days), F.col("e")).alias("window_end"), F.date_format("window_start", "yyyy-MM-dd").alias("label"))
