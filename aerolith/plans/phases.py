"""The batch lane: clean, index, aggregate; in one plan or layer by layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aqi
from ..functions.standards import POLLUTANTS
from ..operators import aggregate, clean
from ..sources import readings

PARTICLES = ("pm2_5", "pm10")
NAMES = {p: f"nowcast_{p}" if p in PARTICLES else p for p in POLLUTANTS}


def cleaned(flat: DataFrame, max_neighbor_gap_hours: int = 3) -> DataFrame:
    """Flat readings to the clean layer."""
    grid = clean.hour_grid(clean.clip(clean.dedup(flat)))
    return clean.day_aggregates(clean.interpolate(grid, max_neighbor_gap_hours=max_neighbor_gap_hours))


def indexed(clean_layer: DataFrame, standard: str = "VN_1459") -> DataFrame:
    """The clean layer to hourly indices."""
    return aqi.hour_aqi(aqi.add_nowcast(clean_layer), NAMES, standard)


def facts(indexed_layer: DataFrame) -> DataFrame:
    """The index layer's columns as they are stored."""
    return indexed_layer.select("station_id", "city", "country", "lat", "lon", "ts_utc", *POLLUTANTS, *(f"iaqi_{p}" for p in POLLUTANTS), "aqi", "aqi_level", "aqi_label", "dominant_pollutant", "standard", "dt")


def run_clean(spark: SparkSession, source: str, target: str) -> None:
    readings.write_layer(cleaned(readings.flat(readings.read_raw(spark, source))), target)


def run_index(spark: SparkSession, source: str, target: str, comparison: str | None = None) -> None:
    out = indexed(readings.read_layer(spark, source))
    readings.write_layer(facts(out), target)
    if comparison:
        readings.write_csv(aggregate.by_provider_index(out), comparison)


def run_aggregate(spark: SparkSession, source: str, daily: str, ranking: str) -> None:
    day = aggregate.daily(readings.read_layer(spark, source))
    readings.write_layer(day, daily)
    # the written days, not a second pass over the hours
    readings.write_layer(aggregate.ranking(readings.read_layer(spark, daily)), ranking, ("dt",))


def city_days(flat: DataFrame) -> DataFrame:
    """Hourly readings to ranked city days in one plan: three exchanges, by station, by city
    and date, by date."""
    hours = indexed(cleaned(flat)).withColumn("dt", F.to_date("ts_utc"))
    return aggregate.ranking(aggregate.daily(hours))
