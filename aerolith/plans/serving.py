"""What the serving layer asks: each endpoint's query over the index table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"))


def stations(facts: DataFrame, country: str | None = None) -> DataFrame:
    own = facts if country is None else facts.where(F.col("country") == country)
    return own.select("station_id", "city", "country", "lat", "lon").distinct()


def latest(facts: DataFrame, country: str | None = None, limit: int | None = None) -> DataFrame:
    """The latest row of each station, by one aggregation."""
    own = facts if country is None else facts.where(F.col("country") == country)
    rest = [c for c in own.columns if c not in ("station_id", "ts_epoch")]
    out = own.groupBy("station_id").agg(F.max("ts_epoch").alias("ts_epoch"), F.max_by(F.struct(*rest), "ts_epoch").alias("r")).select("station_id", "ts_epoch", "r.*")
    return out.orderBy("station_id").limit(limit) if limit else out


def timeseries(facts: DataFrame, station: str, start: int, end: int) -> DataFrame:
    """One station's rows from `start` to `end` (epochs), in order; the dates prune partitions."""
    own = facts.where((F.col("station_id") == station) & F.col("ts_epoch").between(start, end))
    if "dt" in facts.columns:
        own = own.where(F.col("dt").between(F.to_date(F.timestamp_seconds(F.lit(start))), F.to_date(F.timestamp_seconds(F.lit(end)))))
    return own.orderBy("ts_epoch")


def ranking(ranked: DataFrame, dt, country: str | None = None) -> DataFrame:
    """A date's ranking; ranks count within the country if one is asked for."""
    own = ranked.where(F.col("dt") == F.lit(dt))
    if country is None:
        return own.orderBy("rank")
    own = own.where(F.col("country") == country)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("dt").orderBy("rank"))).orderBy("rank")
