"""Collecting: provider responses to raw records, rejects, what is left to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources.readings import COMPONENTS, RESPONSE_SCHEMA

MODES = ("history", "live")


def items(responses: DataFrame, window: str = "window") -> DataFrame:
    """(station_id, window, body) as a row per item of the list, parsed; a body that is no
    JSON of this form gives one row without an item."""
    parsed = responses.withColumn("r", F.from_json("body", RESPONSE_SCHEMA))
    lists = parsed.select("station_id", F.col(window).alias("window"), "body", F.explode_outer(F.col("r.list")).alias("item"))
    return lists


def normalised(found: DataFrame, stations: DataFrame, mode: str = "history", fetched_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw records and rejects (station_id, window, error, raw_item) of parsed items, fetched
    now or at `fetched_at` (seconds). Nothing a provider sends ends the job: what can't be
    read is rejected, with the reason."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    known = F.broadcast(stations.select(F.col("station_id").alias("known"), "city", "country", "lat", "lon"))  # hundreds of stations
    j = found.join(known, F.col("station_id") == F.col("known"), "left")
    dt = F.col("item.dt").try_cast("bigint")
    index = F.col("item.main.aqi").try_cast("int")
    values = {c: F.try_element_at(F.col("item.components"), F.lit(c)) for c in COMPONENTS}
    wrong = F.lit(False)
    for v in values.values():
        wrong = wrong | (v.isNotNull() & v.try_cast("double").isNull())
    missing_field = F.lit(False)
    for c in ("city", "country", "lat", "lon"):
        missing_field = missing_field | F.col(c).isNull()
    error = F.coalesce(
        F.when(F.col("item").isNull(), "no item"),
        F.when(F.col("known").isNull(), "unknown station"),
        F.when(missing_field, "station without a field"),
        F.when(dt.isNull(), "no time"),
        F.when(index.isNull(), "no index"),
        F.when(F.col("item.components").isNull(), "no components"),
        F.when(wrong, "a component is no number"),
    )
    j = j.withColumn("error", error)
    ts = scalars.hour_floor(dt)
    good = j.where("error IS NULL").select(
        F.lit("1.0").alias("schema_version"),
        "station_id",
        "city",
        "country",
        F.round("lat", 4).alias("lat"),
        F.round("lon", 4).alias("lon"),
        scalars.iso_utc(ts).alias("ts_utc"),
        ts.alias("ts_epoch"),
        dt.alias("dt_raw"),
        F.lit("openweathermap").alias("source"),
        F.lit(mode).alias("ingest_mode"),
        scalars.iso_utc(F.unix_timestamp() if fetched_at is None else fetched_at).alias("fetched_at_utc"),
        index.alias("owm_aqi"),
        F.struct(*(v.try_cast("double").alias(c) for c, v in values.items())).alias("components"),
    )
    bad = j.where("error IS NOT NULL").select("station_id", "window", "error", F.coalesce(F.to_json("item"), F.col("body")).alias("raw_item"))
    return good, bad


def work_list(stations: DataFrame, windows: DataFrame) -> DataFrame:
    """Every station with every window: hundreds times dozens, by meaning a product."""
    return stations.crossJoin(F.broadcast(windows))


def remaining(work: DataFrame, ledger: DataFrame) -> DataFrame:
    """Work that the ledger (station_id, window_start, window_end) doesn't hold. The end is
    part of the key: a longer window is other work."""
    return work.join(ledger, ["station_id", "window_start", "window_end"], "left_anti")


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = "station_id string, window_start date, window_end date"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def record(done: DataFrame, path: str) -> None:
    done.select("station_id", "window_start", "window_end").distinct().write.mode("append").parquet(path)


def far_pairs(places: DataFrame, key: str, min_km: float, most: bool = False) -> DataFrame:
    """Pairs of places (key, lat, lon) at least `min_km` apart, or nearer with `most`. Each
    place lies in a latitude band of that height, so near pairs come from adjoining bands."""
    a = places.select(F.col(key).alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = places.select(F.col(key).alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    km = scalars.haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    if not most:
        return a.join(b, F.col("a") < F.col("b")).withColumn("km", km).where(F.col("km") >= min_km)
    height = min_km / 111.0
    a = a.withColumn("band", F.floor(F.col("lat_a") / height))
    b = b.withColumn("band", F.explode(F.array(*(F.floor(F.col("lat_b") / height) + i for i in (-1, 0, 1)))))
    return a.join(b, (a["band"] == b["band"]) & (F.col("a") < F.col("b"))).withColumn("km", km).where(F.col("km") < min_km).select("a", "b", "km")
