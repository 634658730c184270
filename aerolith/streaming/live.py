"""The live lane: the batch lane's expressions over a stream of raw records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import aqi, scalars
from ..operators import clean
from ..sources import readings

VALUE_SCHEMA = readings.RAW_SCHEMA
LOOK_BACK_HOURS = 11


def source(spark: SparkSession, path: str | None = None, kafka: str | None = None, topic: str = "air-quality-raw", files_per_batch: int = 100) -> DataFrame:
    """A stream of `value` lines: a folder of text files, or a Kafka topic where that
    connector is installed."""
    if kafka:
        return spark.readStream.format("kafka").option("kafka.bootstrap.servers", kafka).option("subscribe", topic).load().select(F.col("value").cast("string").alias("value"))
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat readings, and the lines that are no record (dead letters); neither ends the job."""
    j = lines.withColumn("r", F.from_json("value", VALUE_SCHEMA, {"mode": "PERMISSIVE"}))
    bad = F.col("r").isNull() | F.col("r.station_id").isNull() | F.col("r.ts_epoch").isNull()
    good = readings.flat(j.where(~bad).select("r.*"))
    return good, j.where(bad).select("value", F.lit("no record").alias("error"))


def cleaned(good: DataFrame, late: str = "3 hours") -> DataFrame:
    """Clipped readings without repeats, with a watermark on their hour."""
    out = good.withColumn("ts_utc", F.timestamp_seconds("ts_epoch")).withWatermark("ts_utc", late)
    return clean.clip(out.dropDuplicatesWithinWatermark(["station_id", "ts_epoch"]))


def hourly(good: DataFrame, late: str = "3 hours") -> DataFrame:
    """Means per station and tumbling hour of event time."""
    out = good.withColumn("ts_utc", F.timestamp_seconds("ts_epoch")).withWatermark("ts_utc", late)
    return out.groupBy("station_id", F.window("ts_utc", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.avg("pm2_5").alias("pm2_5")).select("station_id", F.unix_seconds("w.start").alias("ts_epoch"), "n", "pm2_5")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _redo(spark: SparkSession, store: str, name: str) -> None:
    """Puts the dates of a whole log into their table, however often, and drops the log."""
    log = f"{store}/_redo/{name}"
    if _exists(spark, f"{log}/_SUCCESS"):
        readings.write_layer(spark.read.parquet(log), f"{store}/{name}", ("dt",))
    _drop(spark, log)


def _replace(df: DataFrame, store: str, name: str) -> None:
    """The dates of `df`, which may be computed from the table itself, replace the table's.
    They are written to a log first: a job lost on the way leaves either the old table or a
    whole log, from which the next batch begins."""
    df.write.mode("overwrite").parquet(f"{store}/_redo/{name}")
    _redo(df.sparkSession, store, name)


def upsert(store: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: readings into a keyed table and the indices they change.

    The table is Parquet by date under `store`/readings. A batch replaces the dates it
    touches; a reading replaces an older one of its station and hour. Then the index is
    computed anew for the hours from the batch's first to eleven after its last, from the
    stored history and with the batch lane's Nowcast, into `store`/aqi. Repeating a batch
    gives the same tables, also after a job that was lost while it wrote. An empty batch
    changes nothing. One writer at a time."""

    def run(batch: DataFrame, batch_id: int) -> None:  # noqa: ARG001
        spark = batch.sparkSession
        for name in ("readings", "aqi"):
            _redo(spark, store, name)
        day = F.to_date(F.timestamp_seconds("ts_epoch"))
        batch = batch.withColumn("dt", day).drop("ts_utc")
        ends = batch.agg(F.min("ts_epoch").alias("lo"), F.max("ts_epoch").alias("hi")).first()
        if ends.lo is None:
            return
        table, hour = f"{store}/readings", 3600
        dates = [F.to_date(F.timestamp_seconds(F.lit(ends.lo))), F.to_date(F.timestamp_seconds(F.lit(ends.hi)))]
        merged = batch
        if _exists(spark, table):
            kept = spark.read.schema(batch.schema).parquet(table).where(F.col("dt").between(*dates)).join(batch.select("station_id", "ts_epoch"), ["station_id", "ts_epoch"], "left_anti")
            merged = batch.unionByName(kept)
        _replace(clean.dedup(merged), store, "readings")
        look = spark.read.schema(batch.schema).parquet(table).where((F.col("ts_epoch") >= ends.lo - 2 * LOOK_BACK_HOURS * hour) & (F.col("ts_epoch") <= ends.hi + LOOK_BACK_HOURS * hour))
        fresh = index(look).where(F.col("ts_epoch").between(ends.lo, ends.hi + LOOK_BACK_HOURS * hour))
        old = f"{store}/aqi"
        if _exists(spark, old):
            days = F.to_date(F.timestamp_seconds(F.lit(ends.hi + LOOK_BACK_HOURS * hour)))
            past = spark.read.schema(fresh.schema).parquet(old).where(F.col("dt").between(dates[0], days) & ~F.col("ts_epoch").between(ends.lo, ends.hi + LOOK_BACK_HOURS * hour))
            fresh = fresh.unionByName(past)
        _replace(fresh, store, "aqi")

    return run


def index(df: DataFrame) -> DataFrame:
    """Hourly index of clipped readings, whether their hours are gapless or not."""
    names = {p: f"nowcast_{p}" if p in ("pm2_5", "pm10") else p for p in ("pm2_5", "pm10", "o3", "no2", "so2", "co")}
    out = aqi.hour_aqi(aqi.add_nowcast(df, gapless=False), names)
    return out.select("station_id", "city", "country", "lat", "lon", "ts_epoch", *names, *(f"iaqi_{p}" for p in names), "aqi", "aqi_level", "aqi_label", "dominant_pollutant", scalars.row_key(F.col("station_id"), F.col("ts_epoch")).alias("row_key"), F.to_date(F.timestamp_seconds("ts_epoch")).alias("dt"))


def messages(df: DataFrame) -> DataFrame:
    """Raw records as keyed messages: the station is the key, so its hours keep their order."""
    return df.select(F.col("station_id").alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str | None = None):
    """Messages into a topic, where that connector is installed: a table at once, a stream as
    a query that goes on from `checkpoint`. Dead letters go to a topic of their own."""
    keyed = df if {"key", "value"} <= set(df.columns) else messages(df)
    options = {"kafka.bootstrap.servers": servers, "topic": topic}
    if not df.isStreaming:
        keyed.write.format("kafka").options(**options).save()
        return None
    if checkpoint is None:
        raise ValueError("a stream needs a folder for its offsets")
    return keyed.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()


def start(spark: SparkSession, path: str, store: str, every: str | None = None) -> list[StreamingQuery]:
    """The live job: indices into `store`, raw copies and dead letters beside them. `every`
    is a trigger interval; without it what is there is taken and the job ends."""
    lines = source(spark, path)
    good, bad = parsed(lines)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    main = cleaned(good).writeStream.foreachBatch(upsert(store)).option("checkpointLocation", f"{store}/_offsets/aqi").trigger(**trigger).start()
    raw = lines.writeStream.format("text").option("path", f"{store}/raw/ingest_mode=live").option("checkpointLocation", f"{store}/_offsets/raw").trigger(**trigger).start()
    dead = bad.writeStream.format("json").option("path", f"{store}/dead").option("checkpointLocation", f"{store}/_offsets/dead").trigger(**trigger).start()
    return [main, raw, dead]
