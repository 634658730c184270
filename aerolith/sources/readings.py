"""Readings and stations: scans, sinks, the provider source, synthetic data."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import aqi, scalars
from ..functions.standards import POLLUTANTS, PROVIDER_THRESHOLDS

COMPONENTS = ("co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3")
RAW_SCHEMA = "schema_version string, station_id string, city string, country string, lat double, lon double, ts_utc string, ts_epoch bigint, dt_raw bigint, source string, ingest_mode string, fetched_at_utc string, owm_aqi int, components struct<" + ", ".join(f"{c}: double" for c in COMPONENTS) + ">"
STATION_SCHEMA = "station_id string, city string, country string, lat double, lon double"
RESPONSE_SCHEMA = "coord struct<lon: double, lat: double>, list array<struct<main: struct<aqi: string>, components: map<string, string>, dt: string>>"


def flat(raw: DataFrame, accepted_versions: tuple[str, ...] | None = None) -> DataFrame:
    """Nested raw records as one row of scalars each, hours floored; other schema versions
    go only if `accepted_versions` says which stay."""
    out = raw if accepted_versions is None else raw.where(F.col("schema_version").isin(*accepted_versions))
    keep = ["station_id", "city", "country", "lat", "lon", scalars.hour_floor(F.col("ts_epoch")).alias("ts_epoch"), "dt_raw", "ingest_mode", "owm_aqi"]
    return out.select(*keep, *(F.col(f"components.{p}").alias(p) for p in POLLUTANTS))


def read_raw(spark: SparkSession, path: str, corrupt: str | None = None) -> DataFrame:
    """JSON lines, gzip and partition folders included; `corrupt` names a column for lines
    that are no such record."""
    schema = RAW_SCHEMA + (f", {corrupt} string" if corrupt else "")
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE")
    if not _has_partitions(spark, path):
        reader = reader.option("recursiveFileLookup", "true")
    return (reader.option("columnNameOfCorruptRecord", corrupt) if corrupt else reader).json(path)


def _has_partitions(spark: SparkSession, path: str) -> bool:
    """Whether folders in `path` name partitions, whose values are no part of the lines."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at) and any(s.isDirectory() and "=" in s.getPath().getName() for s in fs.listStatus(at))


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_layer(df: DataFrame, path: str, partitions: tuple[str, ...] = ("country", "dt"), rows_per_file: int = 5_000_000) -> None:
    """Parquet by partition; only partitions that `df` holds are replaced. Rows are dealt by
    the partition columns, so a task writes few files, and long partitions are cut."""
    writer = (df.repartition(*partitions) if partitions else df).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    if partitions:
        writer = writer.partitionBy(*partitions).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_raw(df: DataFrame, path: str) -> None:
    """Raw JSON lines appended by ingest_mode, country, dt. Nothing that is there is taken
    away: a station's reading of a time that is there already is left out, so a window that
    is fetched again leaves no second copy, and other stations of its partition stay. Reads
    only the days that `df` holds; one writer at a time."""
    spark = df.sparkSession
    out = df.withColumn("dt", F.to_date(F.timestamp_seconds("ts_epoch")))
    if _has_partitions(spark, path):
        key = ["ingest_mode", "country", "dt", "station_id", "dt_raw"]
        days = out.agg(F.min("dt").alias("lo"), F.max("dt").alias("hi")).first()
        old = read_raw(spark, path).withColumn("dt", F.col("dt").cast("date")).where(F.col("dt").between(days.lo, days.hi))
        out = out.join(old.select(*key), key, "left_anti")
    partitions = ("ingest_mode", "country", "dt")
    out.repartition(*partitions).write.mode("append").partitionBy(*partitions).option("compression", "gzip").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_single_csv(df: DataFrame, path: str) -> None:
    """One CSV file, for small results: written by one task, then named through Hadoop's
    file system, whatever it is."""
    spark = df.sparkSession
    temp = path + ".parts"
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(temp)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(temp)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
    fs.delete(jvm.org.apache.hadoop.fs.Path(path), False)
    fs.rename(part, jvm.org.apache.hadoop.fs.Path(path))
    fs.delete(at, True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Dead letters: station_id, window, error, raw_item, one JSON line each."""
    rejects.select("station_id", "window", "error", "raw_item").write.mode("append").json(path)


def load_stations(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    raw = spark.read.option("multiLine", True).schema(f"stations array<struct<{', '.join(f'{n}: {t}' for n, t in (p.split() for p in STATION_SCHEMA.split(', ')))}>>").json(path)
    out = raw.select(F.inline("stations"))
    return out.orderBy("station_id").limit(limit) if limit else out


def load_cities(spark: SparkSession, path: str) -> DataFrame:
    """The provider's city list, a JSON array, gzip included."""
    schema = "id long, name string, state string, country string, coord struct<lat: double, lon: double>"
    return spark.read.option("multiLine", True).schema(schema).json(path).select("id", "name", "country", "coord.lat", "coord.lon")


def synthetic(spark: SparkSession, rows: int, stations: int = 200, seed: int = 42) -> DataFrame:
    """The bench frame: uniform pollutants over `stations`, hourly from a fixed epoch."""
    tops = {"pm2_5": 150, "pm10": 200, "o3": 150, "no2": 150, "so2": 100, "co": 3000}
    base = spark.range(rows)
    return base.select(
        F.concat(F.lit("ST_"), F.lpad((F.col("id") % stations).cast("string"), 3, "0")).alias("station_id"),
        (F.lit(1_700_000_000) + F.floor(F.col("id") / stations) * 3600).cast("long").alias("ts_epoch"),
        *(F.round(F.rand(seed + i) * top, 2).alias(p) for i, (p, top) in enumerate(tops.items())),
    )


# Fixed values of the sample's calibration: particles by local hour (mean 1), ozone likewise.
PM_BY_HOUR = (1.2179, 1.1909, 1.1729, 1.1971, 1.2236, 1.2345, 1.2045, 1.1358, 0.9359, 0.9029, 0.9145, 0.6738, 0.6441, 0.6879, 0.7391, 0.7773, 0.7712, 0.7953, 0.8937, 0.9829, 1.0845, 1.1727, 1.2206, 1.2263)
O3_BY_HOUR = (0.7601, 0.7545, 0.7524, 0.7435, 0.7422, 0.7465, 0.7501, 0.7783, 0.8878, 0.9824, 1.1257, 1.3244, 1.3802, 1.4168, 1.4283, 1.4011, 1.3529, 1.2568, 1.1059, 0.9834, 0.9012, 0.8418, 0.8050, 0.7787)
# Gases: median and deviation of the logarithm, least value.
GASES = {"no2": (3.68, 0.862, 0.5), "so2": (0.94, 0.635, 0.3), "co": (223.0, 0.741, 80.0)}
# Stations: id, city, country, lat, lon, hours east of UTC, pollution against the first.
SAMPLE_STATIONS = (
    ("VN_HCM_01", "Ho Chi Minh City", "VN", 10.8231, 106.6297, 7, 1.0),
    ("VN_HAN_01", "Hanoi", "VN", 21.0278, 105.8342, 7, 2.6),
    ("VN_BDU_01", "Thu Dau Mot", "VN", 10.9804, 106.6519, 7, 0.9),
    ("IN_DEL_01", "New Delhi", "IN", 28.6139, 77.2090, 5, 7.0),
    ("JP_TYO_01", "Tokyo", "JP", 35.6762, 139.6503, 9, 1.2),
)


def provider_index_of(values: dict[str, float | None]) -> int:
    """The provider's 1 to 5 of one record: thresholds not above the worst pollutant, plus one."""
    known = [sum(v >= t for t in limits) + 1 for p, limits in PROVIDER_THRESHOLDS.items() if (v := values.get(p)) is not None and v >= 0]
    return max(known, default=1)


def sample_records(seed: int = 7, hours: int = 2160, start: int = 1_781_481_600) -> Iterator[dict]:
    """Raw records of five stations, log-normal with hour-to-hour memory and a daily course,
    and with the faults that cleaning must meet: whole-day gaps from 01:00 on, doubled hours
    at a month's begin, nulls and negative values."""
    import numpy as np

    rng = np.random.default_rng(seed)
    mu, sd, memory = 1.838, 0.806, 0.964  # fixed values: log of PM2.5 and its autocorrelation
    for sid, city, country, lat, lon, east, factor in SAMPLE_STATIONS:
        times = start + 3600 * np.arange(hours)
        utc, local = times // 3600 % 24, (times // 3600 + east) % 24
        noise = rng.normal(0, sd * np.sqrt(1 - memory**2), hours)
        level = np.empty(hours)
        state = mean = mu + np.log(factor)
        for h in range(hours):
            state = level[h] = mean + memory * (state - mean) + noise[h]
        pm_course, o3_course = np.take(PM_BY_HOUR, local), np.take(O3_BY_HOUR, local)
        share = {"no2": factor, "so2": factor, "co": 0.6 + 0.4 * factor}
        values = {g: np.exp(rng.normal(np.log(median * share[g]), spread, hours)) * (pm_course if g == "co" else 1) for g, (median, spread, _) in GASES.items()}
        values = {g: np.maximum(GASES[g][2], v) for g, v in values.items()}
        values["pm2_5"] = np.exp(level) * pm_course
        values["pm10"] = values["pm2_5"] * rng.normal(1.41, 0.1, hours)
        values["o3"] = np.maximum(0, rng.normal(32.12, 7, hours) * o3_course)
        values["no"] = np.where(rng.random(hours) > 0.24, np.abs(rng.normal(0.2, 0.3, hours)), 0)
        values["nh3"] = np.abs(rng.normal(2.0, 0.7, hours))
        gone = np.zeros(hours, bool)
        for h in np.flatnonzero((utc == 1) & (rng.random(hours) < 0.055)):
            if not gone[h]:
                gone[h : h + 24 * int(rng.choice((1, 1, 1, 2)))] = True
        for h in np.flatnonzero(~gone):
            found: dict[str, float | None] = {c: round(float(values[c][h]), 2) for c in COMPONENTS}
            if rng.random() < 0.002:
                found[str(rng.choice(("pm10", "so2", "o3")))] = None
            if rng.random() < 0.0005:
                found["no2"] = round(-abs(float(rng.normal(3, 2))), 2)
            ts = int(times[h])
            at = time.gmtime(ts)
            row = {"schema_version": "1.0", "station_id": sid, "city": city, "country": country, "lat": lat, "lon": lon, "ts_utc": time.strftime("%Y-%m-%dT%H:%M:%SZ", at), "ts_epoch": ts, "dt_raw": ts, "source": "synthetic", "ingest_mode": "history", "fetched_at_utc": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(start + 3600 * hours)), "owm_aqi": provider_index_of(found), "components": found}
            yield row
            if at.tm_mday == 1 and at.tm_hour == 0:
                yield row | {"ingest_mode": "live", "dt_raw": ts + 420}


def sample(spark: SparkSession, **kw) -> DataFrame:
    return spark.createDataFrame((json.loads(json.dumps(r)) for r in sample_records(**kw)), T._parse_datatype_string(RAW_SCHEMA))


class AuthError(RuntimeError):
    """The provider refuses the key; trying again is no use."""


def fetch(transport: Callable[[dict], tuple[int, dict]], request: dict, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One call: 401 ends the job, 429 and 5xx are tried again after 2, 4, ... 60 seconds."""
    for attempt in range(tries):
        status, body = transport(request)
        if status == 200:
            return body
        if status == 401:
            raise AuthError("the key is refused")
        if status != 429 and status < 500:
            raise RuntimeError(f"status {status}")
        if attempt + 1 < tries:
            sleep(min(60, 2 ** (attempt + 1)))
    raise RuntimeError(f"status {status} after {tries} tries")


def current_request(station_id: str, lat: float, lon: float) -> dict:
    """What the provider knows now: a request without times."""
    return {"station_id": station_id, "lat": lat, "lon": lon}


def history_requests(work: DataFrame) -> list[dict]:
    """A request for each station and window (station_id, lat, lon, window_start, window_end)
    of the work left, in seconds: hundreds of stations times dozens of windows."""
    seconds = {f"{n}": F.unix_timestamp(F.col(f"window_{n}").cast("timestamp")).alias(n) for n in ("start", "end")}
    rows = work.select("station_id", "lat", "lon", seconds["start"], seconds["end"]).orderBy("station_id", "start").collect()
    return [current_request(r.station_id, r.lat, r.lon) | {"start": r.start, "end": r.end} for r in rows]


class HttpTransport:
    """GET calls to `base`, or to `base`/history for a request with times. The key is read
    from the environment where the call is made, so that no plan or log holds it."""

    def __init__(self, base: str, key_variable: str, timeout: float = 30):
        self.base, self.key_variable, self.timeout = base.rstrip("/"), key_variable, timeout

    def url(self, request: dict) -> str:
        params = {k: request[k] for k in ("lat", "lon", "start", "end") if k in request}
        params["appid"] = os.environ[self.key_variable]
        return f"{self.base}{'/history' if 'start' in request else ''}?{urllib.parse.urlencode(params)}"

    def __call__(self, request: dict) -> tuple[int, dict]:
        try:
            with urllib.request.urlopen(self.url(request), timeout=self.timeout) as answer:  # noqa: S310  the base is the caller's
                return answer.status, json.load(answer)
        except urllib.error.HTTPError as e:
            return e.code, {}


class ProviderSource(DataSource):
    """`spark.read.format("air_provider")`: a call per station and window. Options: requests
    (JSON list of {station_id, lat, lon, start, end}), calls_per_second. The transport is a
    picklable function, like an `HttpTransport`, put in `ProviderSource.transport`; there is
    none by default."""

    transport: Callable[[dict], tuple[int, dict]] | None = None

    @classmethod
    def name(cls) -> str:
        return "air_provider"

    def schema(self) -> str:
        return "station_id string, window string, body string"

    def reader(self, schema):  # noqa: ARG002
        return _ProviderReader(json.loads(self.options.get("requests", "[]")), float(self.options.get("calls_per_second", "1")), type(self).transport)


class _ProviderReader(DataSourceReader):
    def __init__(self, requests: list[dict], rate: float, transport):
        self.requests, self.rate, self.transport = requests, rate, transport

    def partitions(self):
        return [InputPartition(0)]  # one caller: the rate holds for all of the job

    def read(self, partition):  # noqa: ARG002
        if self.transport is None:
            raise RuntimeError("set ProviderSource.transport to what makes the calls")
        last = 0.0
        for request in self.requests:
            time.sleep(max(0.0, last + 1 / self.rate - time.monotonic()))
            last = time.monotonic()
            yield request["station_id"], request.get("start", ""), json.dumps(fetch(self.transport, request))


def from_events(spark: SparkSession, folder: str) -> DataFrame:
    """Raw-shaped hourly readings made from the `events` and `nation` tables: four stations in
    three cities; each kind of event gives a pollutant, in exact cents divided once."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    nation = spark.read.parquet(f"{folder}/nation.parquet").select("n_nationkey", F.col("n_name").alias("city"), "n_regionkey")
    region = spark.read.parquet(f"{folder}/region.parquet").select("r_regionkey", F.col("r_name").alias("country"))
    place = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # at most 25 nations
    e = e.select(
        (F.col("user_id") % 4).alias("st"),
        scalars.hour_floor(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("ts_epoch"),
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )

    def mean(kind: str | None) -> Column:
        own = F.col("cents") if kind is None else F.when(F.col("event_type") == kind, F.col("cents"))
        return F.try_divide(F.sum(own).cast("double"), F.count(own) * 100)

    hourly = e.groupBy("st", "ts_epoch").agg(
        mean("click").alias("pm2_5"),
        (mean("view") * 1.5).alias("pm10"),
        (mean("purchase") * 2).alias("o3"),
        (mean("signup") * 5).alias("no2"),
        ((mean("error") - 2) * 5).alias("so2"),
        (mean(None) * 200).alias("co"),
    )
    out = hourly.join(F.broadcast(place), F.col("n_nationkey") == (F.col("st") % 3) * 7)
    return out.select(
        F.concat(F.lit("ST_0"), F.col("st").cast("string")).alias("station_id"),
        "city",
        "country",
        (10.0 + F.col("st")).alias("lat"),
        (100.0 + F.col("st") * 1.5).alias("lon"),
        "ts_epoch",
        aqi.provider_index().alias("owm_aqi"),
        *POLLUTANTS,
    )
