"""Cleaning: duplicates, plausibility, hourly grid, short gaps, days, reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.standards import POLLUTANTS, max_plausible

VALID_HOURS = 18


def dedup(df: DataFrame, keys: Iterable[str] = ("station_id", "ts_epoch")) -> DataFrame:
    """One row per key by a total order: history before live, then the latest dt_raw, then
    the values, so the choice never depends on the order of rows."""
    rest = [c for c in df.columns if c not in set(keys)]
    order = [F.col(c) for c in ("ingest_mode",) if c in rest] + [F.desc(c) for c in ("dt_raw",) if c in rest]
    order += [F.col(c) for c in rest if c not in ("ingest_mode", "dt_raw")]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def clip(df: DataFrame) -> DataFrame:
    """Negative values, those above the last breakpoint and NaN become null, each by itself."""
    caps = max_plausible()
    return df.withColumns({p: F.when((F.col(p) >= 0) & (F.col(p) <= caps[p]), F.col(p)) for p in POLLUTANTS if p in df.columns})


def hour_grid(df: DataFrame, step: int = 3600) -> DataFrame:
    """Every hour from a station's first to its last, with its metadata; hours without a
    reading have null values. Metadata are those of the earliest hour."""
    meta = [c for c in ("city", "country", "lat", "lon") if c in df.columns]
    values = [c for c in df.columns if c not in ("station_id", "ts_epoch", *meta)]
    ends = df.groupBy("station_id").agg(F.min("ts_epoch").alias("lo"), F.max("ts_epoch").alias("hi"), *(F.min_by(c, F.struct("ts_epoch", c)).alias(c) for c in meta))
    hours = ends.select("station_id", *meta, F.explode(F.sequence("lo", "hi", F.lit(step))).alias("ts_epoch"))
    return hours.join(df.select("station_id", "ts_epoch", *values), ["station_id", "ts_epoch"], "left")


def interpolate(df: DataFrame, pollutants: Iterable[str] = POLLUTANTS, max_neighbor_gap_hours: int = 3) -> DataFrame:
    """Nulls between two values at most that far apart are filled along a line; {p}_qc says
    measured, interpolated or missing. One sort serves every pollutant; the frames reach no
    farther than a neighbour may be, so a row costs the same in a history of any length.
    Where an hour is there twice, a null takes its twin's value."""
    w = Window.partitionBy("station_id").orderBy("ts_epoch")
    reach = max_neighbor_gap_hours * 3600
    back, ahead = w.rangeBetween(-reach, 0), w.rangeBetween(0, reach)
    names = [p for p in pollutants if p in df.columns]
    known = {p: F.when(F.col(p).isNotNull(), F.struct(F.col("ts_epoch").alias("t"), F.col(p).alias("v"))) for p in names}
    near = df.withColumns({f"__b_{p}": F.last_value(known[p], True).over(back) for p in names} | {f"__a_{p}": F.first_value(known[p], True).over(ahead) for p in names})
    made: dict[str, Column] = {}
    for p in names:
        b, a = F.col(f"__b_{p}"), F.col(f"__a_{p}")
        span = a["t"] - b["t"]
        line = b["v"] + F.coalesce(F.try_divide((a["v"] - b["v"]) * (F.col("ts_epoch") - b["t"]), span), F.lit(0.0))
        short = F.col(p).isNull() & (span <= reach)
        made[f"{p}_qc"] = F.when(F.col(p).isNotNull(), "measured").when(short, "interpolated").otherwise("missing")
        made[p] = F.when(short, line).otherwise(F.col(p))
    return near.withColumns(made).drop(*(f"__{s}_{p}" for s in "ab" for p in names))


def day_aggregates(df: DataFrame, valid_hours: int = VALID_HOURS) -> DataFrame:
    """`df` with ts_utc, dt, aqi_day, the day's particle means and whether enough hours have
    a particle value. A window by day keeps the hours; there is no join back."""
    out = df.withColumns({"ts_utc": F.timestamp_seconds("ts_epoch"), "dt": F.to_date(F.timestamp_seconds("ts_epoch")), "aqi_day": scalars.aqi_day(F.col("ts_epoch"))})
    w = Window.partitionBy("station_id", "aqi_day")
    enough = F.sum(F.when(F.col("pm2_5").isNotNull() | F.col("pm10").isNotNull(), 1).otherwise(0)).over(w) >= valid_hours
    return out.withColumns({"pm2_5_day_avg": F.avg("pm2_5").over(w), "pm10_day_avg": F.avg("pm10").over(w), "day_qc_flag": F.when(enough, "valid").otherwise("insufficient_data")})


def day_completeness(df: DataFrame, valid_hours: int = VALID_HOURS) -> DataFrame:
    """A row per station and day: means, hours with a particle value, flag."""
    d = df.withColumn("aqi_day", scalars.aqi_day(F.col("ts_epoch")))
    hours = F.count_if(F.col("pm2_5").isNotNull() | F.col("pm10").isNotNull())
    return d.groupBy("station_id", "aqi_day").agg(F.avg("pm2_5").alias("pm2_5_day_avg"), F.avg("pm10").alias("pm10_day_avg"), hours.alias("valid_hours"), F.when(hours >= valid_hours, "valid").otherwise("insufficient_data").alias("day_qc_flag"))


def quality_report(df: DataFrame, pollutants: Iterable[str] = POLLUTANTS) -> DataFrame:
    """pollutant, n_rows, n_missing, n_interpolated and their percentages, in one pass."""
    names = [p for p in pollutants if f"{p}_qc" in df.columns]
    counts = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"{p}_qc") == k).alias(f"{p}_{k}") for p in names for k in ("missing", "interpolated")))
    rows = F.explode(F.array(*(F.struct(F.lit(p).alias("pollutant"), F.col(f"{p}_missing").alias("m"), F.col(f"{p}_interpolated").alias("i")) for p in names)))
    percent = lambda c: F.round(F.try_divide(F.col(c) * 100.0, F.col("n")), 2)
    return counts.select("n", rows.alias("r")).select("n", "r.*").select("pollutant", F.col("n").alias("n_rows"), F.col("m").alias("n_missing"), percent("m").alias("pct_missing"), F.col("i").alias("n_interpolated"), percent("i").alias("pct_interpolated"))


def valid_day_ratio(df: DataFrame) -> DataFrame:
    """n_days and n_valid over distinct station days."""
    day = F.struct("station_id", "aqi_day")
    return df.agg(F.count_distinct(day).alias("n_days"), F.count_distinct(F.when(F.col("day_qc_flag") == "valid", day)).alias("n_valid"))


def gap_scan(df: DataFrame, step: int = 3600) -> DataFrame:
    """Gaps between consecutive distinct hours: station, before, after, missing hours."""
    hours = df.select("station_id", "ts_epoch").distinct()
    before = F.lag("ts_epoch").over(Window.partitionBy("station_id").orderBy("ts_epoch"))
    return hours.withColumn("gap_from", before).where(F.col("ts_epoch") - F.col("gap_from") > step).select("station_id", "gap_from", F.col("ts_epoch").alias("gap_to"), ((F.col("ts_epoch") - F.col("gap_from")) / step - 1).cast("long").alias("missing_hours"))


def contiguity(df: DataFrame, step: int = 3600) -> DataFrame:
    """Per station: rows, distinct hours, duplicates, expected hours, completeness."""
    out = df.groupBy("station_id").agg(F.count("*").alias("n_rows"), F.count_distinct("ts_epoch").alias("n_hours"), ((F.max("ts_epoch") - F.min("ts_epoch")) / step + 1).cast("long").alias("expected"))
    return out.withColumns({"n_duplicates": F.col("n_rows") - F.col("n_hours"), "completeness": F.round(F.try_divide(F.col("n_hours") * 100.0, "expected"), 2)})


def schema_checks(df: DataFrame) -> DataFrame:
    """(name, passed, detail): hours aligned, provider index in 1..5, no key null, numbers only."""
    checks = {
        "hours_aligned": F.pmod("ts_epoch", F.lit(3600)) == 0,
        "provider_index_range": F.col("owm_aqi").between(1, 5),
        "station_known": F.col("station_id").isNotNull(),
        "no_nan": ~F.coalesce(sum((F.isnan(p).cast("int") for p in POLLUTANTS), F.lit(0)) > 0, F.lit(False)),
    }
    bad = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("bad")) for n in checks)))
    return bad.select(rows.alias("r")).select("r.name", (F.col("r.bad") == 0).alias("passed"), F.concat(F.col("r.bad").cast("string"), F.lit(" rows")).alias("detail"))
