"""Features for forecasting: lags, calendar, targets, sequences, splits, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aqi
from ..functions.standards import POLLUTANTS

LAGS = (1, 3, 24)
HORIZON = 24
FEATURES = (*(f"aqi_lag_{k}h" for k in LAGS), *POLLUTANTS, "hour_of_day", "month", "lat", "lon")


def forecast_features(df: DataFrame, lags=LAGS, horizon: int = HORIZON) -> DataFrame:
    """Lags, the index `horizon` rows ahead and calendar columns; rows with a null among
    them go. Rows are hours: the input is a gapless grid with ts_epoch."""
    w = Window.partitionBy("station_id").orderBy("ts_epoch")
    ts = F.timestamp_seconds("ts_epoch")
    out = df.select(
        "station_id",
        "ts_epoch",
        F.date_trunc("month", ts).alias("chunk_month"),
        *(F.lag("aqi", k).over(w).alias(f"aqi_lag_{k}h") for k in lags),
        *POLLUTANTS,
        F.hour(ts).alias("hour_of_day"),
        F.month(ts).alias("month"),
        "lat",
        "lon",
        F.lead("aqi", horizon).over(w).alias(f"target_aqi_{horizon}h"),
    )
    return out.na.drop()


def chunks(df: DataFrame, column: str = "chunk_month") -> list:
    """The distinct chunks in order: as many as there are months, not rows."""
    return [r[0] for r in df.select(column).distinct().orderBy(column).collect()]


def time_split(df: DataFrame, column: str = "chunk_month", share: float = 0.2) -> tuple[list, list]:
    """Train and test chunks: the last max(1, floor(n * share)) are test."""
    found = chunks(df, column)
    if len(found) < 2:
        raise ValueError("a split needs two distinct chunks at least")
    n = max(1, int(len(found) * share))
    return found[:-n], found[-n:]


def in_chunks(df: DataFrame, chosen: list, column: str = "chunk_month") -> DataFrame:
    return df.where(F.col(column).isin(chosen))


def sequence_windows(df: DataFrame, length: int = 24, horizon: int = HORIZON) -> DataFrame:
    """seq_0 (oldest) to seq_{length-1} of the index and the target, by hour; rows with a
    null among them go."""
    w = Window.partitionBy("station_id").orderBy("ts_epoch")
    dense = aqi.dense_hours("ts_epoch", "aqi", length, w)
    out = df.select("station_id", "ts_epoch", F.date_trunc("month", F.timestamp_seconds("ts_epoch")).alias("chunk_month"), dense.alias("hours"), F.lead("aqi", horizon).over(w).alias(f"target_aqi_{horizon}h"))
    return out.select("station_id", "ts_epoch", "chunk_month", *(F.get("hours", F.lit(length - 1 - i)).alias(f"seq_{i}") for i in range(length)), f"target_aqi_{horizon}h").na.drop()


def scaled_sequences(df: DataFrame, length: int = 24, fit_on: DataFrame | None = None) -> DataFrame:
    """Sequences scaled by one mean and population deviation of all their values, or of those
    of `fit_on` (the train rows, when `df` is the test); targets stay as they are. Null
    without a deviation."""
    values = F.array(*(F.col(f"seq_{i}") for i in range(length)))
    fit = (df if fit_on is None else fit_on).select(F.explode(values).alias("v")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    scale = lambda c: F.try_divide(F.col(c) - F.col("mean"), F.nullif(F.col("sd"), F.lit(0.0)))
    return df.crossJoin(F.broadcast(fit)).select("station_id", "ts_epoch", *(scale(f"seq_{i}").alias(f"seq_{i}") for i in range(length)), *(c for c in df.columns if c.startswith("target_")))
