"""Air-quality indices as Column expressions; batch, streaming and SQL share them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from . import standards as S


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iaqi(concentration: Column | str, pollutant: str, standard: str = "VN_1459") -> Column:
    """Sub-index: linear within the first band that holds the value, 500 above the last;
    null for null, NaN and negative values. Slopes are constants of the plan."""
    c = _col(concentration)
    out = F.when(c.isNull() | F.isnan(c) | (c < 0), F.lit(None).cast("double"))
    for lo, hi, ilo, ihi in S.bands(pollutant, standard):
        out = out.when(c <= hi, F.lit((ihi - ilo) / (hi - lo)) * (c - lo) + ilo)
    return out.otherwise(S.TOP_INDEX)


def level(index: Column | str) -> Column:
    """Level 1 to 6 of an index as it is before rounding; null for null."""
    c = _col(index)
    out = F.when(c.isNull(), F.lit(None).cast("int"))
    for i, upper in enumerate(S.LEVEL_UPPER, 1):
        out = out.when(c <= upper, i)
    return out.otherwise(6).cast("int")


def label(lev: Column | str, standard: str = "VN_1459") -> Column:
    c, out = _col(lev), None
    for i, name in enumerate(S.load_standard(standard)[2], 1):
        out = F.when(c == i, name) if out is None else out.when(c == i, name)
    return out


def with_reduced(df: DataFrame, parts: Sequence[str], value: str = "aqi") -> DataFrame:
    """`df` with `value` (the largest of the sub-indices iaqi_{p}, rounded half to even),
    aqi_level, aqi_label, dominant_pollutant. `greatest` skips nulls; of equal ones the first
    of the fixed order is dominant. The largest is a column of its own, computed once."""
    out = df.withColumn("__top", F.greatest(*(F.col(f"iaqi_{p}") for p in parts)))
    top = F.col("__top")
    dominant = None
    for p in (x for x in S.DOMINANT_ORDER if x in parts):
        dominant = F.when(F.col(f"iaqi_{p}") == top, p) if dominant is None else dominant.when(F.col(f"iaqi_{p}") == top, p)
    out = out.withColumns({value: F.bround(top, 0), "aqi_level": level(top), "dominant_pollutant": dominant})
    return out.withColumn("aqi_label", label("aqi_level")).drop("__top")


def _only_vn(standard: str) -> None:
    if standard != "VN_1459":
        raise ValueError(f"hour and day indices are defined by VN_1459, not by {standard!r}")


def hour_aqi(df: DataFrame, columns: dict[str, str] | None = None, standard: str = "VN_1459") -> DataFrame:
    """`df` with iaqi_{p}, aqi, aqi_level, aqi_label, dominant_pollutant, standard. `columns`
    names the column of each pollutant (the particles' Nowcasts, the gases' hourly values)."""
    _only_vn(standard)
    names = columns or {p: p for p in S.POLLUTANTS}
    out = df.withColumns({f"iaqi_{p}": iaqi(names[p], "o3_1h" if p == "o3" else p) for p in S.POLLUTANTS})
    return with_reduced(out, S.POLLUTANTS).withColumn("standard", F.lit(standard))


def o3_day(max_1h: Column | str, max_8h: Column | str) -> Column:
    """Daily ozone sub-index: the larger of both; the 8-hour one counts up to 400 only."""
    eight = _col(max_8h)
    return F.greatest(iaqi(max_1h, "o3_1h"), F.when(eight <= 400, iaqi(eight, "o3_8h")))


def day_aqi(df: DataFrame, standard: str = "VN_1459") -> DataFrame:
    """Regulation index of a day from pm2_5, pm10 (24-hour means) and so2, no2, co, o3_1h,
    o3_8h (daily maxima)."""
    _only_vn(standard)
    parts = {p: iaqi(p, p) for p in ("pm2_5", "pm10", "so2", "no2", "co")} | {"o3": o3_day("o3_1h", "o3_8h")}
    return with_reduced(df.withColumns({f"iaqi_{p}": c for p, c in parts.items()}), tuple(parts), "aqi_day")


def provider_index(columns: dict[str, str] | None = None) -> Column:
    """The provider's 1 to 5: of each pollutant one more than the thresholds not above it."""
    names = columns or {p: p for p in S.POLLUTANTS}
    parts = [F.lit(1)]
    for p, limits in S.PROVIDER_THRESHOLDS.items():
        c = F.col(names[p])
        out = F.when(c.isNull() | (c < 0), 1)
        for i, t in enumerate(limits, 1):
            out = out.when(c < t, i)
        parts.append(out.otherwise(5))
    return F.greatest(*parts).cast("int")


def hourly(station: str = "station_id", ts: str = "ts_epoch", *more: str) -> WindowSpec:
    return Window.partitionBy(station, *more).orderBy(ts)


def _weighted(values: Sequence[Column], weight: Column) -> Column:
    """Sum of w**i * v_i over sum of w**i of present ones, by Horner's rule."""
    num = reduce(lambda acc, v: acc * weight + F.coalesce(v, F.lit(0.0)), reversed(values[:-1]), F.coalesce(values[-1], F.lit(0.0)))
    there = [F.when(v.isNotNull(), 1.0).otherwise(0.0) for v in values]
    den = reduce(lambda acc, v: acc * weight + v, reversed(there[:-1]), there[-1])
    return F.try_divide(num, den)


def nowcast_weight(values: Sequence[Column]) -> Column:
    """min/max of the values present, at least one half, also when all are zero."""
    return F.greatest(F.lit(0.5), F.coalesce(F.try_divide(F.least(*values), F.greatest(*values)), F.lit(0.5)))


def nowcast_of(values: Sequence[Column], weight: Column) -> Column:
    """Nowcast of c1 (now) to c12: null with fewer than two of the latest three."""
    recent = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values[1:3]), F.when(values[0].isNotNull(), 1).otherwise(0))
    return F.when(recent >= 2, _weighted(values, weight))


def _fenced(c: Column) -> Column:
    """`c`, which the optimizer leaves where it is. A filter on an index would otherwise be
    moved below it, with the formula written out at each mention: some 100,000 nodes."""
    return F.when(F.spark_partition_id() >= 0, c)


def add_nowcast(df: DataFrame, pollutants: Sequence[str] = ("pm2_5", "pm10"), gapless: bool = True, slice_hours: int | None = None) -> DataFrame:
    """`df` with nowcast_{p}. On an hourly grid the last twelve rows are the last twelve
    hours; otherwise each lag counts only if its hour is within them. All lags share one
    sort. `slice_hours` windows stations in slices with an eleven-hour halo, so that a few
    long stations still fill a cluster."""
    keys = ["station_id"]
    if slice_hours:
        df = sliced(df, slice_hours)
        keys.append("__slice")
    w = Window.partitionBy(*keys).orderBy("ts_epoch")
    lags = {}
    for p in pollutants:
        for i in range(1, 12):
            lags[f"__{p}_{i}"] = F.lag(p, i).over(w)
    if not gapless:
        for i in range(1, 12):
            lags[f"__ts_{i}"] = F.lag("ts_epoch", i).over(w)
    wide = df.withColumns(lags)
    # each step is a set of columns: what the next one uses more than once is computed once
    if not gapless:
        wide = wide.withColumns({f"__back_{i}": F.floor((F.col("ts_epoch") - F.col(f"__ts_{i}")) / 3600).cast("int") for i in range(1, 12)})
        hours = {}
        for p in pollutants:
            rows = [F.col(p), *(F.col(f"__{p}_{i}") for i in range(1, 12))]
            for h in range(1, 12):  # the value of hour h is that of the row h hours back
                hours[f"__{p}_{h}"] = F.coalesce(*(F.when(F.col(f"__back_{i}") == h, rows[i]) for i in range(1, h + 1)))
        wide = wide.withColumns(hours).drop(*(f"__back_{i}" for i in range(1, 12)))
    values = {p: [F.col(p), *(F.col(f"__{p}_{i}") for i in range(1, 12))] for p in pollutants}
    wide = wide.withColumns({f"__w_{p}": nowcast_weight(v) for p, v in values.items()})
    out = wide.withColumns({f"nowcast_{p}": _fenced(nowcast_of(v, F.col(f"__w_{p}"))) for p, v in values.items()}).drop(*lags, *(f"__w_{p}" for p in pollutants))
    return out.where(~F.col("__halo")).drop("__slice", "__halo") if slice_hours else out


def sliced(df: DataFrame, slice_hours: int, look_back_hours: int = 11) -> DataFrame:
    """Rows with __slice and __halo: the last hours of each slice are copied into the next."""
    size = slice_hours * 3600
    own = F.floor(F.col("ts_epoch") / size)
    late = F.pmod("ts_epoch", F.lit(size)) >= size - look_back_hours * 3600
    places = F.when(late, F.array(F.struct(own.alias("s"), F.lit(False).alias("h")), F.struct((own + 1).alias("s"), F.lit(True).alias("h")))).otherwise(F.array(F.struct(own.alias("s"), F.lit(False).alias("h"))))
    return df.withColumn("__at", F.explode(places)).withColumns({"__slice": F.col("__at.s"), "__halo": F.col("__at.h")}).drop("__at")


def dense_hours(ts: Column | str, value: Column | str, hours: int, w: WindowSpec) -> Column:
    """Array of the last `hours` values, newest first, by hour and not by row; later pairs
    win. `w` is ordered by the hour in seconds."""
    t, v = _col(ts), _col(value)
    pairs = F.collect_list(F.when(v.isNotNull(), F.struct(t.alias("t"), v.alias("v")))).over(w.rangeBetween(-(hours - 1) * 3600 - 3599, 0))
    by_hour = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.floor((t - x["t"]) / 3600).cast("int"), x["v"])))
    return F.transform(F.sequence(F.lit(0), F.lit(hours - 1)), lambda i: F.try_element_at(by_hour, i))


def register_functions(spark: SparkSession) -> None:
    """SQL functions iaqi(c, pollutant), aqi_level(index), provider_index(six values),
    nowcast(c1 to c12 as an array, the newest first) and aqi_udf(six values), the struct
    (aqi, aqi_level, aqi_label, dominant_pollutant) of an hour; null in each field without
    a value."""

    def sql_iaqi(p: str) -> str:
        steps = " ".join(f"WHEN c <= {hi!r}D THEN {(ihi - ilo) / (hi - lo)!r}D * (c - {lo!r}D) + {ilo!r}D" for lo, hi, ilo, ihi in S.bands(p))
        return f"CASE WHEN c IS NULL OR isnan(c) OR c < 0 THEN NULL {steps} ELSE {S.TOP_INDEX!r}D END"

    by_name = " ".join(f"WHEN '{p}' THEN {sql_iaqi(p)}" for p in S.VN_BREAKPOINTS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION iaqi(c DOUBLE, pollutant STRING) RETURNS DOUBLE RETURN CASE pollutant {by_name} END")
    levels = " ".join(f"WHEN a <= {u} THEN {i}" for i, u in enumerate(S.LEVEL_UPPER, 1))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION aqi_level(a DOUBLE) RETURNS INT RETURN CASE WHEN a IS NULL THEN NULL {levels} ELSE 6 END")
    names = list(S.PROVIDER_THRESHOLDS)
    parts = ", ".join("CASE WHEN {p} IS NULL OR {p} < 0 THEN 1 {w} ELSE 5 END".format(p=p, w=" ".join(f"WHEN {p} < {t} THEN {i}" for i, t in enumerate(limits, 1))) for p, limits in S.PROVIDER_THRESHOLDS.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION provider_index({', '.join(f'{p} DOUBLE' for p in names)}) RETURNS INT RETURN greatest(1, {parts})")
    weight = "greatest(0.5D, coalesce(try_divide(array_min(v), array_max(v)), 0.5D))"
    total = "aggregate(transform(v, (x, i) -> {x}), 0D, (a, b) -> a + b)"
    num, den = (total.format(x=x) for x in (f"coalesce(x * power({weight}, i), 0D)", f"IF(x IS NULL, 0D, power({weight}, i))"))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION nowcast(v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN size(filter(slice(v, 1, 3), x -> x IS NOT NULL)) >= 2 THEN try_divide({num}, {den}) END")
    subs = {p: f"iaqi({p}, '{'o3_1h' if p == 'o3' else p}')" for p in S.POLLUTANTS}
    top = f"greatest({', '.join(subs.values())})"
    label_of = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(S.VN_LABELS, 1))
    dominant = " ".join(f"WHEN {subs[p]} = {top} THEN '{p}'" for p in S.DOMINANT_ORDER)
    fields = f"'aqi', bround({top}, 0), 'aqi_level', aqi_level({top}), 'aqi_label', CASE aqi_level({top}) {label_of} END, 'dominant_pollutant', CASE {dominant} END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION aqi_udf({', '.join(f'{p} DOUBLE' for p in S.POLLUTANTS)}) RETURNS STRUCT<aqi: DOUBLE, aqi_level: INT, aqi_label: STRING, dominant_pollutant: STRING> RETURN named_struct({fields})")
