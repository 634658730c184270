"""Registered queries over the driver's tables, and what a SQL engine must answer to them.

The oracle statements are written by hand from the regulation's tables, apart from the
Column builders, so that one's mistake is not the other's.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aqi, scalars
from ..functions.standards import POLLUTANTS
from ..operators import aggregate, clean, cluster, collect, features, forecast, select_stations
from ..sources import readings
from . import phases, serving

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return readings.from_events(spark, d)


def _doubled(spark: SparkSession, d: str) -> DataFrame:
    """The readings with a live copy of every fifth hour, which arrived later."""
    r = _readings(spark, d).withColumns({"ingest_mode": F.lit("history"), "dt_raw": F.col("ts_epoch")})
    live = r.where((F.col("ts_epoch") / 3600).cast("long") % 5 == 0).withColumns({"ingest_mode": F.lit("live"), "dt_raw": F.col("ts_epoch") + 420, "pm2_5": F.col("pm2_5") + 1})
    return r.unionByName(live)


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return clean.hour_grid(clean.clip(_readings(spark, d)))


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return clean.day_aggregates(clean.interpolate(_grid(spark, d)))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return phases.indexed(_clean(spark, d))


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- the oracles' common parts ------------------------------------------------------------

CAPS = {"pm2_5": 500, "pm10": 600, "o3": 1200, "no2": 3850, "so2": 2630, "co": 150000}
_R = """
ev AS (SELECT user_id % 4 AS st, (epoch_us(ts) // 3600000000) * 3600 AS ts_epoch, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
hr AS (SELECT st, ts_epoch,
  sum(cents) FILTER (event_type = 'click')::DOUBLE / nullif(count(*) FILTER (event_type = 'click') * 100, 0) AS pm2_5,
  sum(cents) FILTER (event_type = 'view')::DOUBLE / nullif(count(*) FILTER (event_type = 'view') * 100, 0) * 1.5::DOUBLE AS pm10,
  sum(cents) FILTER (event_type = 'purchase')::DOUBLE / nullif(count(*) FILTER (event_type = 'purchase') * 100, 0) * 2 AS o3,
  sum(cents) FILTER (event_type = 'signup')::DOUBLE / nullif(count(*) FILTER (event_type = 'signup') * 100, 0) * 5 AS no2,
  (sum(cents) FILTER (event_type = 'error')::DOUBLE / nullif(count(*) FILTER (event_type = 'error') * 100, 0) - 2) * 5 AS so2,
  sum(cents)::DOUBLE / (count(*) * 100) * 200 AS co FROM ev GROUP BY st, ts_epoch),
r0 AS (SELECT 'ST_0' || st AS station_id, n_name AS city, r_name AS country, 10.0::DOUBLE + st AS lat, 100.0::DOUBLE + st * 1.5::DOUBLE AS lon, ts_epoch, pm2_5, pm10, o3, no2, so2, co
  FROM hr JOIN nation ON n_nationkey = (st % 3) * 7 JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT *, greatest(1,
  CASE WHEN pm2_5 IS NULL OR pm2_5 < 0 THEN 1 WHEN pm2_5 < 10 THEN 1 WHEN pm2_5 < 25 THEN 2 WHEN pm2_5 < 50 THEN 3 WHEN pm2_5 < 75 THEN 4 ELSE 5 END,
  CASE WHEN pm10 IS NULL OR pm10 < 0 THEN 1 WHEN pm10 < 20 THEN 1 WHEN pm10 < 50 THEN 2 WHEN pm10 < 100 THEN 3 WHEN pm10 < 200 THEN 4 ELSE 5 END,
  CASE WHEN no2 IS NULL OR no2 < 0 THEN 1 WHEN no2 < 40 THEN 1 WHEN no2 < 70 THEN 2 WHEN no2 < 150 THEN 3 WHEN no2 < 200 THEN 4 ELSE 5 END,
  CASE WHEN o3 IS NULL OR o3 < 0 THEN 1 WHEN o3 < 60 THEN 1 WHEN o3 < 100 THEN 2 WHEN o3 < 140 THEN 3 WHEN o3 < 180 THEN 4 ELSE 5 END,
  CASE WHEN so2 IS NULL OR so2 < 0 THEN 1 WHEN so2 < 20 THEN 1 WHEN so2 < 80 THEN 2 WHEN so2 < 250 THEN 3 WHEN so2 < 350 THEN 4 ELSE 5 END,
  CASE WHEN co IS NULL OR co < 0 THEN 1 WHEN co < 4400 THEN 1 WHEN co < 9400 THEN 2 WHEN co < 12400 THEN 3 WHEN co < 15400 THEN 4 ELSE 5 END)::INTEGER AS owm_aqi FROM r0)"""
_C = _R + ",\nc AS (SELECT station_id, city, country, lat, lon, ts_epoch, owm_aqi, " + ", ".join(f"CASE WHEN {p} BETWEEN 0 AND {cap} THEN {p} END AS {p}" for p, cap in CAPS.items()) + " FROM r)"
_G = _C + """,
m AS (SELECT station_id, min(ts_epoch) AS lo, max(ts_epoch) AS hi, arg_min(city, ts_epoch) AS city, arg_min(country, ts_epoch) AS country, arg_min(lat, ts_epoch) AS lat, arg_min(lon, ts_epoch) AS lon FROM c GROUP BY station_id),
g AS (SELECT m.station_id, m.city, m.country, m.lat, m.lon, u.t AS ts_epoch, owm_aqi, """ + ", ".join(CAPS) + """
  FROM m CROSS JOIN LATERAL unnest(range(m.lo, m.hi + 1, 3600)) AS u(t) LEFT JOIN c ON c.station_id = m.station_id AND c.ts_epoch = u.t)"""
_I = (
    _G
    + ",\nn AS (SELECT *, "
    + ", ".join(f"last_value({p} IGNORE NULLS) OVER b AS pv_{p}, last_value(CASE WHEN {p} IS NOT NULL THEN ts_epoch END IGNORE NULLS) OVER b AS pt_{p}, first_value({p} IGNORE NULLS) OVER a AS nv_{p}, first_value(CASE WHEN {p} IS NOT NULL THEN ts_epoch END IGNORE NULLS) OVER a AS nt_{p}" for p in CAPS)
    + " FROM g WINDOW b AS (PARTITION BY station_id ORDER BY ts_epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY station_id ORDER BY ts_epoch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),\n"
    + "i AS (SELECT station_id, city, country, lat, lon, ts_epoch, owm_aqi, make_timestamp(ts_epoch * 1000000) AS ts_utc, make_timestamp(ts_epoch * 1000000)::DATE AS dt, make_timestamp((ts_epoch - 3600) * 1000000)::DATE AS aqi_day, "
    + ", ".join(f"CASE WHEN {p} IS NULL AND nt_{p} - pt_{p} <= 10800 THEN pv_{p} + (nv_{p} - pv_{p}) * (ts_epoch - pt_{p}) / nullif(nt_{p} - pt_{p}, 0) ELSE {p} END AS {p}, CASE WHEN {p} IS NOT NULL THEN 'measured' WHEN nt_{p} - pt_{p} <= 10800 THEN 'interpolated' ELSE 'missing' END AS {p}_qc" for p in CAPS)
    + " FROM n)"
)
def _nowcast_cte(p: str) -> str:
    return f"""w_{p} AS (SELECT station_id, h0, k, v, greatest(0.5::DOUBLE, coalesce(min(v) OVER q / nullif(max(v) OVER q, 0), 0.5::DOUBLE)) AS w FROM
  (SELECT i.station_id, i.ts_epoch AS h0, (i.ts_epoch - j.ts_epoch) // 3600 AS k, j.{p} AS v FROM i JOIN i j ON j.station_id = i.station_id AND j.ts_epoch BETWEEN i.ts_epoch - 39600 AND i.ts_epoch AND j.{p} IS NOT NULL)
  WINDOW q AS (PARTITION BY station_id, h0)),
nc_{p} AS (SELECT station_id, h0 AS ts_epoch, CASE WHEN count(*) FILTER (k <= 2) >= 2 THEN sum(v * pow(w, k)) / sum(pow(w, k)) END AS nowcast_{p} FROM w_{p} GROUP BY station_id, h0)"""


_N = _I + ",\n" + _nowcast_cte("pm2_5") + ",\n" + _nowcast_cte("pm10") + ",\nx AS (SELECT i.*, nowcast_pm2_5, nowcast_pm10 FROM i LEFT JOIN nc_pm2_5 USING (station_id, ts_epoch) LEFT JOIN nc_pm10 USING (station_id, ts_epoch))"
_BP = {
    "pm2_5": [0, 25, 50, 80, 150, 250, 350, 500],
    "pm10": [0, 50, 150, 250, 350, 420, 500, 600],
    "so2": [0, 125, 350, 550, 800, 1600, 2100, 2630],
    "no2": [0, 100, 200, 700, 1200, 2350, 3100, 3850],
    "co": [0, 10000, 30000, 45000, 60000, 90000, 120000, 150000],
    "o3_1h": [0, 160, 200, 300, 400, 800, 1000, 1200],
    "o3_8h": [0, 100, 120, 170, 210, 400],
}
_EDGE = [0, 50, 100, 150, 200, 300, 400, 500]


def _sub(c: str, kind: str) -> str:
    bp = _BP[kind]
    arms = " ".join(f"WHEN {c} <= {bp[k + 1]} THEN ({_EDGE[k + 1]} - {_EDGE[k]})::DOUBLE / ({bp[k + 1]} - {bp[k]}) * ({c} - {bp[k]}) + {_EDGE[k]}" for k in range(len(bp) - 1))
    return f"(CASE WHEN {c} IS NULL OR {c} < 0 THEN NULL {arms} ELSE 500.0::DOUBLE END)"


_LEVEL = "CASE WHEN {a} IS NULL THEN NULL WHEN {a} <= 50 THEN 1 WHEN {a} <= 100 THEN 2 WHEN {a} <= 150 THEN 3 WHEN {a} <= 200 THEN 4 WHEN {a} <= 300 THEN 5 ELSE 6 END"
_LABELS = "['Tốt', 'Trung bình', 'Kém', 'Xấu', 'Rất xấu', 'Nguy hại']"
_DOMINANT = "CASE WHEN mx IS NULL THEN NULL " + " ".join(f"WHEN iaqi_{p} = mx THEN '{p}'" for p in ("pm2_5", "pm10", "so2", "no2", "co", "o3")) + " END"
_F = (
    _N
    + f""",
s AS (SELECT x.*, {_sub("nowcast_pm2_5", "pm2_5")} AS iaqi_pm2_5, {_sub("nowcast_pm10", "pm10")} AS iaqi_pm10, {_sub("o3", "o3_1h")} AS iaqi_o3, {_sub("no2", "no2")} AS iaqi_no2, {_sub("so2", "so2")} AS iaqi_so2, {_sub("co", "co")} AS iaqi_co FROM x),
t AS (SELECT *, greatest(iaqi_pm2_5, iaqi_pm10, iaqi_o3, iaqi_no2, iaqi_so2, iaqi_co) AS mx FROM s),
f AS (SELECT *, round_even(mx, 0) AS aqi, {_LEVEL.format(a="mx")} AS aqi_level, {_LABELS}[{_LEVEL.format(a="mx")}] AS aqi_label, {_DOMINANT} AS dominant_pollutant FROM t)"""
)
_D = _F + """,
mc AS (SELECT city, country, dt, dominant_pollutant, count(*) AS c FROM f WHERE dominant_pollutant IS NOT NULL GROUP BY ALL),
md AS (SELECT *, row_number() OVER (PARTITION BY city, country, dt ORDER BY c DESC, dominant_pollutant) AS k FROM mc),
d AS (SELECT f.city, f.country, f.dt, round(avg(aqi), 1) AS avg_aqi, max(aqi) AS max_aqi, min(aqi) AS min_aqi, count(aqi) AS n_hours, """ + ", ".join(f"count(*) FILTER (aqi_level = {k}) AS count_level_{k}" for k in range(1, 7)) + """ FROM f GROUP BY ALL),
dw AS (SELECT d.*, md.dominant_pollutant AS worst_pollutant FROM d LEFT JOIN md ON d.city = md.city AND d.country = md.country AND d.dt = md.dt AND md.k = 1),
rk AS (SELECT row_number() OVER (PARTITION BY dt ORDER BY avg_aqi DESC NULLS LAST, city, country)::INTEGER AS rank, city, country, dt, avg_aqi, max_aqi, worst_pollutant FROM dw)"""
_P = ", ".join(CAPS)


def _sql(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


# --- scans and cleaning -------------------------------------------------------------------


@query(_sql(_R, "SELECT * FROM r"))
def readings_hourly(spark, d):
    return _readings(spark, d)


@query(_sql(_C, f"SELECT station_id, ts_epoch, {_P} FROM c"))
def clip_outliers(spark, d):
    return clean.clip(_readings(spark, d)).select("station_id", "ts_epoch", *CAPS)


@query(_sql(_R, """, b AS (SELECT *, 'history' AS ingest_mode, ts_epoch AS dt_raw FROM r UNION ALL BY NAME SELECT * REPLACE (pm2_5 + 1 AS pm2_5), 'live' AS ingest_mode, ts_epoch + 420 AS dt_raw FROM r WHERE (ts_epoch // 3600) % 5 = 0)
SELECT station_id, ts_epoch, ingest_mode, dt_raw, round(pm2_5, 6) AS pm2_5 FROM b QUALIFY row_number() OVER (PARTITION BY station_id, ts_epoch ORDER BY ingest_mode, dt_raw DESC) = 1"""))
def dedup_latest(spark, d):
    return _rounded(clean.dedup(_doubled(spark, d)).select("station_id", "ts_epoch", "ingest_mode", "dt_raw", "pm2_5"), "pm2_5")


@query(_sql(_R, """, b AS (SELECT station_id, ts_epoch FROM r UNION ALL SELECT station_id, ts_epoch FROM r WHERE (ts_epoch // 3600) % 5 = 0)
SELECT station_id, ts_epoch, count(*) AS n FROM b GROUP BY ALL HAVING count(*) > 1"""))
def duplicate_keys(spark, d):
    return aggregate.duplicates(_doubled(spark, d), "station_id", "ts_epoch")


@query(_sql(_G, f"SELECT station_id, city, country, lat, lon, ts_epoch, {_P} FROM g"))
def hour_grid(spark, d):
    return _grid(spark, d).select("station_id", "city", "country", "lat", "lon", "ts_epoch", *CAPS)


@query(_sql(_I, "SELECT station_id, ts_epoch, " + ", ".join(f"round({p}, 6) AS {p}, {p}_qc" for p in CAPS) + " FROM i"))
def interpolate_gaps(spark, d):
    return _rounded(clean.interpolate(_grid(spark, d)).select("station_id", "ts_epoch", *CAPS, *(f"{p}_qc" for p in CAPS)), *CAPS)


@query(_sql(_I, " UNION ALL ".join(f"SELECT '{p}' AS pollutant, count(*) AS n_rows, count(*) FILTER ({p}_qc = 'missing') AS n_missing, round(count(*) FILTER ({p}_qc = 'missing') * 100.0::DOUBLE / count(*), 2) AS pct_missing, count(*) FILTER ({p}_qc = 'interpolated') AS n_interpolated, round(count(*) FILTER ({p}_qc = 'interpolated') * 100.0::DOUBLE / count(*), 2) AS pct_interpolated FROM i" for p in CAPS)))
def quality_report(spark, d):
    return clean.quality_report(clean.interpolate(_grid(spark, d)))


@query(_sql(_I, "SELECT pm2_5_qc, count(*) AS n FROM i GROUP BY pm2_5_qc"))
def qc_hist(spark, d):
    return aggregate.level_counts(clean.interpolate(_grid(spark, d)), "pm2_5_qc")


@query(_sql(_R, """, l AS (SELECT station_id, ts_epoch, lag(ts_epoch) OVER (PARTITION BY station_id ORDER BY ts_epoch) AS gap_from FROM r)
SELECT station_id, gap_from, ts_epoch AS gap_to, ((ts_epoch - gap_from) // 3600 - 1)::BIGINT AS missing_hours FROM l WHERE ts_epoch - gap_from > 3600"""))
def gap_scan(spark, d):
    return clean.gap_scan(_readings(spark, d))


@query(_sql(_R, """, b AS (SELECT station_id, ts_epoch FROM r UNION ALL SELECT station_id, ts_epoch FROM r WHERE (ts_epoch // 3600) % 5 = 0)
SELECT station_id, count(*) AS n_rows, count(DISTINCT ts_epoch) AS n_hours, ((max(ts_epoch) - min(ts_epoch)) // 3600 + 1)::BIGINT AS expected, count(*) - count(DISTINCT ts_epoch) AS n_duplicates,
round(count(DISTINCT ts_epoch) * 100.0::DOUBLE / ((max(ts_epoch) - min(ts_epoch)) // 3600 + 1), 2) AS completeness FROM b GROUP BY station_id"""))
def contiguity(spark, d):
    return clean.contiguity(_doubled(spark, d))


@query(_sql(_R, """, b AS (SELECT ts_epoch + CASE WHEN (ts_epoch // 3600) % 5 = 0 THEN 60 ELSE 0 END AS ts_epoch, CASE WHEN (ts_epoch // 3600) % 7 = 0 THEN 6 ELSE owm_aqi END AS owm_aqi, CASE WHEN (ts_epoch // 3600) % 11 <> 0 THEN station_id END AS station_id, (ts_epoch // 3600) % 13 = 0 AS nan FROM r),
k AS (SELECT 'hours_aligned' AS name, count(*) FILTER (ts_epoch % 3600 <> 0) AS n FROM b UNION ALL SELECT 'provider_index_range', count(*) FILTER (owm_aqi NOT BETWEEN 1 AND 5) FROM b
UNION ALL SELECT 'station_known', count(*) FILTER (station_id IS NULL) FROM b UNION ALL SELECT 'no_nan', count(*) FILTER (nan) FROM b)
SELECT name, n = 0 AS passed, n || ' rows' AS detail FROM k"""))
def schema_checks(spark, d):
    """Over readings some of which break each rule."""
    hour = F.floor(F.col("ts_epoch") / 3600)
    broken = {
        "station_id": F.when(hour % 11 != 0, F.col("station_id")),
        "owm_aqi": F.when(hour % 7 == 0, 6).otherwise(F.col("owm_aqi")),
        "pm2_5": F.when(hour % 13 == 0, float("nan")).otherwise(F.col("pm2_5")),
        "ts_epoch": F.col("ts_epoch") + F.when(hour % 5 == 0, 60).otherwise(0),
    }
    return clean.schema_checks(_readings(spark, d).withColumns(broken))


@query(_sql(_I, """SELECT station_id, aqi_day, round(avg(pm2_5), 6) AS pm2_5_day_avg, round(avg(pm10), 6) AS pm10_day_avg, count(*) FILTER (pm2_5 IS NOT NULL OR pm10 IS NOT NULL) AS valid_hours,
CASE WHEN count(*) FILTER (pm2_5 IS NOT NULL OR pm10 IS NOT NULL) >= 18 THEN 'valid' ELSE 'insufficient_data' END AS day_qc_flag FROM i GROUP BY ALL"""))
def day_completeness(spark, d):
    return _rounded(clean.day_completeness(clean.interpolate(_grid(spark, d))), "pm2_5_day_avg", "pm10_day_avg")


@query(_sql(_I, """, q AS (SELECT station_id, aqi_day, count(*) FILTER (pm2_5 IS NOT NULL OR pm10 IS NOT NULL) >= 18 AS ok FROM i GROUP BY ALL) SELECT count(*) AS n_days, count(*) FILTER (ok) AS n_valid FROM q"""))
def valid_day_ratio(spark, d):
    return clean.valid_day_ratio(_clean(spark, d))


@query(_sql(_I, """SELECT station_id, ts_epoch, ts_utc, dt, aqi_day, pm2_5_qc, pm10_qc, o3_qc, no2_qc, so2_qc, co_qc, round(avg(pm2_5) OVER w + 1e-9, 6) AS pm2_5_day_avg, round(avg(pm10) OVER w + 1e-9, 6) AS pm10_day_avg, CASE WHEN count(*) FILTER (pm2_5 IS NOT NULL OR pm10 IS NOT NULL) OVER w >= 18 THEN 'valid' ELSE 'insufficient_data' END AS day_qc_flag
FROM i WINDOW w AS (PARTITION BY station_id, aqi_day)""".replace("ts_utc,", "ts_utc::TIMESTAMPTZ AS ts_utc,").replace("ts_utc::TIMESTAMPTZ AS ts_utc,", "strftime(ts_utc, '%Y-%m-%dT%H:%M:%SZ') AS ts_utc,")))
def clean_layer(spark, d):
    out = _clean(spark, d).select("station_id", "ts_epoch", scalars.iso_utc(F.col("ts_epoch")).alias("ts_utc"), "dt", "aqi_day", *(f"{p}_qc" for p in POLLUTANTS), "pm2_5_day_avg", "pm10_day_avg", "day_qc_flag")
    # means of 24 values may end in half a unit, which the order of addition would decide
    return _rounded(out.withColumns({c: F.col(c) + 1e-9 for c in ("pm2_5_day_avg", "pm10_day_avg")}), "pm2_5_day_avg", "pm10_day_avg")


# --- indices ------------------------------------------------------------------------------


@query(_sql(_N, "SELECT station_id, ts_epoch, round(nowcast_pm2_5, 6) AS nowcast_pm2_5, round(nowcast_pm10, 6) AS nowcast_pm10 FROM x"))
def nowcast_pm25(spark, d):
    out = aqi.add_nowcast(clean.interpolate(_grid(spark, d))).select("station_id", "ts_epoch", "nowcast_pm2_5", "nowcast_pm10")
    return _rounded(out, "nowcast_pm2_5", "nowcast_pm10")


@query(ORACLES["nowcast_pm25"])
def nowcast_sliced(spark, d):
    out = aqi.add_nowcast(clean.interpolate(_grid(spark, d)), slice_hours=72).select("station_id", "ts_epoch", "nowcast_pm2_5", "nowcast_pm10")
    return _rounded(out, "nowcast_pm2_5", "nowcast_pm10")


@query(_sql(_N, "SELECT x.station_id, x.ts_epoch, round(nowcast_pm2_5, 6) AS nowcast_pm2_5, round(nowcast_pm10, 6) AS nowcast_pm10 FROM x JOIN c ON c.station_id = x.station_id AND c.ts_epoch = x.ts_epoch".replace("x JOIN c", "x JOIN c")).replace("FROM i JOIN i j", "FROM c i JOIN c j").replace("i.*, nowcast_pm2_5, nowcast_pm10 FROM i", "i.*, nowcast_pm2_5, nowcast_pm10 FROM c i"))
def nowcast_ungridded(spark, d):
    out = aqi.add_nowcast(clean.clip(_readings(spark, d)), gapless=False).select("station_id", "ts_epoch", "nowcast_pm2_5", "nowcast_pm10")
    return _rounded(out, "nowcast_pm2_5", "nowcast_pm10")


@query(_sql(_F, "SELECT station_id, ts_epoch, " + ", ".join(f"round(iaqi_{p}, 6) AS iaqi_{p}" for p in CAPS) + " FROM f"))
def iaqi_hour(spark, d):
    return _rounded(_facts(spark, d).select("station_id", "ts_epoch", *(f"iaqi_{p}" for p in CAPS)), *(f"iaqi_{p}" for p in CAPS))


@query(_sql(_F, "SELECT station_id, city, country, ts_epoch, dt, aqi, aqi_level, aqi_label, dominant_pollutant, 'VN_1459' AS standard FROM f"))
def aqi_hour(spark, d):
    return _facts(spark, d).select("station_id", "city", "country", "ts_epoch", "dt", "aqi", "aqi_level", "aqi_label", "dominant_pollutant", "standard")


@query(_sql(_F, "SELECT sum(aqi) AS sum_aqi, count(aqi) AS n_aqi FROM f"))
def aqi_checksum(spark, d):
    return aggregate.checksum(_facts(spark, d))


@query(_sql(_C, f"SELECT station_id, ts_epoch, {_sub('pm2_5', 'pm2_5')} AS sub, {_LEVEL.format(a=_sub('pm2_5', 'pm2_5'))} AS lev, owm_aqi AS provider FROM c".replace("AS sub", "AS sub").replace(_sub("pm2_5", "pm2_5") + " AS sub", f"round({_sub('pm2_5', 'pm2_5')}, 6) AS sub")))
def sql_functions(spark, d):
    aqi.register_functions(spark)
    r = clean.clip(_readings(spark, d))
    raw = _readings(spark, d).select("station_id", "ts_epoch", F.expr("provider_index(pm2_5, pm10, no2, o3, so2, co)").alias("provider"))
    return r.select("station_id", "ts_epoch", F.expr("round(iaqi(pm2_5, 'pm2_5'), 6)").alias("sub"), F.expr("aqi_level(iaqi(pm2_5, 'pm2_5'))").alias("lev")).join(raw, ["station_id", "ts_epoch"])


@query(_sql(_F, "SELECT aqi_level, count(*) AS n FROM f GROUP BY aqi_level"))
def level_hist(spark, d):
    return aggregate.level_counts(_facts(spark, d))


@query(_sql(_I, "SELECT station_id, ts_epoch, round(avg(o3) OVER (PARTITION BY station_id ORDER BY ts_epoch RANGE BETWEEN 25200 PRECEDING AND CURRENT ROW), 6) AS o3_8h FROM i"))
def o3_8h_max(spark, d):
    return _rounded(aggregate.o3_8h(clean.interpolate(_grid(spark, d))).select("station_id", "ts_epoch", "o3_8h"), "o3_8h")


@query(_sql(_I, f""", o AS (SELECT *, avg(o3) OVER (PARTITION BY station_id ORDER BY ts_epoch RANGE BETWEEN 25200 PRECEDING AND CURRENT ROW) AS o8 FROM i),
a AS (SELECT station_id, aqi_day, avg(pm2_5) AS pm2_5, avg(pm10) AS pm10, max(so2) AS so2, max(no2) AS no2, max(co) AS co, max(o3) AS o1, max(o8) AS o8 FROM o GROUP BY ALL HAVING count(*) FILTER (pm2_5 IS NOT NULL OR pm10 IS NOT NULL) >= 18),
b AS (SELECT station_id, aqi_day, {_sub("pm2_5", "pm2_5")} AS iaqi_pm2_5, {_sub("pm10", "pm10")} AS iaqi_pm10, {_sub("so2", "so2")} AS iaqi_so2, {_sub("no2", "no2")} AS iaqi_no2, {_sub("co", "co")} AS iaqi_co, greatest({_sub("o1", "o3_1h")}, CASE WHEN o8 <= 400 THEN {_sub("o8", "o3_8h")} END) AS iaqi_o3 FROM a),
e AS (SELECT *, greatest(iaqi_pm2_5, iaqi_pm10, iaqi_so2, iaqi_no2, iaqi_co, iaqi_o3) AS mx FROM b)
SELECT station_id, aqi_day, round_even(mx, 0) AS aqi_day_value, {_LEVEL.format(a="mx")} AS aqi_level, {_DOMINANT} AS dominant_pollutant, round(iaqi_o3, 6) AS iaqi_o3 FROM e"""))
def aqi_day(spark, d):
    # the operator names the index aqi_day, like the date: the date is renamed before
    days = clean.interpolate(_grid(spark, d))
    out = aggregate.regulation_days(days, as_value="aqi_day_value")
    return _rounded(out.select("station_id", "aqi_day", "aqi_day_value", "aqi_level", "dominant_pollutant", "iaqi_o3"), "iaqi_o3")


# --- aggregates and ranks -----------------------------------------------------------------


@query(_sql(_D, "SELECT * FROM dw"))
def daily_city(spark, d):
    return aggregate.daily(_facts(spark, d))


@query(_sql(_D, "SELECT city, country, dt, dominant_pollutant AS worst_pollutant FROM md WHERE k = 1"))
def worst_pollutant(spark, d):
    return aggregate.worst_pollutant(_facts(spark, d))


@query(_sql(_D, """, p AS (SELECT * REPLACE (n_hours + CASE WHEN day(dt) % 3 = 0 THEN 1 ELSE 0 END AS n_hours) FROM dw)
SELECT * FROM p WHERE count_level_1 + count_level_2 + count_level_3 + count_level_4 + count_level_5 + count_level_6 <> n_hours"""))
def level_invariant(spark, d):
    """Over days of which every third has an hour too many."""
    days = aggregate.daily(_facts(spark, d))
    return aggregate.level_mismatch(days.withColumn("n_hours", F.col("n_hours") + F.when(F.day("dt") % 3 == 0, 1).otherwise(0)))


@query(_sql(_D, "SELECT * FROM rk"))
def city_ranking(spark, d):
    return phases.city_days(_readings(spark, d))


@query(_sql(_D, "SELECT * FROM rk WHERE dt = (SELECT max(dt) FROM rk) ORDER BY rank LIMIT 5"))
def top5_latest(spark, d):
    return aggregate.top_of_latest(phases.city_days(_readings(spark, d)))


@query(_sql(_D, "SELECT *, row_number() OVER (PARTITION BY dt, country ORDER BY rank)::INTEGER AS country_rank FROM rk"))
def rank_by_country(spark, d):
    return aggregate.rank_in_country(phases.city_days(_readings(spark, d)))


@query(_sql(_D, "SELECT row_number() OVER (ORDER BY rank)::INTEGER AS rank, city, country, dt, avg_aqi, max_aqi, worst_pollutant FROM rk WHERE dt = DATE '2024-01-10' AND country = 'AFRICA'"))
def serve_ranking(spark, d):
    import datetime

    return serving.ranking(phases.city_days(_readings(spark, d)), datetime.date(2024, 1, 10), "AFRICA")


@query(_sql(_R, "SELECT station_id, ts_epoch, owm_aqi FROM r"))
def owm_index(spark, d):
    return _readings(spark, d).select("station_id", "ts_epoch", aqi.provider_index().alias("owm_aqi"))


@query(_sql(_F, "SELECT owm_aqi, count(*) AS n, round(avg(aqi), 1) AS avg_aqi, round(min(aqi), 1) AS min_aqi, round(max(aqi), 1) AS max_aqi FROM f WHERE owm_aqi IS NOT NULL AND aqi IS NOT NULL GROUP BY owm_aqi"))
def owm_by_index(spark, d):
    return aggregate.by_provider_index(_facts(spark, d))


@query(_sql(_F, """, q AS (SELECT aqi_level, owm_aqi, count(*) AS c FROM f WHERE owm_aqi IS NOT NULL AND aqi IS NOT NULL GROUP BY ALL)
SELECT aqi_level, sum(c)::BIGINT AS n, arg_min(owm_aqi, struct_pack(a := -c, b := owm_aqi)) AS mode_owm_aqi FROM q GROUP BY aqi_level"""))
def level_vs_owm_mode(spark, d):
    return aggregate.level_by_provider(_facts(spark, d))


@query(_sql(_F, "SELECT country, city, dt, count(aqi) AS n_hours, round(avg(aqi), 4) AS avg_aqi, grouping(country, city, dt)::BIGINT AS depth FROM f GROUP BY ROLLUP (country, city, dt)"))
def rollup_country_city(spark, d):
    return aggregate.rollup(_facts(spark, d))


@query("""SELECT n_name AS city, r_name AS country, month(l_shipdate)::INTEGER AS month, round(avg(l_quantity), 6) AS avg_pm2_5, round(avg(l_discount * 100), 6) AS avg_pm10, round(avg(l_tax * 100), 6) AS avg_o3, round(avg(l_extendedprice / 1000), 6) AS avg_no2, round(avg(n_nationkey::DOUBLE), 6) AS lat, round(avg(n_regionkey::DOUBLE), 6) AS lon, count(*) AS n_hours
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def city_month_features(spark, d):
    return _rounded(aggregate.seasonality(_shipments(spark, d), F.col("ts")), "avg_pm2_5", "avg_pm10", "avg_o3", "avg_no2", "lat", "lon")


def _shipments(spark: SparkSession, d: str) -> DataFrame:
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("lineitem", "supplier", "nation", "region")}
    place = t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
    j = t["lineitem"].join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.select(F.col("n_name").alias("city"), F.col("r_name").alias("country"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_quantity").alias("pm2_5"), (F.col("l_discount") * 100).alias("pm10"), (F.col("l_tax") * 100).alias("o3"), (F.col("l_extendedprice") / 1000).alias("no2"), F.col("n_nationkey").cast("double").alias("lat"), F.col("n_regionkey").cast("double").alias("lon"))


# --- features -----------------------------------------------------------------------------

_FEAT = _F + """,
ft AS (SELECT station_id, ts_epoch, date_trunc('day', ts_utc)::DATE AS chunk_day, lag(aqi, 1) OVER w AS aqi_lag_1h, lag(aqi, 3) OVER w AS aqi_lag_3h, lag(aqi, 24) OVER w AS aqi_lag_24h, """ + _P + """, hour(ts_utc)::INTEGER AS hour_of_day, month(ts_utc)::INTEGER AS month, lat, lon, lead(aqi, 24) OVER w AS target_aqi_24h FROM f WINDOW w AS (PARTITION BY station_id ORDER BY ts_epoch)),
ff AS (SELECT * FROM ft WHERE aqi_lag_1h IS NOT NULL AND aqi_lag_3h IS NOT NULL AND aqi_lag_24h IS NOT NULL AND target_aqi_24h IS NOT NULL AND """ + " AND ".join(f"{p} IS NOT NULL" for p in CAPS) + ")"


def _features(spark: SparkSession, d: str) -> DataFrame:
    return features.forecast_features(_facts(spark, d)).withColumn("chunk_day", F.to_date(F.timestamp_seconds("ts_epoch")))


@query(_sql(_FEAT, "SELECT station_id, ts_epoch, aqi_lag_1h, aqi_lag_3h, aqi_lag_24h, hour_of_day, month, lat, lon, target_aqi_24h, " + ", ".join(f"round({p}, 6) AS {p}" for p in CAPS) + " FROM ff"))
def lag_features(spark, d):
    return _rounded(_features(spark, d).drop("chunk_month", "chunk_day"), *CAPS)


@query(_sql(_FEAT, """, ds AS (SELECT DISTINCT chunk_day FROM ff), k AS (SELECT chunk_day, row_number() OVER (ORDER BY chunk_day DESC) AS n, greatest(1, floor(count(*) OVER () * 0.2::DOUBLE)) AS t FROM ds)
SELECT ff.chunk_day, CASE WHEN n <= t THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM ff JOIN k USING (chunk_day) GROUP BY ALL"""))
def time_split(spark, d):
    f = _features(spark, d)
    _, test = features.time_split(f, "chunk_day")
    return f.groupBy("chunk_day", F.when(F.col("chunk_day").isin(test), "test").otherwise("train").alias("part")).agg(F.count("*").alias("n"))


@query(_sql(_F, """, w AS (SELECT station_id, ts_epoch, """ + ", ".join(f"lag(aqi, {23 - k}) OVER w AS seq_{k}" for k in range(24)) + """, lead(aqi, 24) OVER w AS target_aqi_24h FROM f WINDOW w AS (PARTITION BY station_id ORDER BY ts_epoch))
SELECT * FROM w WHERE target_aqi_24h IS NOT NULL AND """ + " AND ".join(f"seq_{k} IS NOT NULL" for k in range(24))))
def sequence_windows(spark, d):
    return features.sequence_windows(_facts(spark, d)).drop("chunk_month")


# --- collecting and serving ---------------------------------------------------------------


@query("SELECT u.d::DATE AS window_start, least(u.d::DATE + 90, DATE '2026-09-01') AS window_end, strftime(u.d, '%Y-%m-%d') AS label FROM unnest(range(TIMESTAMP '2021-01-01', TIMESTAMP '2026-09-01', INTERVAL 90 DAY)) AS u(d)")
def windows_90d(spark, d):
    return scalars.windows(spark, "2021-01-01", "2026-09-01")


@query("""WITH s AS (SELECT 'S' || n_nationkey AS station_id FROM nation), w AS (SELECT u.d::DATE AS window_start, least(u.d::DATE + 90, DATE '2022-01-01') AS window_end FROM unnest(range(TIMESTAMP '2021-01-01', TIMESTAMP '2022-01-01', INTERVAL 90 DAY)) AS u(d))
SELECT * FROM s, w WHERE NOT (station_id <= 'S2' AND window_start < DATE '2021-06-01')""")
def resume_antijoin(spark, d):
    stations = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("station_id"))
    work = collect.work_list(stations, scalars.windows(spark, "2021-01-01", "2022-01-01").drop("label"))
    done = work.where((F.col("station_id") <= "S2") & (F.col("window_start") < "2021-06-01"))
    return collect.remaining(work, done)


_CITIES = "SELECT n_nationkey AS k, n_name AS name, n_regionkey::VARCHAR AS country, (n_nationkey * 7 % 50)::DOUBLE AS lat, (n_nationkey * 13 % 90)::DOUBLE AS lon FROM nation"


def _cities(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return spark.read.parquet(f"{d}/nation.parquet").select(n.alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("country"), (n * 7 % 50).cast("double").alias("lat"), (n * 13 % 90).cast("double").alias("lon"))


@query(f"""WITH c AS ({_CITIES}) SELECT a.k AS a, b.k AS b, round(2 * 6371 * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))), 4) AS km FROM c a JOIN c b ON a.k < b.k
WHERE 2 * 6371 * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))) >= 5000""")
def haversine_pairs(spark, d):
    return _rounded(collect.far_pairs(_cities(spark, d), "k", 5000.0).select("a", "b", "km"), "km", places=4)


@query(f"""WITH c AS ({_CITIES}), q AS (SELECT *, country || '_' || rpad(substr(upper(regexp_replace(name, '[^A-Za-z]', '', 'g')), 1, 3), 3, 'X') AS code FROM c)
SELECT k, code || '_' || lpad(row_number() OVER (PARTITION BY code ORDER BY name)::VARCHAR, 2, '0') AS station_id FROM q""")
def station_codes(spark, d):
    return scalars.station_codes(_cities(spark, d).withColumnRenamed("name", "city")).select("k", "station_id")


@query("SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'Da Nang' WHEN 1 THEN 'Hai Duong' ELSE 'Sao Paulo' END || ' ' || o_orderpriority AS folded FROM orders")
def ascii_folding(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, "Đà Nẵng").when(k % 3 == 1, "Hải Dương").otherwise("São Paulo")
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("k"), scalars.ascii_fold(F.concat_ws(" ", text, "o_orderpriority")).alias("folded"))


@query(_sql(_R, "SELECT DISTINCT station_id, city, country, lat, lon FROM r"))
def stations(spark, d):
    return serving.stations(_readings(spark, d))


@query(_sql(_F, "SELECT station_id, ts_epoch, city, aqi, aqi_level FROM f QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY ts_epoch DESC) = 1"))
def latest_per_station(spark, d):
    return serving.latest(_facts(spark, d).select("station_id", "ts_epoch", "city", "country", "aqi", "aqi_level")).select("station_id", "ts_epoch", "city", "aqi", "aqi_level")


@query(_sql(_F, "SELECT station_id, ts_epoch, aqi FROM f WHERE station_id = 'ST_01' AND ts_epoch BETWEEN 1704499200 AND 1704758400"))
def timeseries_slice(spark, d):
    return serving.timeseries(_facts(spark, d), "ST_01", 1704499200, 1704758400).select("station_id", "ts_epoch", "aqi")


@query(_sql(_R, "SELECT station_id, ts_epoch, station_id || '#' || (9999999999 - ts_epoch) AS row_key, strftime(make_timestamp(ts_epoch * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts_utc FROM r"))
def row_key(spark, d):
    return _readings(spark, d).select("station_id", "ts_epoch", scalars.row_key(F.col("station_id"), F.col("ts_epoch")).alias("row_key"), scalars.iso_utc(F.col("ts_epoch")).alias("ts_utc"))


_RESPONSE = "concat('{\"coord\":{\"lon\":1,\"lat\":2},\"list\":[{\"main\":{\"aqi\":', (event_id % 5 + 1), '},\"components\":{\"co\":', CASE WHEN event_id % 7 = 0 THEN '\"bad\"' ELSE '210.5' END, ',\"no\":0.25,\"no2\":', event_id % 90, ',\"o3\":', event_id % 120, ',\"so2\":null,\"nh3\":1,\"pm10\":', event_id % 200, ',\"pm2_5\":', value, '},\"dt\":', CASE WHEN event_id % 11 = 0 THEN 'null' ELSE cast(1704067200 + event_id * 61 AS STRING) END, '}]}')"


def _responses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("ST_0"), (F.col("user_id") % 5).cast("string")).alias("station_id"), F.col("event_id").cast("string").alias("window"), F.expr(_RESPONSE).alias("body"))
    return collect.normalised(collect.items(e), serving.stations(_readings(spark, d)), fetched_at=F.lit(1704067200))


@query(_sql(_R, """, e AS (SELECT *, 'ST_0' || (user_id % 5) AS station_id FROM events WHERE user_id % 5 < 4 AND event_id % 7 <> 0 AND event_id % 11 <> 0), s AS (SELECT DISTINCT station_id, city, country, lat, lon FROM r)
SELECT station_id, city, country, ((1704067200 + event_id * 61) // 3600) * 3600 AS ts_epoch, 1704067200 + event_id * 61 AS dt_raw, (event_id % 5 + 1)::INTEGER AS owm_aqi, value AS pm2_5, 210.5::DOUBLE AS co, 0.25::DOUBLE AS no, (event_id % 90)::DOUBLE AS no2, (event_id % 120)::DOUBLE AS o3, NULL::DOUBLE AS so2, 1::DOUBLE AS nh3, (event_id % 200)::DOUBLE AS pm10,
'1.0' AS schema_version, 'openweathermap' AS source, 'history' AS ingest_mode, '2024-01-01T00:00:00Z' AS fetched_at_utc, lat, lon, strftime(make_timestamp(((1704067200 + event_id * 61) // 3600) * 3600000000), '%Y-%m-%dT%H:%M:%SZ') AS ts_utc FROM e JOIN s USING (station_id)"""))
def normalise_records(spark, d):
    return _responses(spark, d)[0].select("*", "components.*").drop("components")


@query("""SELECT 'ST_0' || (user_id % 5) AS station_id, event_id::VARCHAR AS "window", CASE WHEN user_id % 5 = 4 THEN 'unknown station' WHEN event_id % 11 = 0 THEN 'no time' ELSE 'a component is no number' END AS error FROM events WHERE user_id % 5 = 4 OR event_id % 7 = 0 OR event_id % 11 = 0""")
def reject_records(spark, d):
    return _responses(spark, d)[1].select("station_id", "window", "error")


_DENSE = f"""WITH RECURSIVE c AS ({_CITIES}), near AS (SELECT a.k AS a, b.k AS b FROM c a JOIN c b ON pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2) <= 144),
core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 3), e AS (SELECT near.a, near.b FROM near JOIN core x ON x.a = near.a JOIN core y ON y.a = near.b),
way AS (SELECT a, b FROM e UNION SELECT way.a, e.b FROM way JOIN e ON e.a = way.b), lab AS (SELECT a, min(b) AS cluster FROM way GROUP BY a),
fin AS (SELECT c.k, coalesce(lab.cluster, (SELECT min(l.cluster) FROM near n JOIN lab l ON l.a = n.b WHERE n.a = c.k)) AS cluster FROM c LEFT JOIN lab ON lab.a = c.k)
"""


# --- models: properties are tested, values depend on partitions -----------------------------


@query()
def kmeans_city_months(spark, d):
    df = aggregate.seasonality(_shipments(spark, d), F.col("ts"))
    out, _, k, value = cluster.fit(df, "kmeans")
    return out.select("city", "country", "month", "prediction", F.lit(k).alias("k"), F.lit(float(value)).alias("silhouette"))


@query()
def clustering_tournament(spark, d):
    df = aggregate.seasonality(_shipments(spark, d), F.col("ts"))
    _, found = cluster.tournament(df)
    return spark.createDataFrame([(a, r[2], float(r[3])) for a, r in found.items()], "algorithm string, k int, silhouette double")


@query(_DENSE + "SELECT c.k, c.lat, c.lon, fin.cluster FROM fin JOIN c USING (k)")
def dbscan_cities(spark, d):
    return cluster.dbscan(_cities(spark, d).select("k", "lat", "lon"), "k", ("lat", "lon"), 12.0, 3)


@query()
def density_sweep(spark, d):
    df = aggregate.seasonality(_shipments(spark, d), F.col("ts"))
    both = cluster.sweep(df, "city", cluster.FEATURES, "dbscan").withColumn("kind", F.lit("dbscan"))
    return both.unionByName(cluster.sweep(df, "city", cluster.FEATURES, "hdbscan").withColumn("kind", F.lit("hdbscan")))


@query()
def rf_forecast(spark, d):
    f = _features(spark, d).cache()
    train, test = features.time_split(f, "chunk_day")
    model = forecast.fit_forest(features.in_chunks(f, train, "chunk_day"))
    return forecast.measures(model.transform(features.in_chunks(f, test, "chunk_day")))


@query()
def online_forecast(spark, d):
    f = _features(spark, d).cache()
    train, test = features.time_split(f, "chunk_day")
    model = forecast.OnlineLinear().fit(features.in_chunks(f, train, "chunk_day"), "chunk_day")
    return forecast.measures(model.predict(features.in_chunks(f, test, "chunk_day")))


@query()
def station_choice(spark, d):
    c = _cities(spark, d)
    kept = select_stations.dedup_by_distance(c, 8.0)
    return select_stations.farthest_points(kept, 3, c.where("k < 2").select("country", "lat", "lon"))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return _readings(spark, d).select(F.lit("1.0").alias("schema_version"), "station_id", "city", "country", "lat", "lon", scalars.iso_utc(F.col("ts_epoch")).alias("ts_utc"), "ts_epoch", F.col("ts_epoch").alias("dt_raw"), F.lit("live").alias("ingest_mode"), "owm_aqi", F.struct(*POLLUTANTS).alias("components"))


@query(_sql(_R, "SELECT station_id, city, country, lat, lon, ts_epoch, ts_epoch AS dt_raw, 'live' AS ingest_mode, owm_aqi, pm2_5, pm10, o3, no2, so2, co FROM r"))
def raw_round_trip(spark, d):
    """Readings written in two lots of stations, the first one again, and read back."""
    folder = _folder(spark, "raw")
    raw = _raw(spark, d)
    first = raw.where("station_id < 'ST_02'")
    for lot in (first, raw.where("station_id >= 'ST_02'"), first):
        readings.write_raw(lot, folder)
    return readings.flat(readings.read_raw(spark, folder))


@query(_sql(_R, "SELECT station_id, ts_epoch, 1::BIGINT AS n, pm2_5 FROM r"))
def stream_hourly(spark, d):
    """The readings written as raw lines, taken by the stream, summed by event hour."""
    from ..streaming import live

    folder = _folder(spark, "stream")
    raw = _raw(spark, d)
    raw.select(F.to_json(F.struct("*"))).write.text(f"{folder}/in")
    good, _ = live.parsed(live.source(spark, f"{folder}/in"))
    name = f"t_{uuid.uuid4().hex}"
    q = live.hourly(good).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


# --- written and read again ---------------------------------------------------------------


@query(_sql(_R, "SELECT station_id, city, country, lat, lon, ts_epoch, owm_aqi, " + _P + ", make_timestamp(ts_epoch * 1000000)::DATE AS dt FROM r"))
def layer_round_trip(spark, d):
    """Written with wrong values first; the second write replaces the dates it holds, all."""
    folder = _folder(spark, "layer")
    r = _readings(spark, d).withColumn("dt", F.to_date(F.timestamp_seconds("ts_epoch")))
    readings.write_layer(r.withColumn("pm2_5", F.lit(-1.0)), folder)
    readings.write_layer(r, folder)
    return readings.read_layer(spark, folder)


@query(_sql(_R, "SELECT station_id, ts_epoch, owm_aqi, " + _P + " FROM r"))
def csv_round_trip(spark, d):
    folder = _folder(spark, "csv")
    readings.write_csv(_readings(spark, d).select("station_id", "ts_epoch", "owm_aqi", *CAPS), folder)
    return readings.read_csv(spark, folder, "station_id string, ts_epoch bigint, owm_aqi int, " + ", ".join(f"{p} double" for p in CAPS))


@query(_sql(_D, "SELECT rank, city, country, dt, avg_aqi, max_aqi, worst_pollutant FROM rk"))
def csv_one_file(spark, d):
    file = _folder(spark, "ranking") + ".csv"
    readings.write_single_csv(phases.city_days(_readings(spark, d)), file)
    return readings.read_csv(spark, file, "rank int, city string, country string, dt date, avg_aqi double, max_aqi double, worst_pollutant string")


@query("""SELECT 'ST_0' || (user_id % 5) AS station_id, event_id::VARCHAR AS "window", CASE WHEN user_id % 5 = 4 THEN 'unknown station' WHEN event_id % 11 = 0 THEN 'no time' ELSE 'a component is no number' END AS error, true AS has_item FROM events WHERE user_id % 5 = 4 OR event_id % 7 = 0 OR event_id % 11 = 0""")
def reject_round_trip(spark, d):
    folder = _folder(spark, "rejects")
    readings.write_rejects(_responses(spark, d)[1], folder)
    found = spark.read.schema("station_id string, window string, error string, raw_item string").json(folder)
    return found.select("station_id", "window", "error", F.col("raw_item").contains('"components"').alias("has_item"))


@query("""WITH s AS (SELECT 'S' || n_nationkey AS station_id FROM nation), w AS (SELECT u.d::DATE AS window_start, least(u.d::DATE + 90, DATE '2022-01-01') AS window_end FROM unnest(range(TIMESTAMP '2021-01-01', TIMESTAMP '2022-01-01', INTERVAL 90 DAY)) AS u(d))
SELECT * FROM s, w WHERE NOT (window_start < DATE '2021-06-01' OR station_id < 'S2')""")
def ledger_resume(spark, d):
    """A ledger of two records, some of the same work, and what it leaves to do."""
    folder = _folder(spark, "ledger")
    stations = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("station_id"))
    work = collect.work_list(stations, scalars.windows(spark, "2021-01-01", "2022-01-01").drop("label"))
    first = collect.remaining(work, collect.load_ledger(spark, folder)).where("window_start < '2021-06-01'")
    collect.record(first, folder)
    collect.record(work.where("station_id < 'S2'"), folder)
    return collect.remaining(work, collect.load_ledger(spark, folder))


def _json_array(rows: DataFrame, wrap: str) -> DataFrame:
    """One line with all rows as a JSON array: for tables as small as nation."""
    return rows.agg(F.format_string(wrap, F.to_json(F.sort_array(F.collect_list(F.struct("*"))))).alias("value"))


@query(f"""WITH c AS ({_CITIES}) SELECT 'S' || lpad(k::VARCHAR, 2, '0') AS station_id, name AS city, country, lat, lon FROM c ORDER BY station_id LIMIT 7""")
def station_file(spark, d):
    folder = _folder(spark, "stations")
    rows = _cities(spark, d).select(F.concat(F.lit("S"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("station_id"), F.col("name").alias("city"), "country", "lat", "lon")
    _json_array(rows, '{"stations": %s}').write.text(folder)
    return readings.load_stations(spark, folder, 7)


@query(f"WITH c AS ({_CITIES}) SELECT k::BIGINT AS id, name, country, lat, lon FROM c")
def city_list_file(spark, d):
    folder = _folder(spark, "cities")
    rows = _cities(spark, d).select(F.col("k").alias("id"), "name", F.lit("").alias("state"), "country", F.struct("lon", "lat").alias("coord"))
    _json_array(rows, "%s").write.option("compression", "gzip").text(folder)
    return readings.load_cities(spark, folder)


@query("SELECT 'ST_' || lpad((i % 200)::VARCHAR, 3, '0') AS station_id, 1700000000 + (i // 200) * 3600 AS ts_epoch, true AS in_range FROM range(100000) AS t(i)")
def synthetic_frame(spark, d):
    tops = {"pm2_5": 150, "pm10": 200, "o3": 150, "no2": 150, "so2": 100, "co": 3000}
    inside = F.lit(True)
    for p, top in tops.items():
        inside = inside & F.col(p).between(0, top) & (F.round(p, 2) == F.col(p))
    return readings.synthetic(spark, 100_000).select("station_id", "ts_epoch", inside.alias("in_range"))


@query(_sql(_R, " UNION ALL ".join(f"SELECT '{name}' AS summary, " + ", ".join(f"round(({f.format(c=c)})::DOUBLE, 6) AS {c}" for c in ("pm2_5", "co")) + " FROM r" for name, f in {"count": "count({c})", "mean": "avg({c})", "stddev": "stddev_samp({c})", "min": "min({c})", "max": "max({c})"}.items())))
def summary_stats(spark, d):
    rows = aggregate.summary(_readings(spark, d), "pm2_5", "co").where(~F.col("summary").endswith("%"))
    return _rounded(rows.select("summary", *(F.col(c).cast("double") for c in ("pm2_5", "co"))), "pm2_5", "co")


@query("SELECT n_nationkey AS k, lower(n_name) LIKE 'uni%' OR lower(n_name) LIKE 'i%' OR lower(n_name) LIKE 'saudi a%' AS junk FROM nation")
def junk_names(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"), scalars.is_junk_name(F.col("n_name"), ("Uni", "i", "Saudi A")).alias("junk"))


@query(ORACLES["sequence_windows"].replace("SELECT * FROM w WHERE", ", q AS (SELECT * FROM w WHERE", 1) + "), u AS (SELECT avg(v) AS mean, stddev_pop(v) AS sd FROM (SELECT unnest([" + ", ".join(f"seq_{k}" for k in range(24)) + "]) AS v FROM q)) SELECT station_id, ts_epoch, " + ", ".join(f"round((seq_{k} - mean) / sd, 6) AS seq_{k}" for k in range(24)) + ", target_aqi_24h FROM q, u")
def sequence_scaling(spark, d):
    out = features.scaled_sequences(features.sequence_windows(_facts(spark, d)))
    return _rounded(out, *(f"seq_{k}" for k in range(24)))


# --- measures, functions, choices ---------------------------------------------------------


@query(_sql(_FEAT, """SELECT round(sqrt(avg(pow(target_aqi_24h - aqi_lag_1h, 2))), 6) AS rmse, round(avg(abs(target_aqi_24h - aqi_lag_1h)), 6) AS mae, round(1 - sum(pow(target_aqi_24h - aqi_lag_1h, 2)) / (var_pop(target_aqi_24h) * count(*)), 6) AS r2, count(*) AS n_test FROM ff"""))
def persistence_measures(spark, d):
    """The last hour as the forecast, measured over all rows."""
    found = _features(spark, d).withColumn("prediction", F.col("aqi_lag_1h"))
    return _rounded(forecast.measures(found), "rmse", "mae", "r2")


_HOUR_STRUCT = f""", s AS (SELECT station_id, ts_epoch, {", ".join(f"{_sub(p, 'o3_1h' if p == 'o3' else p)} AS iaqi_{p}" for p in CAPS)} FROM c), t AS (SELECT *, greatest({", ".join(f"iaqi_{p}" for p in CAPS)}) AS mx FROM s)
SELECT station_id, ts_epoch, round_even(mx, 0) AS aqi, {_LEVEL.format(a="mx")} AS aqi_level, {_LABELS}[{_LEVEL.format(a="mx")}] AS aqi_label, {_DOMINANT} AS dominant_pollutant FROM t"""


@query(_sql(_C, _HOUR_STRUCT))
def sql_hour_struct(spark, d):
    aqi.register_functions(spark)
    r = clean.clip(_readings(spark, d))
    return r.select("station_id", "ts_epoch", F.expr(f"aqi_udf({_P})").alias("r")).select("station_id", "ts_epoch", "r.*")


@query(_sql(_N, "SELECT station_id, ts_epoch, round(nowcast_pm2_5, 6) AS nowcast_pm2_5 FROM x"))
def sql_nowcast(spark, d):
    aqi.register_functions(spark)
    w = Window.partitionBy("station_id").orderBy("ts_epoch")
    r = clean.interpolate(_grid(spark, d)).withColumn("v", aqi.dense_hours("ts_epoch", "pm2_5", 12, w))
    return r.select("station_id", "ts_epoch", F.expr("round(nowcast(v), 6)").alias("nowcast_pm2_5"))


def _km_sql(a: str, b: str) -> str:
    return f"2 * 6371 * asin(sqrt(least(1.0, pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))))"


@query(f"""WITH RECURSIVE c AS ({_CITIES}), o AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY name, lat, lon) AS i FROM c),
g AS (SELECT country, 0::BIGINT AS i, []::STRUCT(name VARCHAR, lat DOUBLE, lon DOUBLE)[] AS kept FROM c GROUP BY country
 UNION ALL SELECT g.country, o.i, CASE WHEN len(list_filter(kept, lambda x: {_km_sql("o", "x")} < 2500)) = 0 THEN list_append(kept, {{'name': o.name, 'lat': o.lat, 'lon': o.lon}}) ELSE kept END FROM g JOIN o ON o.country = g.country AND o.i = g.i + 1),
l AS (SELECT country, arg_max(kept, i) AS kept FROM g GROUP BY country), u AS (SELECT country, unnest(kept) AS x FROM l) SELECT x.name AS name, country, x.lat AS lat, x.lon AS lon FROM u""")
def stations_apart(spark, d):
    return select_stations.dedup_by_distance(_cities(spark, d), 2500.0)


def _spread_sql(n: int) -> str:
    """Rounds written out: each takes, in every country, the city farthest from what it has."""
    rounds = []
    for k in range(1, n + 1):
        near = f"(SELECT min({_km_sql('c', 'p')}) FROM p{k - 1} p WHERE p.country = c.country)"
        rounds.append(f"p{k} AS (SELECT country, name, lat, lon, turn FROM p{k - 1} UNION ALL (SELECT country, name, lat, lon, {k} AS turn FROM (SELECT c.*, coalesce({near}, 'inf'::DOUBLE) AS far FROM free c WHERE NOT EXISTS (SELECT 1 FROM p{k - 1} p WHERE p.country = c.country AND p.name = c.name)) QUALIFY row_number() OVER (PARTITION BY country ORDER BY far DESC, name) = 1))")
    seeds = "p0 AS (SELECT country, ''::VARCHAR AS name, lat, lon, 0 AS turn FROM c WHERE k < 2)"
    free = f"free AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM p0 p WHERE p.country = c.country AND {_km_sql('c', 'p')} < 5))"
    return f"WITH c AS ({_CITIES}), {seeds}, {free}, {', '.join(rounds)} SELECT name, country, lat, lon, turn::INTEGER AS turn FROM p{n} WHERE turn > 0"


@query(_spread_sql(3))
def stations_spread(spark, d):
    c = _cities(spark, d)
    return select_stations.farthest_points(c, 3, c.where("k < 2").select("country", "lat", "lon"))


@query(_DENSE + "SELECT c.name, c.lat, c.lon, fin.cluster FROM fin JOIN c USING (k)")
def cluster_listing(spark, d):
    found = cluster.dbscan(_cities(spark, d).select("k", "name", "lat", "lon"), "k", ("lat", "lon"), 12.0, 3)
    return cluster.listed(found, "name", "lat", "lon")


# --- the live lane ------------------------------------------------------------------------

_LIVE = _F.replace("FROM i JOIN i j", "FROM c i JOIN c j").replace("nowcast_pm2_5, nowcast_pm10 FROM i", "nowcast_pm2_5, nowcast_pm10 FROM c i").replace("x AS (SELECT i.*", "x AS (SELECT i.*")


@query(_sql(_LIVE, "SELECT station_id, ts_epoch, aqi, aqi_level, aqi_label, dominant_pollutant, station_id || '#' || (9999999999 - ts_epoch) AS row_key FROM f"))
def live_upsert(spark, d):
    """Three batches, of which the last is a late correction of the first: the later half,
    the earlier half with wrong values, the earlier half; the last one twice."""
    from ..streaming import live

    store = _folder(spark, "live")
    put = live.upsert(store)
    r = clean.clip(_readings(spark, d).withColumns({"ingest_mode": F.lit("live"), "dt_raw": F.col("ts_epoch")}))
    noon = F.pmod(F.floor(F.col("ts_epoch") / 86400), F.lit(2)) == 0
    for i, batch in enumerate((r.where(~noon), r.where(noon).withColumns({"pm2_5": F.lit(1.0), "dt_raw": F.col("dt_raw") - 1}), r.where(noon), r.where(noon))):
        put(batch, min(i, 2))
    return spark.read.parquet(f"{store}/aqi").select("station_id", "ts_epoch", "aqi", "aqi_level", "aqi_label", "dominant_pollutant", "row_key")


@query("SELECT CASE event_id % 3 WHEN 0 THEN '{\"city\":\"x\"}' ELSE 'line ' || event_id END AS value, 'no record' AS error FROM events")
def live_dead_letters(spark, d):
    """A line that is no record for every event, between the readings' lines."""
    from ..streaming import live

    folder = _folder(spark, "dead")
    bad = spark.read.parquet(f"{d}/events.parquet").select(F.when(F.col("event_id") % 3 == 0, '{"city":"x"}').otherwise(F.concat(F.lit("line "), F.col("event_id").cast("string"))).alias("value"))
    _raw(spark, d).select(F.to_json(F.struct("*")).alias("value")).unionByName(bad).write.text(f"{folder}/in")
    for q in live.start(spark, f"{folder}/in", f"{folder}/store"):
        q.awaitTermination()
    return spark.read.schema("value string, error string").json(f"{folder}/store/dead")


@query(_sql(_R, "SELECT station_id AS key, station_id, ts_epoch, pm2_5, so2 FROM r"))
def live_messages(spark, d):
    """Readings as keyed messages, read by the live lane's own schema."""
    from ..streaming import live

    sent = live.messages(_raw(spark, d))
    flat = sent.select("key", F.from_json("value", live.VALUE_SCHEMA).alias("r"))
    return flat.select("key", "r.station_id", "r.ts_epoch", "r.components.pm2_5", "r.components.so2")
