from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from aerolith.functions import aqi, standards
from tests import scalar_core as core

P = standards.POLLUTANTS


def one(spark, column, **values):
    schema = ", ".join(f"{k} double" for k in values) or "x double"
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(("value", "pollutant", "want"), [(0.0, "pm2_5", 0.0), (25.0, "pm2_5", 50.0), (136.1, "o3_1h", 42.53125), (None, "pm2_5", None), (-1.0, "pm2_5", None), (float("nan"), "pm2_5", None), (501.0, "pm2_5", 500.0), (401.0, "o3_8h", 500.0)])
def test_sub_index(spark, value, pollutant, want):
    assert one(spark, aqi.iaqi("c", pollutant), c=value) == want


@pytest.mark.parametrize("standard", ["VN_1459", "EPA"])
def test_sub_index_at_and_beside_every_edge(spark, standard):
    for p, points in standards.load_standard(standard)[1].items():
        values = [x + d for x in points for d in (-1e-6, 0.0, 1e-6)]
        got = spark.createDataFrame([(float(v),) for v in values], "c double").select("c", aqi.iaqi("c", p, standard).alias("v")).collect()
        for r in got:
            assert r.v == core.iaqi(r.c, p, standard), (p, r.c)


def test_levels_and_rounding(spark):
    values = [30.0, 50.0, 50.3, 75.0, 300.0, 450.0, 600.0, None]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "a double").select(aqi.level("a").alias("v")).collect()]
    assert got == [1, 1, 2, 2, 5, 6, 6, None]
    # 50.3 is 50 when rounded, and level 2 all the same; halves go to the even neighbour
    df = spark.createDataFrame([(25.15, None), (1.25, None), (0.75, None)], "pm2_5 double, pm10 double")
    for c in ("o3", "no2", "so2", "co"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    rows = aqi.hour_aqi(df).select("pm2_5", "aqi", "aqi_level").collect()
    assert [(r.aqi, r.aqi_level) for r in rows] == [(50.0, 2), (2.0, 1), (2.0, 1)]


def test_worked_hour(spark):
    row = spark.createDataFrame([(20.3, None, 136.1, 118.7, None, None)], ", ".join(f"{p} double" for p in P))
    got = aqi.hour_aqi(row).first()
    assert (got.aqi, got.dominant_pollutant, got.aqi_label) == (59.0, "no2", "Trung bình")
    assert got.iaqi_o3 == pytest.approx(42.53125) and got.iaqi_no2 == pytest.approx(59.35)


def test_worked_day_and_ozone_above_400(spark):
    schema = "pm2_5 double, pm10 double, so2 double, no2 double, co double, o3_1h double, o3_8h double"
    got = aqi.day_aqi(spark.createDataFrame([(55.7, None, None, 130.8, None, 114.6, 89.3), (None, None, None, None, None, 114.6, 450.0), (None, None, None, None, None, 114.6, None)], schema)).collect()
    assert (got[0].aqi_day, got[0].dominant_pollutant) == (110.0, "pm2_5")
    assert got[0].iaqi_o3 == pytest.approx(44.65, abs=0.01)
    assert got[1].iaqi_o3 == got[2].iaqi_o3


def test_other_standards_are_refused(spark):
    with pytest.raises(ValueError):
        aqi.hour_aqi(spark.createDataFrame([(1.0,)], "pm2_5 double"), standard="EPA")
    with pytest.raises(ValueError):
        standards.load_standard("none")


def test_random_rows_against_scalar_core(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(500):
        rows.append(tuple(None if rng.random() < 0.25 else rng.choice([0.0, 50.0, 125.0, rng.uniform(0, 700)]) for _ in P))
    df = spark.createDataFrame(rows, ", ".join(f"{p} double" for p in P))
    for r in aqi.hour_aqi(df).withColumn("provider", aqi.provider_index()).collect():
        parts = {p: core.iaqi(r[p], "o3_1h" if p == "o3" else p) for p in P}
        assert (r.aqi, r.aqi_level, r.dominant_pollutant) == core.reduced(parts)
        assert r.provider == core.provider({p: r[p] for p in P})


def frame(spark, series, start=1_800_000_000):
    rows = [(s, start + 3600 * h, v, v) for s, values in series.items() for h, v in values]
    return spark.createDataFrame(rows, "station_id string, ts_epoch long, pm2_5 double, pm10 double")


def test_worked_nowcast(spark):
    values = [20.6, 19.6, 22.4, 20.3, 16.5, 19.0, 16.5, 19.5, 23.5, 20.5, 24.7, 26.9]
    got = aqi.add_nowcast(frame(spark, {"a": list(enumerate(reversed(values)))})).orderBy(F.desc("ts_epoch")).first()
    assert got.nowcast_pm2_5 == pytest.approx(20.3, abs=0.1)


@pytest.mark.parametrize("gaps", [False, True])
def test_nowcasts_against_scalar_core(spark, gaps):
    rng = random.Random(8)
    series = {}
    for s in "abc":
        hours = [h for h in range(90) if not gaps or rng.random() > 0.3]
        series[s] = [(h, None if rng.random() < 0.3 else rng.choice([0.0, 0.0, rng.uniform(0, 90)])) for h in hours]
    df = frame(spark, series)
    plain = aqi.add_nowcast(df, gapless=not gaps)
    known = {s: dict(v) for s, v in series.items()}
    for r in plain.collect():
        h = (r.ts_epoch - 1_800_000_000) // 3600
        want = core.nowcast([known[r.station_id].get(h - i) for i in range(12)])
        assert (r.nowcast_pm2_5 is None) == (want is None)
        assert want is None or r.nowcast_pm2_5 == pytest.approx(want, rel=1e-12)
    if not gaps:
        cut = aqi.add_nowcast(df, slice_hours=24).select("station_id", "ts_epoch", "nowcast_pm10")
        assert sorted(cut.collect()) == sorted(plain.select("station_id", "ts_epoch", "nowcast_pm10").collect())


def test_zero_window_and_missing_hour(spark):
    got = aqi.add_nowcast(frame(spark, {"z": [(h, 0.0) for h in range(12)], "m": [(0, 8.0), (1, 8.0), (2, None)]})).collect()
    assert {r.nowcast_pm2_5 for r in got if r.station_id == "z" and r.ts_epoch >= 1_800_003_600} == {0.0}
    assert [r.nowcast_pm2_5 for r in got if r.station_id == "m"][-1] == 8.0  # two of the latest three are enough


def test_sql_functions(spark):
    aqi.register_functions(spark)
    got = spark.sql("SELECT iaqi(136.1D, 'o3_1h') AS a, aqi_level(50.3D) AS b, provider_index(9D, 1D, 1D, 1D, 400D, NULL) AS c, iaqi(-1D, 'co') AS d").first()
    assert (got.a, got.b, got.c, got.d) == (pytest.approx(42.53125), 2, 5, None)


def test_nowcast_plan_has_one_shuffle_and_no_python(spark):
    plan = aqi.hour_aqi(aqi.add_nowcast(frame(spark, {"a": [(0, 1.0)]}).withColumns({c: F.lit(1.0) for c in ("o3", "no2", "so2", "co")})))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Pandas" not in plan
