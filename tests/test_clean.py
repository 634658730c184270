from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from aerolith.operators import aggregate, clean
from aerolith.plans import phases
from aerolith.sources import readings

T0 = 1_800_000_000
SCHEMA = "station_id string, ts_epoch long, pm2_5 double, pm10 double, o3 double, no2 double, so2 double, co double"


def rows(spark, *values, schema=SCHEMA):
    return spark.createDataFrame([(*v, *([None] * (8 - len(v)))) for v in values], schema)


def test_clip_keeps_the_cap_and_drops_values_alone(spark):
    got = clean.clip(rows(spark, ("a", T0, 500.0, -5.0, 1201.0, 3850.0, math.nan, 1.0))).first()
    assert (got.pm2_5, got.pm10, got.o3, got.no2, got.so2, got.co) == (500.0, None, None, 3850.0, None, 1.0)


def test_dedup_is_deterministic(spark):
    df = spark.createDataFrame([("a", T0, "live", 5, 1.0), ("a", T0, "history", 1, 2.0), ("a", T0, "history", 3, 3.0), ("b", T0, "live", 1, 4.0)], "station_id string, ts_epoch long, ingest_mode string, dt_raw long, pm2_5 double")
    for n in (1, 3):
        assert {(r.station_id, r.pm2_5) for r in clean.dedup(df.repartition(n)).collect()} == {("a", 3.0), ("b", 4.0)}


def test_grid_fills_hours_and_metadata(spark):
    df = rows(spark, ("a", T0, 1.0), ("a", T0 + 3 * 3600, 2.0)).withColumns({"city": F.lit("X"), "country": F.lit("VN"), "lat": F.lit(1.0), "lon": F.lit(2.0)})
    got = clean.hour_grid(df).orderBy("ts_epoch").collect()
    assert [r.pm2_5 for r in got] == [1.0, None, None, 2.0]
    assert {r.city for r in got} == {"X"}


@pytest.mark.parametrize(("missing", "filled"), [(1, True), (2, True), (3, False), (4, False)])
def test_gaps(spark, missing, filled):
    df = rows(spark, ("a", T0, 0.0), *(("a", T0 + 3600 * k, None) for k in range(1, missing + 1)), ("a", T0 + 3600 * (missing + 1), 12.0))
    inner = clean.interpolate(df).where(f"ts_epoch > {T0} AND ts_epoch < {T0 + 3600 * (missing + 1)}").orderBy("ts_epoch").collect()
    assert {r.pm2_5_qc for r in inner} == {"interpolated" if filled else "missing"}
    if filled:
        assert [r.pm2_5 for r in inner] == pytest.approx([12.0 * k / (missing + 1) for k in range(1, missing + 1)])
    wider = clean.interpolate(df, max_neighbor_gap_hours=missing + 1).where("pm2_5 IS NULL")
    assert wider.count() == 0


def test_ends_are_not_extrapolated(spark):
    got = clean.interpolate(rows(spark, ("a", T0, None), ("a", T0 + 3600, 1.0), ("a", T0 + 7200, None))).orderBy("ts_epoch").collect()
    assert [r.pm2_5_qc for r in got] == ["missing", "measured", "missing"]


def test_day_runs_from_one_to_midnight(spark):
    year_end = 1_798_761_600  # 2027-01-01 00:00 UTC
    got = clean.day_aggregates(rows(spark, ("a", year_end - 23 * 3600, 1.0), ("a", year_end, 3.0), ("a", year_end + 3600, 9.0))).orderBy("ts_epoch").collect()
    assert [str(r.aqi_day) for r in got] == ["2026-12-31", "2026-12-31", "2027-01-01"]
    assert [r.pm2_5_day_avg for r in got] == [2.0, 2.0, 9.0]
    assert {r.day_qc_flag for r in got} == {"insufficient_data"}


@pytest.mark.parametrize(("hours", "flag"), [(17, "insufficient_data"), (18, "valid")])
def test_day_threshold(spark, hours, flag):
    got = clean.day_completeness(rows(spark, *(("a", T0 - T0 % 86400 + 3600 * (k + 1), None, 1.0) for k in range(hours)))).first()
    assert (got.valid_hours, got.day_qc_flag) == (hours, flag)


def test_reports(spark):
    df = rows(spark, ("a", T0, 1.0), ("a", T0 + 3600, None), ("a", T0 + 7200, 3.0), ("a", T0 + 7200 + 5 * 3600, 3.0))
    report = {r.pollutant: r for r in clean.quality_report(clean.interpolate(clean.hour_grid(df))).collect()}
    assert (report["pm2_5"].n_rows, report["pm2_5"].n_interpolated, report["pm2_5"].n_missing) == (8, 1, 4)
    assert report["co"].pct_missing == 100.0
    gap = clean.gap_scan(df).first()
    assert (gap.gap_from, gap.missing_hours) == (T0 + 7200, 4)
    c = clean.contiguity(df.unionByName(df.limit(1))).first()
    assert (c.n_duplicates, c.n_hours, c.expected, c.completeness) == (1, 4, 8, 50.0)


def test_empty_tables(spark):
    none = rows(spark).limit(0)
    assert clean.interpolate(clean.hour_grid(clean.clip(none))).count() == 0
    assert clean.quality_report(clean.interpolate(none)).where("n_rows <> 0").count() == 0


def test_layers_through_files(spark, tmp_path):
    sample = readings.sample(spark, hours=24 * 12, seed=3)
    bad = spark.createDataFrame([("no json",)], "value string")
    sample.select(F.to_json(F.struct("*")).alias("value")).unionByName(bad).write.option("compression", "gzip").text(f"{tmp_path}/raw/dt=x")
    raw = readings.read_raw(spark, f"{tmp_path}/raw", corrupt="bad")
    assert raw.cache().where("bad IS NOT NULL").count() == 1
    flat = readings.flat(raw.where("bad IS NULL"), ("1.0",))
    assert flat.count() == sample.count()
    layer = phases.cleaned(flat)
    readings.write_layer(layer, f"{tmp_path}/clean")
    phases.run_index(spark, f"{tmp_path}/clean", f"{tmp_path}/aqi", f"{tmp_path}/cmp")
    phases.run_aggregate(spark, f"{tmp_path}/aqi", f"{tmp_path}/daily", f"{tmp_path}/rank")
    ranked = readings.read_layer(spark, f"{tmp_path}/rank")
    days = readings.read_layer(spark, f"{tmp_path}/daily")
    assert ranked.count() == days.count() > 40
    first = days.count()
    phases.run_aggregate(spark, f"{tmp_path}/aqi", f"{tmp_path}/daily", f"{tmp_path}/rank")  # again: nothing doubles
    assert readings.read_layer(spark, f"{tmp_path}/daily").count() == first
    readings.write_single_csv(readings.read_layer(spark, f"{tmp_path}/daily").select("city", "dt"), f"{tmp_path}/one.csv")
    assert readings.read_csv(spark, f"{tmp_path}/one.csv", "city string, dt date").count() == first


def test_raw_lines_are_appended_once(spark, tmp_path):
    """A second station leaves the first one's lines of the same partition in place; a
    window that is written again leaves no second copy."""
    sample = readings.sample(spark, hours=48, seed=3)
    ids = sorted(r.station_id for r in sample.select("station_id").distinct().collect())
    path = f"{tmp_path}/raw"
    for station in [*ids, ids[0]]:
        readings.write_raw(sample.where(F.col("station_id") == station), path)
    columns = ["station_id", "city", "country", "ingest_mode", "dt_raw", "owm_aqi"]
    want = sorted(map(str, sample.select(*columns).distinct().collect()))
    assert sorted(map(str, readings.read_raw(spark, path).select(*columns).distinct().collect())) == want
    assert readings.read_raw(spark, path).count() == sample.count()
    readings.write_raw(sample.limit(0), path)
    assert readings.read_raw(spark, path).count() == sample.count()


def test_interpolation_reaches_no_farther_than_a_neighbour_may_be(spark):
    hours = [(0, 1.0), (3, 4.0), (7, 9.0), (8, None), (8, 5.0), (9, None)]
    rows = [("a", 3600 * h, v) for h, v in hours] + [("a", 3600 * h, None) for h in (1, 2, 4, 5, 6)]
    got = clean.interpolate(spark.createDataFrame(rows, "station_id string, ts_epoch long, pm2_5 double")).collect()
    found = sorted((r.ts_epoch // 3600, r.pm2_5, r.pm2_5_qc) for r in got if r.pm2_5 is not None)
    assert found == [(0, 1.0, "measured"), (1, 2.0, "interpolated"), (2, 3.0, "interpolated"), (3, 4.0, "measured"), (7, 9.0, "measured"), (8, 5.0, "interpolated"), (8, 5.0, "measured")]
    assert sorted(r.ts_epoch // 3600 for r in got if r.pm2_5_qc == "missing") == [4, 5, 6, 9]


def test_top_of_latest_date(spark):
    shape = "rank int, city string, country string, dt date, avg_aqi double, max_aqi double, worst_pollutant string"
    rows = [(k, f"c{k}", "x", f"2024-01-0{d}", 1.0, 1.0, None) for d, n in ((1, 9), (2, 3)) for k in range(1, n + 1)] + [(1, "z", "x", None, 9.0, 9.0, None)]
    df = spark.createDataFrame(rows, shape.replace("dt date", "dt string")).withColumn("dt", F.to_date("dt"))
    assert [(r.rank, r.city) for r in aggregate.top_of_latest(df, 5).collect()] == [(1, "c1"), (2, "c2"), (3, "c3")]
    assert [r.rank for r in aggregate.top_of_latest(df, 2).collect()] == [1, 2]
    assert aggregate.top_of_latest(df.limit(0)).count() == 0
