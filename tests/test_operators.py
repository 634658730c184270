from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.functions import scalars
from aerolith.operators import aggregate, cluster, collect, features, forecast, select_stations
from aerolith.plans import serving
from aerolith.sources import readings

T0 = 1_800_000_000 - 1_800_000_000 % 86400
HOURS = "city string, country string, dt string, aqi double, aqi_level int, dominant_pollutant string"


def test_daily_and_mode(spark):
    df = spark.createDataFrame([("a", "VN", "d", 10.0, 1, "o3"), ("a", "VN", "d", 20.0, 1, "co"), ("a", "VN", "d", 60.0, 2, "o3"), ("b", "VN", "d", None, None, None), ("c", "VN", "d", 5.0, 1, "so2"), ("c", "VN", "d", 5.0, 1, "no2")], HOURS)
    got = {r.city: r for r in aggregate.daily(df).collect()}
    assert (got["a"].avg_aqi, got["a"].max_aqi, got["a"].min_aqi, got["a"].n_hours, got["a"].worst_pollutant) == (30.0, 60.0, 10.0, 3, "o3")
    assert (got["b"].n_hours, got["b"].avg_aqi, got["b"].worst_pollutant) == (0, None, None)
    assert got["c"].worst_pollutant == "no2"  # ties: the first by name
    assert aggregate.level_mismatch(aggregate.daily(df)).count() == 0


def test_ranking_restarts_and_is_total(spark):
    df = spark.createDataFrame([("a", "VN", "d1", 50.0), ("b", "VN", "d1", 150.0), ("c", "IN", "d1", 50.0), ("z", "IN", "d1", None), ("a", "VN", "d2", 1.0)], "city string, country string, dt string, avg_aqi double").withColumns({"max_aqi": F.lit(1.0), "worst_pollutant": F.lit("o3")})
    ranked = aggregate.ranking(df)
    got = {(r.dt, r.city): r["rank"] for r in ranked.collect()}
    assert got == {("d1", "b"): 1, ("d1", "a"): 2, ("d1", "c"): 3, ("d1", "z"): 4, ("d2", "a"): 1}
    assert [r.city for r in aggregate.top_of_latest(ranked).collect()] == ["a"]
    assert [r.city for r in serving.ranking(ranked, "d1", "IN").collect()] == ["c", "z"]
    assert [r["rank"] for r in serving.ranking(ranked, "d1", "IN").collect()] == [1, 2]


def test_scalars(spark):
    c = F.lit
    one = spark.range(1).select(
        scalars.hour_floor(c(1789299430)).alias("h"), scalars.iso_utc(c(1789297200)).alias("iso"), scalars.row_key(c("S"), c(1789297200)).alias("k"), scalars.haversine_km(c(21.03), c(105.85), c(10.78), c(106.7)).alias("km"), scalars.ascii_fold(c("Đà Nẵng São Ångström é")).alias("f"), scalars.is_junk_name(c("QUẬN 1"), ("quận", "phường")).alias("j")
    ).first()
    assert (one.h, one.iso, one.k, one.f, one.j) == (1789297200, "2026-09-13T11:00:00Z", "S#8210702799", "Da Nang Sao Angstrom e", True)
    assert one.km == pytest.approx(1143, abs=3)
    w = scalars.windows(spark, "2021-01-01", "2026-09-01").collect()
    assert (len(w), str(w[-1].window_end), w[0].label) == (23, "2026-09-01", "2021-01-01")
    with pytest.raises(ValueError):
        scalars.windows(spark, "2021-01-01", "2021-01-01")
    codes = scalars.station_codes(spark.createDataFrame([("Hà Nội", "VN"), ("Hanam", "VN"), ("Ü", "DE")], "city string, country string")).collect()
    assert {(r.city, r.station_id) for r in codes} == {("Hanam", "VN_HAN_01"), ("Hà Nội", "VN_HAN_02"), ("Ü", "DE_UXX_01")}


def test_normalise_and_rejects(spark):
    good = {"main": {"aqi": 2}, "components": {"co": 1, "pm2_5": 2.5}, "dt": 1789299430}
    bodies = [
        {"list": [good, {"main": {"aqi": 2}, "components": None, "dt": 1}, {"main": {}, "components": {}, "dt": 1}]},
        {"list": [{**good, "components": {"co": "x"}}, {**good, "dt": None}]},
    ]
    rows = [("A", "w", json.dumps(b)) for b in bodies] + [("B", "w", json.dumps({"list": [good]})), ("A", "w", "no json"), ("C", "w", json.dumps({"list": [good]}))]
    stations = spark.createDataFrame([("A", "X", "VN", 1.23456, 2.0), ("C", None, "VN", 1.0, 2.0)], readings.STATION_SCHEMA)
    ok, bad = collect.normalised(collect.items(spark.createDataFrame(rows, "station_id string, window string, body string")), stations)
    r = ok.collect()
    assert len(r) == 1 and (r[0].ts_epoch, r[0].dt_raw, r[0].lat, r[0].components.pm2_5, r[0].components.no2) == (1789297200, 1789299430, 1.2346, 2.5, None)
    assert sorted(x.error for x in bad.collect()) == ["a component is no number", "no components", "no index", "no item", "no time", "station without a field", "unknown station"]
    with pytest.raises(ValueError):
        collect.normalised(collect.items(spark.createDataFrame([], "station_id string, window string, body string")), stations, "other")


def test_ledger(spark, tmp_path):
    work = collect.work_list(spark.createDataFrame([("A",), ("B",)], "station_id string"), scalars.windows(spark, "2021-01-01", "2021-08-01").drop("label"))
    path = f"file://{tmp_path}/ledger"
    assert collect.remaining(work, collect.load_ledger(spark, path)).count() == work.count() == 6
    collect.record(work.where("station_id = 'A'"), path)
    collect.record(work.where("station_id = 'A'"), path)
    assert {r.station_id for r in collect.remaining(work, collect.load_ledger(spark, path)).collect()} == {"B"}


def test_provider_source(spark):
    from aerolith.sources.readings import AuthError, ProviderSource, fetch

    waits, answers = [], iter([(429, {}), (503, {}), (200, {"ok": 1})])
    assert fetch(lambda r: next(answers), {}, sleep=waits.append) == {"ok": 1} and waits == [2, 4]
    with pytest.raises(AuthError):
        fetch(lambda r: (401, {}), {})
    with pytest.raises(RuntimeError):
        fetch(lambda r: (500, {}), {}, sleep=waits.append)

    class Fake(ProviderSource):
        transport = staticmethod(lambda r: (200, {"list": [], "for": r["station_id"]}))

        @classmethod
        def name(cls):
            return "fake_provider"

    spark.dataSource.register(Fake)
    got = spark.read.format("fake_provider").option("requests", json.dumps([{"station_id": "A"}, {"station_id": "B"}])).option("calls_per_second", "1000").load().collect()
    assert [(r.station_id, json.loads(r.body)["for"]) for r in got] == [("A", "A"), ("B", "B")]


def test_stations_from_files(spark, tmp_path):
    (tmp_path / "cities.json").write_text(json.dumps({"stations": [{"station_id": s, "city": s, "country": "VN", "lat": 1.0, "lon": 2.0} for s in "CAB"]}))
    assert [r.station_id for r in readings.load_stations(spark, str(tmp_path / "cities.json"), 2).collect()] == ["A", "B"]
    (tmp_path / "list.json").write_text(json.dumps([{"id": 1, "name": "X", "state": "", "country": "VN", "coord": {"lat": 1.0, "lon": 2.0}}]))
    assert readings.load_cities(spark, str(tmp_path / "list.json")).first().lat == 1.0


def hourly(spark, n, station="a"):
    return spark.range(n).select(F.lit(station).alias("station_id"), (F.lit(T0) + F.col("id") * 3600).alias("ts_epoch"), (F.col("id") % 50 + 1.0).alias("aqi"), *(F.lit(1.0).alias(p) for p in ("pm2_5", "pm10", "o3", "no2", "so2", "co", "lat", "lon")))


@pytest.mark.parametrize(("n", "lags", "sequences"), [(72, 24, 25), (47, 0, 0), (48, 0, 1)])
def test_feature_laws(spark, n, lags, sequences):
    assert features.forecast_features(hourly(spark, n)).count() == lags
    seq = features.sequence_windows(hourly(spark, n))
    assert seq.count() == sequences
    if sequences:
        first = seq.orderBy("ts_epoch").first()
        assert [first[f"seq_{i}"] for i in range(24)] == [i + 1.0 for i in range(24)]


def test_split_and_scaling(spark):
    f = features.forecast_features(hourly(spark, 24 * 150))
    train, test = features.time_split(f)
    assert len(test) == 1 and max(train) < min(test)
    with pytest.raises(ValueError):
        features.time_split(f.where(F.col("chunk_month") == F.lit(train[0])))
    seq = features.sequence_windows(hourly(spark, 100))
    scaled = np.array(features.scaled_sequences(seq).select(*(f"seq_{i}" for i in range(24))).collect())
    assert abs(scaled.mean()) < 1e-9 and scaled.std() == pytest.approx(1)
    test = features.scaled_sequences(seq.limit(1), fit_on=seq).first()
    assert test.seq_0 == pytest.approx((seq.limit(1).first().seq_0 - np.mean(seq.select(*(f"seq_{i}" for i in range(24))).collect())) / np.std(seq.select(*(f"seq_{i}" for i in range(24))).collect()))
    assert features.scaled_sequences(seq.limit(0)).count() == 0


def test_forecasts(spark, tmp_path):
    f = features.forecast_features(hourly(spark, 24 * 100)).cache()
    train, test = features.time_split(f)
    model = forecast.fit_forest(features.in_chunks(f, train), trees=10, depth=6)
    held = features.in_chunks(f, test)
    m = forecast.measures(model.transform(held)).first()
    assert m.r2 > 0.5 and m.n_test == held.count()
    weights = [r.importance for r in forecast.importances(model).collect()]
    assert sum(weights) == pytest.approx(1) and weights == sorted(weights, reverse=True)
    online = forecast.OnlineLinear(epochs=3).fit(features.in_chunks(f, train))
    want = forecast.measures(online.predict(held)).first()
    assert np.isfinite(want.rmse)
    online.save(spark, f"{tmp_path}/online")
    forecast.save_forest(model, f"{tmp_path}/forest")
    assert forecast.measures(forecast.OnlineLinear.load(spark, f"{tmp_path}/online").predict(held)).first() == want
    assert forecast.measures(forecast.PipelineModel.load(f"{tmp_path}/forest").transform(held)).first().r2 == pytest.approx(m.r2)


def test_online_model_is_the_serial_method_whatever_the_partitions(spark):
    f = features.forecast_features(hourly(spark, 24 * 100)).cache()
    names, target = list(forecast.FEATURES), forecast.TARGET
    got = forecast.OnlineLinear(epochs=2).fit(f)
    again = forecast.OnlineLinear(epochs=2).fit(f.repartition(7))
    assert got.weights == pytest.approx(again.weights, rel=1e-9)  # the scale is a sum of parts
    pdf = f.toPandas().sort_values(["chunk_month", *names, target])
    months = [m for _, m in pdf.groupby("chunk_month")]
    x0 = months[0][names].to_numpy(float)
    sd = np.where(x0.std(0) > 0, x0.std(0), 1)
    w, b, t = np.zeros(len(names)), 0.0, 0
    for _ in range(2):
        for m in months:
            x, y = (m[names].to_numpy(float) - x0.mean(0)) / sd, m[target].to_numpy(float)
            for i in np.random.default_rng(42).permutation(len(y)):
                t += 1
                e = 0.01 / t**0.25
                miss = x[i] @ w + b - y[i]
                g = np.sign(miss) if abs(miss) > 5 else 0.0
                w, b = w * (1 - e * 1e-4) - e * g * x[i], b - e * g
    assert got.weights == pytest.approx([*w, b])
    assert np.isfinite(forecast.OnlineLinear(epochs=1, rows_per_block=500).fit(f).weights).all()
    with pytest.raises(ValueError):
        forecast.OnlineLinear().fit(f.limit(0))


def test_density_of_long_chains_and_large_tables(spark):
    chain = np.array([[2.0**i] for i in range(300)] + [[-(2.0**i)] for i in range(300)])
    assert len(cluster.hdbscan_labels(chain, 2)) == 600
    nested = np.array([[float(i * i), float(k)] for i in range(400) for k in (0.0, 0.1)])
    assert cluster.hdbscan_labels(nested, 2).max() >= 1
    df = spark.range(50).select(F.col("id").cast("double").alias("a"))
    with pytest.raises(ValueError, match="50 rows"):
        cluster.sweep(df, "a", ("a",), most_rows=49)
    c = spark.createDataFrame([("b", 1), ("a", 1), ("z", None), ("c", 0)], "city string, cluster int")
    assert [r.city for r in cluster.listed(c, "city").collect()] == ["c", "a", "b", "z"]


def test_clusters(spark):
    rng = np.random.default_rng(0)
    rows = [(f"c{i}", *(float(x) for x in rng.normal(20 + 200 * (i % 2), 3, 4)), 10.0 + i % 3, 100.0, i % 12 + 1) for i in range(40)]
    df = spark.createDataFrame(rows, "city string, avg_pm2_5 double, avg_pm10 double, avg_o3 double, avg_no2 double, lat double, lon double, month int")
    for a in cluster.ALGORITHMS:
        _, _, k, value = cluster.fit(df, a, cluster.FEATURES[:4], (2, 3))
        assert k == 2 and value > 0.5
    s = cluster.sweep(df, "city", cluster.FEATURES[:4]).where("silhouette IS NOT NULL").orderBy(F.desc("silhouette")).first()
    assert s.n_clusters == 2 and s.silhouette > 0.8
    h = cluster.sweep(df, "city", cluster.FEATURES[:4], "hdbscan").orderBy(F.desc("silhouette")).first()
    assert h.n_clusters >= 2 and h.silhouette > 0.3


def test_dbscan_equals_the_local_one(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.4, (40, 2)) for c in ((0, 0), (5, 5), (0, 6))] + [rng.uniform(-3, 9, (20, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    got = {r.id: r.cluster for r in cluster.dbscan(df, "id", ("a", "b"), 0.6, 4).collect()}
    want = cluster.dbscan_labels(x, 0.6, 4)
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= 0.36
    core = near.sum(1) >= 4
    for i in range(len(x)):
        assert (got[i] is None) == (want[i] < 0)
        for j in np.flatnonzero(core):
            if core[i]:  # a border point may belong to either of two clusters
                assert (got[i] == got[j]) == (want[i] == want[j])


def test_station_choice(spark):
    cities = spark.createDataFrame([("Tỉnh A", "VN", 10.0, 100.0), ("A", "VN", 10.01, 100.0), ("B", "VN", 12.0, 100.0), ("C", "VN", 20.0, 100.0), ("X", "IN", 10.0, 100.0)], "name string, country string, lat double, lon double")
    kept = select_stations.dedup_by_distance(cities)
    assert {r.name for r in kept.collect()} == {"A", "B", "C", "X"}
    seeds = spark.createDataFrame([("VN", 10.0, 100.0)], "country string, lat double, lon double")
    got = select_stations.farthest_points(kept, 2, seeds).where("country = 'VN'").orderBy("turn").collect()
    assert [r.name for r in got] == ["C", "B"]  # A is next to the seed
    wanted = spark.createDataFrame([(1, "Tinh A", "VN"), (2, "b", "VN"), (3, "none", "VN")], "turn int, city string, country string")
    assert [(r.turn, r.lat) for r in select_stations.match_names(cities, wanted).collect()] == [(1, 10.0), (2, 12.0)]
    assert {(r.a, r.b) for r in collect.far_pairs(cities.where("country = 'VN'"), "name", 8.0, most=True).collect()} == {("A", "Tỉnh A")}


def test_stations_by_region(spark):
    shape = "name string, country string, lat double, lon double"
    rows = [("Tỉnh A", "VN", 10.0, 100.0), ("B", "VN", 12.0, 100.0), ("Huyện C", "VN", 15.0, 100.0), ("D", "VN", 20.0, 100.0), ("Delhj", "IN", 20.0, 80.0), ("Nowhere", "IN", None, 80.0), ("Seoul", "KR", 37.0, 127.0), ("Greater London", "GB", 51.0, 0.0), ("Bejing", "CN", 39.0, 116.0)]
    cities = spark.createDataFrame(rows, shape)
    seeds = spark.createDataFrame([("VN_HAN_01", "Hanoi", "VN", 21.0, 105.0), ("CN_BEJ_01", "Bejing", "CN", 39.0, 116.0), ("IN_DEL_03", "Delhi", "IN", 28.0, 77.0)], readings.STATION_SCHEMA)
    wanted = spark.createDataFrame([(1, "bejing", "CN"), (2, "London", "GB"), (3, "Paris", "FR"), (4, "Seoul", "KR")], "turn int, city string, country string")
    got = {r.station_id: r.city for r in select_stations.by_region(cities, seeds, {"VN": 3, "IN": 5}, wanted, 3, {"VN": 8.0}).collect()}
    assert got == {"VN_HAN_01": "Hanoi", "CN_BEJ_01": "Bejing", "IN_DEL_03": "Delhi", "VN_AXX_01": "A", "VN_DXX_01": "D", "IN_DEL_04": "Delhj", "GB_LON_01": "London", "KR_SEO_01": "Seoul"}
    assert select_stations.by_region(cities.limit(0), seeds, {"VN": 3}, wanted, 1).count() == 3


def test_requests_and_urls(spark, monkeypatch):
    work = spark.sql("SELECT 'A' AS station_id, 1.5D AS lat, 2.0D AS lon, DATE '2021-01-01' AS window_start, DATE '2021-04-01' AS window_end")
    (request,) = readings.history_requests(work)
    assert request == {"station_id": "A", "lat": 1.5, "lon": 2.0, "start": 1609459200, "end": 1617235200}
    monkeypatch.setenv("SOME_KEY", "k&1")
    call = readings.HttpTransport("http://host/air/", "SOME_KEY")
    assert call.url(request) == "http://host/air/history?lat=1.5&lon=2.0&start=1609459200&end=1617235200&appid=k%261"
    assert call.url(readings.current_request("A", 1.5, 2.0)) == "http://host/air?lat=1.5&lon=2.0&appid=k%261"


def test_sample_is_like_its_calibration():
    rows = list(readings.sample_records())
    own = [r for r in rows if r["station_id"] == "VN_HCM_01"]
    pm = np.array([r["components"]["pm2_5"] for r in own])
    assert 0.4 < np.log(pm).std() < 1.2 and 3 < np.median(pm) < 12
    no2 = [r["components"]["no2"] for r in own if r["components"]["no2"] > 0]
    assert np.median(no2) == pytest.approx(3.68, rel=0.1)
    assert {r["owm_aqi"] for r in rows} == {1, 2, 3, 4, 5}
    assert any(r["components"]["no2"] < 0 for r in rows) and any(None in r["components"].values() for r in rows)
    hours = {r["ts_epoch"] for r in own}
    missing = [t for t in range(min(hours), max(hours), 3600) if t not in hours]
    assert missing and len(missing) % 24 == 0
    assert len(rows) > len({(r["station_id"], r["ts_epoch"]) for r in rows})


def test_rollup_and_seasonality(spark):
    df = hourly(spark, 48).withColumns({"city": F.lit("a"), "country": F.lit("VN"), "dt": F.to_date(F.timestamp_seconds("ts_epoch"))})
    assert aggregate.rollup(df).count() == 5
    s = aggregate.seasonality(df).first()
    assert (s.month, s.n_hours, s.avg_pm2_5) == (1, 48, 1.0)
    assert aggregate.checksum(df).first().n_aqi == 48
    assert aggregate.summary(df, "aqi").count() == 8
