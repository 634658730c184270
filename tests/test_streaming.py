from __future__ import annotations

import json

from pyspark.sql import functions as F

from aerolith.operators import clean
from aerolith.sources import readings
from aerolith.streaming import live


def test_stream_equals_batch_and_keeps_dead_letters(spark, tmp_path):
    rows = [r | {"ingest_mode": "live"} for r in readings.sample_records(seed=5, hours=60)]
    rows.sort(key=lambda r: r["ts_epoch"])
    cut = len(rows) // 2
    source, store = tmp_path / "in", f"{tmp_path}/store"
    source.mkdir()
    (source / "a.txt").write_text("\n".join([*(json.dumps(r) for r in rows[:cut]), "not a record", '{"city": "no key"}']))
    for q in live.start(spark, str(source), store):
        q.awaitTermination()
        assert q.exception() is None
    (source / "b.txt").write_text("\n".join(json.dumps(r) for r in rows[cut - 5 :]))  # five come again
    for q in live.start(spark, str(source), store):
        q.awaitTermination()
    assert spark.read.json(f"{store}/dead").count() == 2
    assert spark.read.text(f"{store}/raw/ingest_mode=live").count() == len(rows) + 7
    columns = ["station_id", "ts_epoch", "aqi", "aqi_level", "dominant_pollutant", "row_key"]
    flat = readings.flat(spark.createDataFrame(rows, readings.T._parse_datatype_string(readings.RAW_SCHEMA)))
    want = live.index(clean.clip(clean.dedup(flat))).select(*columns)
    got = spark.read.parquet(f"{store}/aqi").select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_upsert_is_idempotent(spark, tmp_path):
    rows = [r | {"ingest_mode": "live"} for r in readings.sample_records(seed=6, hours=30)]
    flat = clean.clip(clean.dedup(readings.flat(spark.createDataFrame(rows, readings.T._parse_datatype_string(readings.RAW_SCHEMA)))))
    put = live.upsert(f"{tmp_path}/s")
    put(flat, 0)
    first = sorted(map(str, spark.read.parquet(f"{tmp_path}/s/aqi").collect()))
    put(flat, 0)
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/s/aqi").collect())) == first
    put(flat.limit(0), 1)
    assert spark.read.parquet(f"{tmp_path}/s/readings").count() == flat.count()
    assert flat.agg(F.count("*")).first()[0] > 0


def test_a_job_lost_while_it_wrote_is_repaired(spark, tmp_path):
    rows = [r | {"ingest_mode": "live"} for r in readings.sample_records(seed=6, hours=30)]
    flat = clean.clip(clean.dedup(readings.flat(spark.createDataFrame(rows, readings.T._parse_datatype_string(readings.RAW_SCHEMA)))))
    store = f"{tmp_path}/s"
    put = live.upsert(store)
    put(flat, 0)
    want = {t: sorted(map(str, spark.read.parquet(f"{store}/{t}").collect())) for t in ("readings", "aqi")}
    dates = [r.dt for r in spark.read.parquet(f"{store}/readings").select("dt").distinct().collect()]
    spark.read.parquet(f"{store}/readings").write.parquet(f"{store}/_redo/readings")  # the log was whole
    live._drop(spark, f"{store}/readings/dt={dates[0]}")  # the table was not
    spark.range(3).write.parquet(f"{store}/_redo/aqi")
    live._drop(spark, f"{store}/_redo/aqi/_SUCCESS")  # this log was not, so its table was not touched
    put(flat.limit(0), 1)
    assert {t: sorted(map(str, spark.read.parquet(f"{store}/{t}").collect())) for t in want} == want
    assert not live._exists(spark, f"{store}/_redo/readings") and not live._exists(spark, f"{store}/_redo/aqi")


def test_messages_are_keyed_by_station(spark):
    df = spark.createDataFrame([("a", 1, None)], "station_id string, ts_epoch long, pm2_5 double")
    assert live.messages(df).first().asDict() == {"key": "a", "value": '{"station_id":"a","ts_epoch":1,"pm2_5":null}'}
