"""Choice of stations: too-near cities go, the rest are spread, names are matched."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

CITY = "name string, country string, lat double, lon double"


def _km(lat, lon, lats, lons) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lats)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * scalars.EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, h)))


def dedup_by_distance(cities: DataFrame, min_km: float = 8.0, last_prefix: str = "Tỉnh ") -> DataFrame:
    """Cities of each country kept in order if all kept ones are `min_km` away; names with
    the prefix come last, otherwise by name and place. What stays depends on what stayed
    before, so a country is one group (thousands of cities)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(late=pdf["name"].str.startswith(last_prefix)).sort_values(["late", "name", "lat", "lon"]).drop(columns="late")
        lat, lon = pdf["lat"].to_numpy(float), pdf["lon"].to_numpy(float)
        kept: list[int] = []
        for i in range(len(pdf)):
            if not kept or _km(lat[i], lon[i], lat[kept], lon[kept]).min() >= min_km:
                kept.append(i)
        return pdf.iloc[kept]

    return cities.select("name", "country", "lat", "lon").groupBy("country").applyInPandas(run, CITY)


def farthest_points(cities: DataFrame, n: int, seeds: DataFrame, near_km: float = 5.0) -> DataFrame:
    """Up to `n` cities per country, each the farthest from the seeds and those chosen
    before; cities within `near_km` of a seed are left out. `turn` is the order of choice."""
    known = seeds.select(F.col("country"), F.lit("").alias("name"), "lat", "lon", F.lit(True).alias("seed"))
    all_of = cities.select("country", "name", "lat", "lon", F.lit(False).alias("seed")).unionByName(known)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seed = pdf[pdf["seed"]]
        own = pdf[~pdf["seed"]].sort_values(["name", "lat", "lon"]).reset_index(drop=True)
        lat, lon = own["lat"].to_numpy(float), own["lon"].to_numpy(float)
        far = np.full(len(own), np.inf)
        for a, b in zip(seed["lat"], seed["lon"], strict=True):
            far = np.minimum(far, _km(a, b, lat, lon))
        far[far < near_km] = -1
        chosen: list[int] = []
        while len(chosen) < n and len(own):
            i = int(np.argmax(far))
            if far[i] < 0:
                break
            chosen.append(i)
            far = np.where(far < 0, far, np.minimum(far, _km(lat[i], lon[i], lat, lon)))
            far[i] = -1
        return own.iloc[chosen][["name", "country", "lat", "lon"]].assign(turn=np.arange(1, len(chosen) + 1, dtype="int32"))

    return all_of.groupBy("country").applyInPandas(run, CITY + ", turn int")


def match_names(cities: DataFrame, wanted: DataFrame, limit: int | None = None) -> DataFrame:
    """Wanted (turn, city, country) with the place of the city of that folded name, else of
    the first whose folded name holds it."""
    fold = lambda c: F.lower(scalars.ascii_fold(F.col(c)))
    w = F.broadcast(wanted.withColumn("target", fold("city")))  # a list written by hand
    have = cities.select("name", F.col("country").alias("c"), "lat", "lon").withColumn("folded", fold("name"))
    j = have.join(w, (F.col("c") == F.col("country")) & F.contains("folded", F.col("target")))
    rank = F.row_number().over(Window.partitionBy("turn").orderBy(F.col("folded") != F.col("target"), "name", "lat", "lon"))
    out = j.withColumn("n", rank).where("n = 1").select("turn", "city", "country", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon")).orderBy("turn")
    return out.limit(limit) if limit else out


# How a name of no station begins; it is matched whatever its case.
NO_STATION = ("Socialist Republic", "Xóm ", "Ấp ", "Thôn ", "Huyện ", "Huyen ", "Thị xã ", "Thi xa ")


def by_region(cities: DataFrame, seeds: DataFrame, spread: dict[str, int], wanted: DataFrame, most_wanted: int, min_km: dict[str, float] | None = None, prefix: str = "Tỉnh ") -> DataFrame:
    """Stations of a network: the seeds (station_id, city, country, lat, lon), then cities
    spread over each country of `spread` until it has that many with its seeds, then wanted
    (turn, city, country) ones elsewhere, at most `most_wanted` with the seeds elsewhere.

    Countries with a `min_km` first lose names of no station and cities nearer to each other.
    A wanted city that is a seed or that no city is named like is left out. Ids go on after
    the seeds' running numbers. Returns (station_id, city, country, lat, lon)."""
    min_km = min_km or {}
    # the seeds are a list written by hand, as are wanted
    given = {r.country: r.n for r in seeds.groupBy("country").agg(F.count("*").alias("n")).collect()}
    picked = None
    for order, (country, target) in enumerate(sorted(spread.items())):
        own = cities.where((F.col("country") == country) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
        if country in min_km:
            own = dedup_by_distance(own.where(~scalars.is_junk_name(F.col("name"), NO_STATION)), min_km[country], prefix)
        left = max(0, target - given.get(country, 0))
        far = farthest_points(own, left, seeds.where(F.col("country") == country).select("country", "lat", "lon"))
        far = far.select(F.trim(F.replace("name", F.lit(prefix), F.lit(""))).alias("city"), "country", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.lit(order).alias("part"), "turn")
        picked = far if picked is None else picked.unionByName(far)
    elsewhere = sum(n for c, n in given.items() if c not in spread)
    named = seeds.select(F.lower("city").alias("city"), "country")
    new = wanted.withColumn("__low", F.lower("city")).join(F.broadcast(named.withColumnRenamed("city", "__low")), ["__low", "country"], "left_anti")
    others = match_names(cities, new.select("turn", "city", "country"), max(1, most_wanted - elsewhere)).select("city", "country", "lat", "lon", F.lit(len(spread)).alias("part"), "turn")
    if most_wanted <= elsewhere:
        others = others.limit(0)
    chosen = others if picked is None else picked.unionByName(others)
    code = F.regexp_replace("station_id", "_[0-9]+$", "")
    used = seeds.groupBy(code.alias("__code")).agg(F.max(F.regexp_extract("station_id", "([0-9]+)$", 1).cast("int")).alias("__used"))
    coded = chosen.withColumn("__code", scalars.station_code(F.col("city"), F.col("country"))).join(F.broadcast(used), "__code", "left")
    number = F.row_number().over(Window.partitionBy("__code").orderBy("part", "turn")) + F.coalesce("__used", F.lit(0))
    out = coded.select(F.concat_ws("_", "__code", F.lpad(number.cast("string"), 2, "0")).alias("station_id"), "city", "country", "lat", "lon")
    return seeds.select("station_id", "city", "country", "lat", "lon").unionByName(out)
