"""Clustering: scaling, choice of k, three MLlib algorithms, DBSCAN, HDBSCAN."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("avg_pm2_5", "avg_pm10", "avg_o3", "avg_no2", "lat", "lon", "month")
ALGORITHMS: dict[str, Callable] = {
    "kmeans": lambda k: KMeans(k=k, seed=42, featuresCol="features"),
    "gmm": lambda k: GaussianMixture(k=k, seed=42, featuresCol="features"),
    "bisecting_kmeans": lambda k: BisectingKMeans(k=k, seed=42, featuresCol="features"),
}


def scaled(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """`df` with features: divided by their deviation, not centred."""
    d = df.na.drop(subset=list(features))
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=False, withStd=True)]
    return Pipeline(stages=stages).fit(d).transform(d)


def pick_k(ready: DataFrame, algorithm: str, ks: Sequence[int] = (2, 3, 4, 5, 6)):
    """(k, model, silhouette) of the best silhouette (squared Euclidean); a k that can't be
    fitted, or is not below the number of rows, is left out."""
    n, best = ready.count(), None
    judge = ClusteringEvaluator(featuresCol="features")
    for k in ks:
        if k >= n:
            continue
        try:
            model = ALGORITHMS[algorithm](k).fit(ready)
            value = judge.evaluate(model.transform(ready))
        except Exception as e:  # noqa: BLE001  an algorithm may fail at one k
            print(f"{algorithm} k={k}: {str(e)[:120]}")
            continue
        if np.isfinite(value) and (best is None or value > best[2]):
            best = (k, model, value)
    if best is None:
        raise ValueError("no k could be fitted")
    return best


def fit(df: DataFrame, algorithm: str = "kmeans", features: Sequence[str] = FEATURES, ks: Sequence[int] = (2, 3, 4, 5, 6)):
    """(df with prediction, model, k, silhouette)."""
    ready = scaled(df, features).cache()
    try:
        k, model, value = pick_k(ready, algorithm, ks)
        return model.transform(ready), model, k, value
    finally:
        ready.unpersist()


def tournament(df: DataFrame, features: Sequence[str] = FEATURES, ks: Sequence[int] = (2, 3, 4, 5, 6)) -> tuple[str, dict]:
    """Name of the algorithm with the best silhouette, and every algorithm's result."""
    found = {a: fit(df, a, features, ks) for a in ALGORITHMS}
    return max(found, key=lambda a: found[a][3]), found


def dbscan(points: DataFrame, key: str, features: Sequence[str], eps: float, min_samples: int) -> DataFrame:
    """`points` (key, features) with cluster, the smallest core key of it, or null for noise.

    Pairs are found in a grid of `eps` cells over the first two features, each point copied
    to the neighbouring cells; core points that are near each other are joined by labels
    that sink until they are stable; a border point takes its smallest core neighbour's."""
    spark = points.sparkSession
    cells = [F.floor(F.col(c) / eps) for c in features[:2]]
    p = points.select(F.col(key).alias("id"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), *(c.alias(f"c{i}") for i, c in enumerate(cells)))
    other = p.select(F.col("id").alias("id2"), *(F.col(f"x{i}").alias(f"y{i}") for i in range(len(features))), *(F.explode(F.sequence(F.col(f"c{i}") - 1, F.col(f"c{i}") + 1)).alias(f"c{i}") if i == 0 else F.col(f"c{i}") for i in range(len(cells))))
    if len(cells) > 1:
        other = other.withColumn("c1", F.explode(F.sequence(F.col("c1") - 1, F.col("c1") + 1)))
    square = sum(((F.col(f"x{i}") - F.col(f"y{i}")) * (F.col(f"x{i}") - F.col(f"y{i}")) for i in range(1, len(features))), (F.col("x0") - F.col("y0")) * (F.col("x0") - F.col("y0")))
    near = p.join(other, [f"c{i}" for i in range(len(cells))]).where(square <= eps * eps).select("id", "id2").persist()
    core = near.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select("id").persist()
    edges = near.join(core, "id").join(core.select(F.col("id").alias("id2")), "id2").persist()
    labels = core.withColumn("cluster", F.col("id"))
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    cut = (lambda d: d.checkpoint()) if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else (lambda d: d.persist())
    while True:
        around = edges.join(labels.select(F.col("id").alias("id2"), F.col("cluster").alias("c")), "id2").groupBy("id").agg(F.min("c").alias("c"))
        sunk = labels.join(around, "id").select("id", "cluster", F.least("cluster", "c").alias("c"))
        # a label's own label: chains halve each round
        up = sunk.select(F.col("id").alias("c"), F.col("c").alias("up"))
        sunk = cut(sunk.join(up, "c", "left").select("id", F.col("cluster").alias("old"), F.coalesce("up", "c").alias("cluster")))
        labels = sunk.select("id", "cluster")
        if sunk.where("old <> cluster").isEmpty():
            break
    border = near.join(labels.select(F.col("id").alias("id2"), "cluster"), "id2").groupBy("id").agg(F.min("cluster").alias("b"))
    out = p.select("id").join(labels, "id", "left").join(border, "id", "left").select(F.col("id").alias(key), F.coalesce("cluster", "b").alias("cluster"))
    return points.join(out, key, "left")


def distances(x: np.ndarray, square: bool = False) -> np.ndarray:
    """All distances, a feature after another: one n x n table beside the result."""
    out = np.zeros((len(x), len(x)))
    for c in x.T:
        out += (c[:, None] - c[None]) ** 2
    return out if square else np.sqrt(out, out=out)


def silhouette(points: np.ndarray, labels: np.ndarray) -> float | None:
    """Mean silhouette (Euclidean) without noise (-1); null with fewer than two clusters."""
    keep = labels >= 0
    x, y = points[keep], labels[keep]
    names = np.unique(y)
    if len(names) < 2 or len(names) >= len(y):
        return None
    d = distances(x)
    to = np.stack([d[:, y == c].sum(1) for c in names], 1)
    size = np.array([(y == c).sum() for c in names])
    own = np.searchsorted(names, y)
    rows = np.arange(len(y))
    a = to[rows, own] / np.maximum(size[own] - 1, 1)
    mean = to / size
    mean[rows, own] = np.inf
    b = mean.min(1)
    s = np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)
    return float(s.mean())


def dbscan_labels(points: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    near = distances(points, square=True) <= eps * eps
    core = near.sum(1) >= min_samples
    labels = np.full(len(points), -1)
    for i in np.flatnonzero(core):
        if labels[i] < 0:
            name = labels.max() + 1
            todo = [i]
            labels[i] = name
            while todo:
                for j in np.flatnonzero(near[todo.pop()]):
                    if labels[j] < 0:
                        labels[j] = name
                        if core[j]:
                            todo.append(j)
    return labels


def hdbscan_labels(points: np.ndarray, min_cluster_size: int) -> np.ndarray:
    """Labels by the excess of mass of the condensed tree over mutual reachability."""
    n = len(points)
    if n < 2:
        return np.full(n, -1)
    d = distances(points)
    core = np.sort(d, 1)[:, min(min_cluster_size, n) - 1]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    inside, best, link = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    edges, at = [], 0
    inside[0] = True
    for _ in range(n - 1):  # a spanning tree, grown from one point
        closer = reach[at] < best
        best[closer], link[closer] = reach[at][closer], at
        best[inside] = np.inf
        at = int(np.argmin(best))
        edges.append((best[at], link[at], at))
        inside[at] = True
    parent = list(range(2 * n - 1))
    top = list(range(n))
    kids, height, size = {}, {}, {i: 1 for i in range(n)}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (h, a, b) in enumerate(sorted(edges)):
        ra, rb, new = root(a), root(b), n + k
        kids[top[ra] if ra < n else ra], kids[new] = kids.get(top[ra] if ra < n else ra, ()), (ra, rb)
        height[new], size[new] = h, size[ra] + size[rb]
        parent[ra] = parent[rb] = new

    def points_of(node: int) -> list[int]:
        todo, out = [node], []
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo.extend(kids[x])
        return out

    lam = lambda h: 1 / max(h, 1e-12)
    clusters: dict[int, dict] = {}

    # clusters of the condensed tree, each after its parent: its rows, mass and child clusters
    todo = [(2 * n - 2, lam(height[2 * n - 2]), None)]
    while todo:
        x, born, parent_name = todo.pop()
        name = len(clusters)
        own = clusters[name] = {"rows": points_of(x), "kids": [], "mass": 0.0}
        if parent_name is not None:
            clusters[parent_name]["kids"].append(name)
        while x >= n:
            big = [c for c in kids[x] if size[c] >= min_cluster_size]
            here = lam(height[x])
            if len(big) == 2:
                own["mass"] += (here - born) * size[x]
                todo += [(c, here, name) for c in reversed(big)]
                break
            own["mass"] += (here - born) * sum(size[c] for c in kids[x] if c not in big)
            if not big:
                break
            x = big[0]

    chosen: set[int] = set()
    worth: dict[int, float] = {}
    for c in reversed(range(len(clusters))):  # children before their parents
        worth[c] = sum(worth[k] for k in clusters[c]["kids"])
        if c != 0 and clusters[c]["mass"] >= worth[c]:
            stack = list(clusters[c]["kids"])
            while stack:
                k = stack.pop()
                chosen.discard(k)
                stack.extend(clusters[k]["kids"])
            chosen.add(c)
            worth[c] = clusters[c]["mass"]
    labels = np.full(n, -1)
    for name, c in enumerate(sorted(chosen)):
        labels[clusters[c]["rows"]] = name
    return labels


def sweep(df: DataFrame, key: str, features: Sequence[str], kind: str = "dbscan", eps=(0.5, 1.0, 1.5, 2.0, 2.5, 3.0), min_samples=(2, 3, 4), min_cluster_size=(2, 3, 4, 5), most_rows: int = 8_000) -> DataFrame:
    """Every setting's clusters, noise and silhouette: a row per setting. Settings run in
    parallel, each over the same standardised table (city months: thousands of rows), whose
    distances a task holds at once: more than `most_rows` rows are refused, not cut. Use
    `dbscan`, which is distributed, for larger ones."""
    spark = df.sparkSession
    rows = df.select(*features).na.drop()
    n = rows.count()
    if n > most_rows:
        raise ValueError(f"a sweep compares all pairs of rows in memory: {n} rows are more than {most_rows}")
    sent = spark.sparkContext.broadcast(rows.toPandas().to_numpy(float))
    grid = [(e, m) for e in eps for m in min_samples] if kind == "dbscan" else [(float("nan"), m) for m in min_cluster_size]

    def run(pdfs):
        x = sent.value
        sd = x.std(0)
        x = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
        for pdf in pdfs:
            rows = []
            for e, m in zip(pdf["eps"], pdf["size"], strict=True):
                y = dbscan_labels(x, e, m) if kind == "dbscan" else hdbscan_labels(x, m)
                rows.append((e, m, int(y.max() + 1), int((y < 0).sum()), silhouette(x, y)))
            yield pd.DataFrame(rows, columns=["eps", "size", "n_clusters", "n_noise", "silhouette"])

    settings = spark.createDataFrame(grid, "eps double, size int").repartition(len(grid))
    return settings.mapInPandas(run, "eps double, size int, n_clusters int, n_noise int, silhouette double")


def listed(clustered: DataFrame, *columns: str, cluster: str = "cluster") -> DataFrame:
    """The listing of a clustering: by cluster (noise last), then by the given columns."""
    return clustered.select(*columns, cluster).orderBy(F.asc_nulls_last(cluster), *columns)
