"""Clusters of features and of examples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Feature matrices are features x features and live on the driver up to this many features.
MAX_FEATURES = 8192


def matrix(pairs: DataFrame, value: str, features: list[int], diagonal: float) -> np.ndarray:
    """The symmetric matrix of a pair table (x, y, value)."""
    if len(features) > MAX_FEATURES:
        raise ValueError(f"{len(features)} features; select at most {MAX_FEATURES} before clustering")
    at = {f: i for i, f in enumerate(features)}
    out = np.full((len(features), len(features)), diagonal if value == "distance" else 0.0)
    out[:] = 1.0 if value == "distance" else 0.0
    np.fill_diagonal(out, diagonal)
    for r in pairs.select("x", "y", value).toLocalIterator():
        if r["x"] in at and r["y"] in at:
            out[at[r["x"]], at[r["y"]]] = out[at[r["y"]], at[r["x"]]] = r[value]
    return out


def average_linkage(distance: np.ndarray, k: int) -> np.ndarray:
    """Labels after merging the two nearest clusters (mean distance) until k are left."""
    n = len(distance)
    d, size, alive = distance.astype(float).copy(), np.ones(n), np.ones(n, bool)
    np.fill_diagonal(d, np.inf)
    labels = np.arange(n)
    for _ in range(n - max(1, min(k, n))):
        i, j = divmod(int(np.argmin(np.where(alive[:, None] & alive[None, :], d, np.inf))), n)
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        size[i] += size[j]
        alive[j] = False
        labels[labels == j] = i
    return np.unique(labels, return_inverse=True)[1]


def communities(weight: np.ndarray, resolution: float = 1.0, knn: int = 0, min_size: int = 1) -> np.ndarray:
    """Modularity communities of a weighted graph by local moves and aggregation.

    ``knn`` keeps each node's strongest edges (either way); communities under ``min_size`` join the one they
    are tied to most.
    """
    w = weight.astype(float).copy()
    np.fill_diagonal(w, 0)
    if knn:
        keep = np.zeros_like(w, bool)
        top = np.argsort(-w, axis=1, kind="stable")[:, :knn]
        keep[np.arange(len(w))[:, None], top] = True
        w = np.where(keep | keep.T, w, 0)
    labels = np.arange(len(w))
    graph = w
    while True:
        n = len(graph)
        own, degree = np.arange(n), graph.sum(axis=1)
        total = degree.sum()
        if total <= 0:
            break
        mass = degree.copy()
        moved = improved = True
        improved = False
        while moved:
            moved = False
            for i in range(n):
                mass[own[i]] -= degree[i]
                ties = np.bincount(own, graph[i] * (np.arange(n) != i), n)
                gain = ties - resolution * degree[i] * mass / total
                best = int(np.argmax(gain))
                if gain[best] > gain[own[i]] + 1e-12:
                    own[i], moved, improved = best, True, True
                mass[own[i]] += degree[i]
        _, own = np.unique(own, return_inverse=True)
        labels = own[labels]
        if not improved or own.max() + 1 == n:
            break
        member = np.eye(own.max() + 1)[own]
        graph = member.T @ graph @ member
    sizes = np.bincount(labels)
    if min_size > 1 and (sizes >= min_size).any():
        for small in np.flatnonzero(sizes < min_size):
            rows = labels == small
            ties = np.bincount(labels, w[rows].sum(axis=0), len(sizes))
            ties[sizes < min_size] = -1
            labels[rows] = int(np.argmax(ties))
    return np.unique(labels, return_inverse=True)[1]


def spherical_kmeans(points: np.ndarray, k: int, seed: int = 0, restarts: int = 10, steps: int = 100) -> np.ndarray:
    """k-means of unit rows by cosine; the best of several restarts."""
    x = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    k = max(1, min(k, len(x)))
    rng, best, out = np.random.default_rng(seed), -np.inf, np.zeros(len(x), int)
    for _ in range(restarts):
        centre = x[rng.choice(len(x), k, replace=False)]
        for _ in range(steps):
            labels = np.argmax(x @ centre.T, axis=1)
            new = np.stack([x[labels == c].sum(axis=0) if (labels == c).any() else centre[c] for c in range(k)])
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
            if np.allclose(new, centre):
                break
            centre = new
        score = float(np.max(x @ centre.T, axis=1).sum())
        if score > best:
            best, out = score, labels
    return out


def cluster_features(codes: DataFrame, n_rows: int, method: str = "agglomerative", n_clusters: int = 10, key: str = "battle_id", **options) -> DataFrame:
    """feature_id, cluster_id: by mutual information communities, cosine k-means or average linkage."""
    from . import elicit

    features = sorted(r[0] for r in codes.select("feature_id").distinct().collect())
    spark = codes.sparkSession
    if not features:
        return spark.createDataFrame([], "feature_id int, cluster_id int")
    if method == "mi-leiden":
        labels = communities(matrix(elicit.mutual_information(codes, n_rows, key), "mi", features, 0.0), **options)
    elif method == "agglomerative":
        labels = average_linkage(matrix(elicit.distance(codes, n_rows, key), "distance", features, 0.0), n_clusters)
    elif method == "spherical-kmeans":
        labels = spherical_kmeans(1 - matrix(elicit.distance(codes, n_rows, key), "distance", features, 0.0), n_clusters, **options)
    else:
        raise ValueError(f"unknown method {method!r}: use mi-leiden, agglomerative or spherical-kmeans")
    return spark.createDataFrame([(f, int(c)) for f, c in zip(features, labels, strict=True)], "feature_id int, cluster_id int")


def cluster_examples(vectors: DataFrame, vector: str = "vector", k: int = 10, seed: int = 0) -> DataFrame:
    """Clusters of rows by cosine k-means; zero vectors (no direction) get a null cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    zero = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x) <= 0
    rest = vectors.filter(~zero).withColumn("_v", array_to_vector(vector))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="_v", predictionCol="cluster_id").fit(rest)
    found = model.transform(rest).drop("_v")
    return found.unionByName(vectors.filter(zero).withColumn("cluster_id", F.lit(None).cast("int")))


def summarize(clusters: DataFrame, names: DataFrame) -> DataFrame:
    """Per cluster: size, verified members, and the concept of the most faithful verified member.

    Lists hold features of one cluster, a table the size of the lens.
    """
    ok = F.coalesce(F.col("fidelity_pass"), F.lit(False)) if "fidelity_pass" in names.columns else F.lit(True)
    trust = F.coalesce(F.col("correlation"), F.lit(0.0)) if "correlation" in names.columns else F.lit(0.0)
    full = clusters.join(names, "feature_id", "left").withColumns({"ok": ok, "trust": trust})
    behaviour = F.min(F.when(F.col("ok") & F.col("concept").isNotNull(), F.struct((-F.col("trust")).alias("t"), "feature_id", "concept")))
    members = F.sort_array(F.collect_list("feature_id"))
    concepts = F.transform(F.sort_array(F.collect_list(F.struct("feature_id", "concept"))), lambda x: x["concept"])
    return full.groupBy("cluster_id").agg(
        F.count("*").alias("n_features"), F.count_if(F.col("ok")).alias("n_verified"),
        F.coalesce(behaviour["concept"], F.min_by("concept", "feature_id"), F.concat(F.lit("cluster "), F.first("cluster_id").cast("string"))).alias("behavior"),
        F.array_join(F.transform(members, lambda x: x.cast("string")), ",").alias("feature_ids"),
        F.array_join(F.slice(F.filter(concepts, lambda x: x.isNotNull()), 1, 8), " | ").alias("member_concepts"),
    )
