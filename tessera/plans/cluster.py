"""K-means by assignment and accumulation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import nearest_centroid


def lowest_ids(points: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> list[tuple[int, list[float]]]:
    """The vectors of the k smallest ids as centroids 0 to k - 1."""
    rows = points.select(key, vector).orderBy(key).limit(k).collect()
    return [(i, list(r[vector])) for i, r in enumerate(rows)]


def kmeans_pass(points: DataFrame, centroids: list[tuple[int, list[float]]], vector: str = "embedding", dims: int = 3) -> DataFrame:
    """(cid, sum_1 to sum_dims, n, total) of one pass: coordinate sums of the points nearest each centroid, their count and total distance."""
    rows = nearest_centroid(points, centroids, vector)
    return rows.groupBy("cid").agg(*(F.sum(F.col(vector)[i].cast("double")).alias(f"sum_{i + 1}") for i in range(dims)), F.count("*").alias("n"), F.sum("distance").alias("total"))


def kmeans(points: DataFrame, k: int, rounds: int, key: str = "vec_id", vector: str = "embedding") -> list[tuple[int, list[float]]]:
    """Centroids after so many rounds; one that no point is nearest to stays where it is."""
    centroids = lowest_ids(points, k, key, vector)
    dims = len(centroids[0][1]) if centroids else 0
    for _ in range(rounds if dims else 0):
        found = {r["cid"]: [r[f"sum_{i + 1}"] / r["n"] for i in range(dims)] for r in kmeans_pass(points, centroids, vector, dims).collect()}
        centroids = [(c, found.get(c, v)) for c, v in centroids]
    return centroids
