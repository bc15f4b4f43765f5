"""Joins of irregular access: gathers, frontiers, upserts, relabelling, nearest centroids and periodic neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import minimum_image, squared_distance


def gather(df: DataFrame, index: str, state: DataFrame, node: str = "node") -> DataFrame:
    """df with the state of the node that index names; rows without one go."""
    return df.join(state.withColumnRenamed(node, index), index)


def masked_gather(df: DataFrame, mask: Column, index: str, state: DataFrame, value: str, default: Column, node: str = "node") -> DataFrame:
    """df with value: the state's where mask holds and the node exists, else default."""
    held = state.select(F.col(node).alias("__node"), F.col(value).alias("__value"))
    rows = df.join(held, mask & (F.col(index) == F.col("__node")), "left")
    return rows.select(*(F.col(f"`{c}`") for c in df.columns if c != value), F.coalesce("__value", default).alias(value))


def expand_frontier(edges: DataFrame, frontier: DataFrame, src: str = "src", node: str = "node") -> DataFrame:
    """The edges that leave the frontier's nodes, with what the frontier holds; each node once, however often it is listed."""
    return edges.join(frontier.dropDuplicates([node]).withColumnRenamed(node, src), src)


def upsert(state: DataFrame, updates: DataFrame, key: str, value: str) -> DataFrame:
    """state with the value of updates where that has the key."""
    new = updates.select(key, F.col(value).alias("__new"))
    return state.join(new, key, "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def relabel(edges: DataFrame, permutation: DataFrame, ends: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """edges with both ends renamed by (old_id, new_id)."""
    out = edges
    for end in ends:
        new = permutation.select(F.col("old_id").alias("__old"), F.col("new_id").alias("__new"))
        out = out.join(new, F.col(end) == F.col("__old")).withColumn(end, F.col("__new")).drop("__old", "__new")
    return out


def reposition(rows: DataFrame, permutation: DataFrame, node: str = "node", inverse: bool = False) -> DataFrame:
    """rows moved to their new ids; inverse moves them back."""
    old, new = ("new_id", "old_id") if inverse else ("old_id", "new_id")
    return relabel(rows, permutation.select(F.col(old).alias("old_id"), F.col(new).alias("new_id")), (node,))  # type: ignore[arg-type]


def pair_delta(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """(keys, change): kept, removed or added, between two sets of pairs."""
    both = old.select(*keys, F.lit(1).alias("change")).unionByName(new.select(*keys, F.lit(2).alias("change"))).distinct()
    total = both.groupBy(*keys).agg(F.sum("change").alias("n"))
    return total.select(*keys, F.element_at(F.array(F.lit("removed"), F.lit("added"), F.lit("kept")), F.col("n").cast("int")).alias("change"))


def nearest_centroid(points: DataFrame, centroids: list[tuple[int, list[float]]], vector: str = "embedding") -> DataFrame:
    """points with cid and distance of the nearest of some centroids, ties to the smallest cid.

    The centroids are part of the expression: k of them are compared in each row, with no join.
    """
    from ..functions.scalar import vector_distance

    ways = [F.struct(vector_distance(F.col(vector), F.array(*(F.lit(float(x)) for x in v))).alias("distance"), F.lit(c).alias("cid")) for c, v in centroids]
    best = F.array_min(F.array(*ways))
    return points.withColumn("__best", best).withColumn("cid", F.col("__best.cid")).withColumn("distance", F.col("__best.distance")).drop("__best")


def _near(pairs: DataFrame, side: float, radius: float) -> DataFrame:
    deltas = [minimum_image(F.col(f"{a}1") - F.col(f"{a}2"), side) for a in "xyz"]
    return pairs.withColumn("rd", squared_distance(*deltas)).filter(F.col("rd") <= radius * radius).select("i", "j")


def all_near_pairs(particles: DataFrame, side: float, radius: float) -> DataFrame:
    """(i, j), i < j, within the radius in the periodic box, by comparing all: for small sets and tests."""
    a = particles.select(F.col("id").alias("i"), *(F.col(c).alias(f"{c}1") for c in "xyz"))
    b = particles.select(F.col("id").alias("j"), *(F.col(c).alias(f"{c}2") for c in "xyz"))
    return _near(a.join(b, F.col("i") < F.col("j")), side, radius)


def near_pairs(particles: DataFrame, side: float, radius: float) -> DataFrame:
    """(i, j), i < j, within the radius in the periodic box: an equi-join on cells at least a radius wide, each particle with its 27 wrapped cells, those that coincide once."""
    cells = max(1, math.floor(side / radius))
    cell = {a: F.least(F.greatest(F.floor(F.col(a) * (cells / side)), F.lit(0)), F.lit(cells - 1)) for a in "xyz"}
    number = lambda x, y, z: (F.pmod(x, F.lit(cells)) * cells + F.pmod(y, F.lit(cells))) * cells + F.pmod(z, F.lit(cells))
    shifts = (-1, 0, 1)
    around = F.array_distinct(F.array(*(number(cell["x"] + p, cell["y"] + q, cell["z"] + r) for p in shifts for q in shifts for r in shifts)))
    a = particles.select(F.col("id").alias("i"), *(F.col(c).alias(f"{c}1") for c in "xyz"), number(*(cell[c] for c in "xyz")).alias("cell"))
    b = particles.select(F.col("id").alias("j"), *(F.col(c).alias(f"{c}2") for c in "xyz"), F.explode(around).alias("cell"))
    return _near(a.join(b, "cell").filter("i < j"), side, radius)
