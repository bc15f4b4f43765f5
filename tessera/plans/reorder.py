"""Relabellings of nodes: each gives (old_id, new_id), a bijection."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import uniform
from ..operators.joins import relabel
from ..operators.windows import degree_order, numbered
from .fixpoint import cut
from .graphs import nodes_of


def identity(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node").alias("old_id"), F.col("node").alias("new_id"))


def recursive_bisection(points: DataFrame, levels: int, axes: tuple[str, ...] = ("x", "y", "z"), key: str = "id") -> DataFrame:
    """Points cut at the middle along one axis after the other, part by part; the new order is that of the last sort. Each level is one range-partitioned sort, however large a part."""
    n = points.count()
    rows = points.select(key, *axes).withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(n).cast("long")).withColumn("new_id", F.col(key).cast("long"))
    for level in range(levels):
        turn = [axes[(level + i) % len(axes)] for i in range(len(axes))]
        rows = cut(numbered(rows.drop("new_id"), "low", *turn, key, name="new_id"))
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        rows = rows.select(key, *axes, "new_id", F.when(F.col("new_id") < middle, F.col("low")).otherwise(middle).alias("low"), F.when(F.col("new_id") < middle, middle).otherwise(F.col("high")).alias("high"))
    return rows.select(F.col(key).alias("old_id"), "new_id")


def first_touch(edges: DataFrame, nodes: DataFrame | None = None, position: str = "pos") -> DataFrame:
    """Nodes in the order in which edges first name them, source before target; nodes without edges come last, by number."""
    touched = edges.select(F.posexplode(F.array("src", "dst")).alias("side", "node"), position).groupBy("node").agg(F.min(F.col(position) * 2 + F.col("side")).alias("at"))
    if nodes is not None:
        touched = nodes.select("node").join(touched, "node", "left")
    return numbered(touched, F.col("at").asc_nulls_last(), "node", name="new_id").select(F.col("node").alias("old_id"), "new_id")


def breadth_first(edges: DataFrame, nodes: DataFrame | None = None, position: str = "pos", reverse: bool = True) -> DataFrame:
    """Nodes in the order of a queue that starts at the smallest and takes targets in the order of edges, starting anew at the smallest node left; reversed unless told otherwise. A level is one round."""
    left = cut(nodes_of(edges) if nodes is None else nodes.select("node"))
    edges, n, taken = cut(edges.select("src", "dst", position)), left.count(), 0
    done, front = None, None
    while taken < n:
        if front is None:
            front = left.agg(F.min("node").alias("node")).withColumn("rank", F.lit(taken).cast("long"))
        front = cut(front)
        taken += front.count()
        done = front if done is None else done.unionByName(front)
        left = cut(left.join(front, "node", "left_anti"))
        reached = edges.join(front.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("rank", position)).alias("by")).join(left, "node")
        nearest = cut(reached)
        front = None if nearest.isEmpty() else numbered(nearest, "by", name="rank").select("node", (F.col("rank") + taken).alias("rank"))
    if done is None:
        return identity(left)
    return done.select(F.col("node").alias("old_id"), (n - 1 - F.col("rank") if reverse else F.col("rank")).alias("new_id"))


def clustered(edges: DataFrame, first_size: int = 4, shift: int = 3, passes: int = 3, rounds: int = 4) -> DataFrame:
    """Nodes by cluster: in each pass, clusters join the neighbour with which they share most edges, if both choose each other and fit the pass's size, which grows by the shift.

    Choices are made by all clusters at once, so the order differs from that of one that merges edge by edge.
    """
    size, state = first_size, cut(nodes_of(edges).withColumn("cluster", F.col("node")))
    for _ in range(passes):
        for _ in range(rounds):
            ends = edges.join(state.select(F.col("node").alias("src"), F.col("cluster").alias("a")), "src").join(state.select(F.col("node").alias("dst"), F.col("cluster").alias("b")), "dst")
            pairs = ends.filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b").groupBy("a", "b").agg(F.count("*").alias("n"))
            sizes = state.groupBy("cluster").agg(F.count("*").alias("size"))
            fits = pairs.join(sizes.select(F.col("cluster").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("cluster").alias("b"), F.col("size").alias("sb")), "b").filter(F.col("sa") + F.col("sb") <= size)
            choice = cut(fits.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("best")).select("a", (-F.col("best.b")).alias("b")))
            mutual = choice.join(choice.select(F.col("a").alias("b"), F.col("b").alias("back")), "b").filter("a = back AND a > b").select(F.col("a").alias("cluster"), F.col("b").alias("into"))
            merged = cut(mutual)
            if merged.isEmpty():
                break
            state = cut(state.join(merged, "cluster", "left").select("node", F.coalesce("into", "cluster").alias("cluster")))
        size <<= shift
    return numbered(state, "cluster", "node", name="new_id").select(F.col("node").alias("old_id"), "new_id")


def random_swaps(nodes: DataFrame, percent: float, seed: str = "swap") -> DataFrame:
    """Pairs of nodes, of percent of all, swap their numbers."""
    drawn = numbered(nodes.select("node").distinct(), uniform(seed, F.col("node")), F.col("node"), name="at")
    pairs = math.floor(drawn.count() * percent / 100) // 2
    rows = drawn.withColumn("pair", F.floor(F.col("at") / 2))
    partner = rows.filter(F.col("pair") < pairs).select((F.col("at") + F.when(F.col("at") % 2 == 0, 1).otherwise(-1)).alias("at"), F.col("node").alias("other"))
    return rows.join(partner, "at", "left").select(F.col("node").alias("old_id"), F.coalesce("other", "node").alias("new_id"))


def by_part(parts: DataFrame) -> DataFrame:
    """Nodes by the part (node, part) that some outside partitioner gave them, then number."""
    return numbered(parts, "part", "node", name="new_id").select(F.col("node").alias("old_id"), "new_id")


def without_local(edges: DataFrame, owner: Callable[[Column], Column]) -> DataFrame:
    """The edges between different owners."""
    return edges.filter(owner(F.col("src")) != owner(F.col("dst")))


def ownership(edges: DataFrame, low: int, high: int) -> DataFrame:
    """edges with owned: both, left, right or none of the ends in [low, high)."""
    left, right = ((F.col(c) >= low) & (F.col(c) < high) for c in ("src", "dst"))
    return edges.withColumn("owned", F.when(left & right, "both").when(left, "left").when(right, "right").otherwise("none"))


def adjust_edges(edges: DataFrame, permutation: DataFrame) -> DataFrame:
    """Relabelled edges in order of their ends."""
    return relabel(edges, permutation).orderBy("src", "dst")


METHODS = ("none", "bisection", "partition", "clustered", "breadth_first", "first_touch", "degree")


def reorder(method: str, edges: DataFrame, points: DataFrame | None = None, parts: DataFrame | None = None, levels: int = 3) -> DataFrame:
    """(old_id, new_id) by the method named; bisection needs points, partition needs parts from an outside partitioner."""
    if method == "none":
        return identity(nodes_of(edges))
    if method == "bisection" and points is not None:
        return recursive_bisection(points, levels)
    if method == "partition" and parts is not None:
        return by_part(parts)
    if method == "clustered":
        return clustered(edges)
    if method == "breadth_first":
        return breadth_first(edges)
    if method == "first_touch":
        return first_touch(edges)
    if method == "degree":
        return degree_order(edges)
    raise ValueError(f"{method} is none of {METHODS}, or lacks points or parts")


def reorder_frequency(cost: float, gain: float, decay: float) -> float:
    """Steps between reorderings that cost least, for a cost each, a gain of a fresh order per step and its decay per step."""
    return math.inf if gain <= 0 or decay <= 0 else math.sqrt(2 * cost / (gain * decay))
