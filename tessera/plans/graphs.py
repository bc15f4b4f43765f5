"""PageRank and three label-correcting searches, as loops of joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import scatter_reduce
from .fixpoint import cut, drop, repeat, until_unchanged

#: What an unreached node shows in parity output: a fixed value.
UNREACHED = 99999999.0


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _ranking(edges: DataFrame, damping: float, nodes: DataFrame | None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The state of rank 1 and the step; the edges, with the out-degree of their source, are joined and dealt by source once."""
    listed = cut(nodes_of(edges) if nodes is None else nodes)
    n = listed.count()
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    links = cut(edges.select("src", "dst").join(degree, "src").repartition("src"))

    def step(state: DataFrame) -> DataFrame:
        sent = links.join(state.withColumnRenamed("node", "src"), "src").select("dst", (F.col("rank") / F.col("degree")).alias("sent"))
        got = scatter_reduce(sent, "dst", "sent", "add", name="got").withColumnRenamed("dst", "node")
        return listed.join(got, "node", "left").select("node", (F.lit((1 - damping) / max(n, 1)) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"))

    return listed.withColumn("rank", F.lit(1.0)), step


def page_rank(edges: DataFrame, steps: int = 10, damping: float = 0.85, nodes: DataFrame | None = None) -> DataFrame:
    """(node, rank) after so many steps from rank 1: (1 - damping) / n + damping * sum of rank / out-degree; repeated edges count, what nodes without out-edges hold is lost."""
    return repeat(*_ranking(edges, damping, nodes), steps)


def page_rank_until(edges: DataFrame, probe: int = 100, tolerance: float = 0.001, most: int = 200, damping: float = 0.85) -> tuple[DataFrame, int]:
    """(state, steps): steps until the rank of one probed node changes by at most a share tolerance."""
    (state, step), last = _ranking(edges, damping, None), 1.0
    for i in range(1, most + 1):
        before, state = state, cut(step(state))
        if i > 1:
            drop(before)
        now = state.filter(F.col("node") == probe).select("rank").collect()
        if not now:
            raise ValueError(f"there is no node {probe}")
        if abs(now[0][0] - last) <= tolerance * last:
            return state, i
        last = now[0][0]
    return state, most


def correct_labels(edges: DataFrame, start: DataFrame, message: Callable[[Column, Column], Column], op: str) -> tuple[DataFrame, int]:
    """((node, label), rounds): labels improved along edges until none changes.

    Only nodes that changed send; the best message of each node is compared with its label once all are combined, so the
    order of edges is without effect. Nodes without a label (null) take any message. All nodes count as changed at first.
    """
    edges = cut(edges.repartition("src"))  # dealt once: rounds join on src
    better = (lambda new, old: new < old) if op == "min" else (lambda new, old: new > old)

    def step(state: DataFrame) -> DataFrame:
        awake = state.filter("changed AND label IS NOT NULL").select(F.col("node").alias("src"), "label")
        sent = edges.join(awake, "src").select("dst", message(F.col("label"), F.col("weight")).alias("sent"))
        best = scatter_reduce(sent, "dst", "sent", op, name="best").withColumnRenamed("dst", "node")
        rows = state.join(best, "node", "left")
        improved = F.col("best").isNotNull() & (F.col("label").isNull() | better(F.col("best"), F.col("label")))
        return rows.select("node", F.when(improved, F.col("best")).otherwise(F.col("label")).alias("label"), improved.alias("changed"))

    return until_unchanged(start.withColumn("changed", F.lit(True)), step)


def _from_source(edges: DataFrame, source: int, value: float) -> DataFrame:
    return nodes_of(edges).withColumn("label", F.when(F.col("node") == source, F.lit(value)))


def shortest_paths(edges: DataFrame, source: int = 0, parity: bool = False) -> tuple[DataFrame, int]:
    """((node, dist), rounds) over (src, dst, weight), weights of 0 or more; null where unreached, UNREACHED in parity output."""
    state, rounds = correct_labels(edges, _from_source(edges, source, 0.0), lambda d, w: d + w, "min")
    dist = F.coalesce("label", F.lit(UNREACHED)) if parity else F.col("label")
    return state.select("node", dist.alias("dist")), rounds


def widest_paths(edges: DataFrame, source: int = 0, parity: bool = False) -> tuple[DataFrame, int]:
    """((node, width), rounds): the largest least weight of a path from the source, whose own width is UNREACHED; null where unreached, 0 in parity output."""
    state, rounds = correct_labels(edges, _from_source(edges, source, UNREACHED), lambda d, w: F.least(d, w), "max")
    width = F.coalesce("label", F.lit(0.0)) if parity else F.col("label")
    return state.select("node", width.alias("width")), rounds


def spread_labels(edges: DataFrame, directed: bool = True) -> tuple[DataFrame, int]:
    """((node, comp), rounds): the smallest node that reaches each along edges; with directed off, of its weak component."""
    links = edges.select("src", "dst")
    if not directed:
        links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = links.distinct().withColumn("weight", F.lit(0.0))
    state, rounds = correct_labels(links, nodes_of(edges).withColumn("label", F.col("node")), lambda d, w: d, "min")
    return state.select("node", F.col("label").alias("comp")), rounds


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each weak component, as spread_labels(directed=False) finds it, by contraction.

    In a round, every node points at its smallest neighbour, if that is smaller; pointers are followed to their ends by
    doubling; nodes become their ends and edges within one end go. So edges shrink from round to round, and rounds and
    doublings grow with logarithms, not with the diameter.
    """
    comps = cut(nodes_of(edges).withColumn("comp", F.col("node")))
    links = edges.select("src", "dst").filter("src <> dst")
    links = cut(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    while not links.isEmpty():
        pointers = cut(links.groupBy(F.col("src").alias("at")).agg(F.min("dst").alias("low")).select("at", F.least("at", "low").alias("end"), F.lit(True).alias("moved")))
        while not pointers.filter("moved").isEmpty():
            further, before = pointers.select(F.col("at").alias("end"), F.col("end").alias("next")), pointers
            pointers = cut(pointers.join(further, "end").select("at", F.col("next").alias("end"), (F.col("next") != F.col("end")).alias("moved")))
            drop(before)
        ends, old_comps, old_links = pointers.select("at", "end"), comps, links
        comps = cut(comps.join(ends.withColumnRenamed("at", "comp"), "comp", "left").select("node", F.coalesce("end", "comp").alias("comp")))
        links = links.join(ends.select(F.col("at").alias("src"), F.col("end").alias("a")), "src").join(ends.select(F.col("at").alias("dst"), F.col("end").alias("b")), "dst")
        links = cut(links.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        for table in (pointers, old_comps, old_links):
            drop(table)
    return comps
