"""Ordered operators: offsets, reuse distances, sorts and degree orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import cut


def _sorted(df: DataFrame, *order: str | F.Column) -> DataFrame:
    """df in a total order with the number of each row's partition and its place there; checkpointed, so that both stay what they are."""
    rows = df.orderBy(*order).withColumn("__part", F.spark_partition_id())
    return cut(rows.withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33)))


def _before(rows: DataFrame, total: F.Column) -> DataFrame:
    """(__part, __before): the total of all partitions before each; one row a partition meets in one place."""
    sizes = rows.groupBy("__part").agg(total.alias("__n"))
    return sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))


def numbered(df: DataFrame, *order: str | F.Column, name: str = "pos") -> DataFrame:
    """df with the number of each row in a total order, from 0: a range-partitioned sort, the rows of each partition counted, their offsets added.

    No partition is wider than its range; only one count for each partition meets in one place.
    """
    rows = _sorted(df, *order)
    return rows.join(F.broadcast(_before(rows, F.count("*"))), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def csr(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, offset, partners): each source's sorted partners, and how many partners come before."""
    lists = edges.groupBy(F.col(src).alias("node")).agg(F.array_sort(F.collect_list(dst)).alias("partners"))
    rows = _sorted(lists, "node")
    within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum(F.size("partners")).over(within), F.lit(0)))
    before = _before(rows.select("__part", "partners"), F.sum(F.size("partners")))
    return rows.join(F.broadcast(before), "__part").select("node", (F.col("__before") + F.col("__within")).alias("offset"), "partners")


def csr_edges(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("node").alias("src"), F.explode("partners").alias("dst"))


def symmetrise(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each edge in both directions, each direction once."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    turned = edges.select(F.col(dst).alias(src), F.col(src).alias(dst), *rest)
    return edges.select(src, dst, *rest).unionByName(turned).distinct()


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, degree) counting both ends of each edge."""
    return edges.select(F.explode(F.array(src, dst)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("nodes"))


def degree_order(edges: DataFrame, largest_first: bool = True) -> DataFrame:
    """(old_id, new_id): nodes by degree, then number."""
    by = F.desc("degree") if largest_first else F.asc("degree")
    return numbered(degrees(edges), by, F.col("node"), name="new_id").select(F.col("node").alias("old_id"), "new_id")


def reuse_distance(accesses: DataFrame, position: str = "pos", node: str = "node", width: int = 4, most: int = 1000) -> DataFrame:
    """One row (reuses, near, mean_near): accesses whose group of width nodes came before, those within most positions, and their mean distance."""
    back = F.col(position) - F.lag(position).over(Window.partitionBy(F.floor(F.col(node) / width)).orderBy(position))
    rows = accesses.select(back.alias("back")).filter("back IS NOT NULL")
    near = F.col("back") <= most
    return rows.agg(F.count("*").alias("reuses"), F.count_if(near).alias("near"), F.avg(F.when(near, F.col("back"))).alias("mean_near"))
