"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import forget, store


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, comp): the smallest node of each connected component, for every node that has an edge.

    Labels spread along edges and jump along labels, so the rounds grow with the logarithm of the longest path.
    Every round is written to the shared folder. Null ends, self-loops and repeated edges change nothing;
    no edges give no rows.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
    both = store(both.filter("u <> v").distinct(), "edges")
    labels = store(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("low"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "low").alias("comp"))
        ahead = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = store(step.join(ahead, "comp", "left").select("node", "old", F.least("comp", "far").alias("comp")), "labels")
        changed = not new.filter("comp <> old").isEmpty()
        forget(labels)
        labels = new.select("node", "comp")
        if not changed:
            forget(both)
            return labels
