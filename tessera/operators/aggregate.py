"""Grouped and scattered reductions; combining before the shuffle is Spark's own partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATIONS = ("add", "sub", "mul", "div", "min", "max", "count_if")


def key_aggregate(df: DataFrame, key: str = "key", value: str = "value", derived: bool = False) -> DataFrame:
    """(key, cnt, sum, sumsq), sums in long; derived adds mean and variance. Any key is legal, null and -1 too."""
    v = F.col(value).cast("long")
    out = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("cnt"), F.sum(v).alias("sum"), F.sum(v * v).alias("sumsq"))
    if derived:
        mean = F.col("sum") / F.col("cnt")
        out = out.withColumn("mean", mean).withColumn("variance", F.col("sumsq") / F.col("cnt") - mean * mean)
    return out


def _combined(v: Column, op: str, init: Column | float | None) -> Column:
    start = None if init is None else init if isinstance(init, Column) else F.lit(init)
    total = F.sum(v) if op in ("add", "sub") else F.product(v.cast("double")) if op in ("mul", "div") else None
    if op == "add":
        return total if start is None else start + total
    if op == "sub":
        return (F.lit(0) if start is None else start) - total
    if op == "mul":
        return total if start is None else start * total
    if op == "div":
        return (F.lit(1.0) if start is None else start) / F.when(total != 0, total)
    if op in ("min", "max"):
        best = F.min(v) if op == "min" else F.max(v)
        return best if start is None else (F.least if op == "min" else F.greatest)(best, start)
    if op == "count_if":
        return F.count_if(v)
    raise ValueError(f"{op} is none of {OPERATIONS}")


def scatter_reduces(df: DataFrame, index: str, wanted: dict[str, tuple[str | Column, str, Column | float | None]]) -> DataFrame:
    """(index, *names): for each name (value, op, init), the values of each index combined by op, all in one aggregate.

    add and mul start from init (0 and 1), sub and div take the sum and the product of the values from it; min and max
    include it if it is given; count_if counts true values.
    """
    found = [_combined(F.col(v) if isinstance(v, str) else v, op, init).alias(name) for name, (v, op, init) in wanted.items()]
    return df.groupBy(F.col(index).alias(index)).agg(*found)


def scatter_reduce(df: DataFrame, index: str, value: str | Column, op: str, init: Column | float | None = None, name: str = "value") -> DataFrame:
    """(index, name): the values of each index combined by op, starting from init where that makes a difference."""
    return scatter_reduces(df, index, {name: (value, op, init)})


def antisymmetric_scatter(pairs: DataFrame, forces: tuple[str, ...] = ("fx", "fy", "fz"), left: str = "i", right: str = "j") -> DataFrame:
    """(id, *forces): each pair's forces added at the left end and subtracted at the right one."""
    ends = F.array(F.struct(F.col(left).alias("id"), *(F.col(f).alias(f) for f in forces)), F.struct(F.col(right).alias("id"), *((-F.col(f)).alias(f) for f in forces)))
    return pairs.select(F.inline(ends)).groupBy("id").agg(*(F.sum(f).alias(f) for f in forces))


def block_reduce(df: DataFrame, position: str, index: str, value: str, op: str = "add", width: int = 16) -> DataFrame:
    """(block, index, first position, value): the values of an index within each block of width rows, combined."""
    how = {"add": F.sum, "min": F.min, "max": F.max}[op]
    block = F.floor(F.col(position) / width).cast("long")
    return df.groupBy(block.alias("block"), F.col(index).alias(index)).agg(F.min(position).alias("first"), how(value).alias(value))


def first_in_block(df: DataFrame, position: str, index: str, width: int = 16) -> DataFrame:
    """df with first: whether no earlier row of its block of width rows has the same index."""
    block = F.floor(F.col(position) / width)
    return df.withColumn("first", F.row_number().over(Window.partitionBy(block, F.col(index)).orderBy(position)) == 1)


def conflict_overhead(df: DataFrame, position: str, index: str, width: int = 16, least: int = 2) -> DataFrame:
    """One row (overhead): width times the indices with least or more rows in a block, over all rows."""
    groups = df.groupBy(F.floor(F.col(position) / width).alias("block"), index).agg(F.count("*").alias("n"))
    return groups.agg((width * F.count_if(F.col("n") >= least) / F.when(F.sum("n") > 0, F.sum("n"))).alias("overhead"))


def lane_utilisation(df: DataFrame, position: str, index: str, width: int = 16) -> DataFrame:
    """One row (rows, passes, utilisation): a block takes as many passes as its most frequent index has rows."""
    groups = df.groupBy(F.floor(F.col(position) / width).alias("block"), index).agg(F.count("*").alias("n"))
    blocks = groups.groupBy("block").agg(F.sum("n").alias("rows"), F.max("n").alias("passes"))
    return blocks.agg(F.sum("rows").alias("rows"), F.sum("passes").alias("passes"), (F.sum("rows") / F.when(F.sum("passes") > 0, width * F.sum("passes"))).alias("utilisation"))
