"""Generators of key distributions and particle sets; every draw is a function of the row number and a seed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import uniform


def heavy_hitter(spark: SparkSession, rows: int, groups: int, seed: str = "hitter") -> DataFrame:
    """(id, key, value): key 0 for half of the rows, else any of 1 to groups - 1; value 1 to 5."""
    i = F.col("id")
    other = 1 + F.floor(uniform(seed + "k", i) * (groups - 1))
    return spark.range(rows).select("id", F.when(uniform(seed + "h", i) < 0.5, 0).otherwise(other).cast("long").alias("key"), (1 + F.floor(uniform(seed + "v", i) * 5)).cast("long").alias("value"))


def moving_cluster(spark: SparkSession, rows: int, groups: int, block: int = 64, width: int = 16, seed: str = "cluster") -> DataFrame:
    """(id, key, value): the keys of a block of rows lie in a window of width + 1 keys that moves up with the rows; value 1 to 5."""
    i, blocks = F.col("id"), max(1, -(-rows // block))
    low = F.floor(F.floor(i / block) * groups / (2 * blocks))
    return spark.range(rows).select("id", (low + F.floor(uniform(seed + "k", i) * (width + 1))).cast("long").alias("key"), (1 + F.floor(uniform(seed + "v", i) * 5)).cast("long").alias("value"))


def zipf(spark: SparkSession, rows: int, groups: int, alpha: float = 2.0, seed: str = "zipf") -> DataFrame:
    """(id, key, value): key r - 1 with probability in proportion to r ** -alpha for ranks r up to groups; value 1 to 3.

    The cumulated probabilities are one sorted literal array (8 bytes a group, 4 MB for 2 ** 19), in which each row's draw
    is looked up by halving.
    """
    weights = [r**-alpha for r in range(1, groups + 1)]
    total, cdf, run = sum(weights), [], 0.0
    for w in weights[:-1]:
        run += w
        cdf.append(run / total)
    i = F.col("id")
    table = F.lit(",".join(map(repr, cdf)))
    steps = F.split(table, ",").cast("array<double>") if cdf else F.array().cast("array<double>")  # folded into one literal
    u = spark.range(rows).select("id", uniform(seed + "k", i).alias("u"), (1 + F.floor(uniform(seed + "v", i) * 3)).cast("long").alias("value"))
    strides = F.array(*(F.lit(1 << i) for i in reversed(range(len(cdf).bit_length())))) if cdf else F.array().cast("array<int>")
    key = F.aggregate(strides, F.lit(0), lambda at, by: F.when((at + by <= len(cdf)) & (F.try_element_at(steps, at + by) <= F.col("u")), at + by).otherwise(at))
    return u.select("id", key.cast("long").alias("key"), "value")


def box_side(particles: int) -> float:
    """The side of the box at the usual density; 0.83134 and the exponent are fixed values."""
    return (particles / 0.83134) ** 0.3333333


def fcc_lattice(spark: SparkSession, b: int, jitter: float = 0.0) -> DataFrame:
    """(id, x, y, z) of the 4 * b ** 3 points of a face-centred cubic lattice in the box; jitter moves each within that share of a cell."""
    side = box_side(4 * b**3)
    cell = side / b
    offsets = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(o, "abc", strict=True))) for o in ((0.0, 0.0, 0.0), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5), (0.5, 0.5, 0.0))))
    cells = spark.range(b**3).select((F.col("id") % b).alias("i"), (F.floor(F.col("id") / b) % b).alias("j"), F.floor(F.col("id") / (b * b)).alias("k"), "id")
    points = cells.select("i", "j", "k", "id", F.posexplode(offsets).alias("n", "o")).withColumn("id", F.col("id") * 4 + F.col("n"))
    out = points.select("id", ((F.col("i") + F.col("o.a")) * cell).alias("x"), ((F.col("j") + F.col("o.b")) * cell).alias("y"), ((F.col("k") + F.col("o.c")) * cell).alias("z"))
    if jitter:
        for axis, name in enumerate("xyz"):
            shift = (F.pmod((F.col("id") * 3 + axis + 1) * 2654435769, F.lit(1 << 32)) / float(1 << 32) - 0.5) * (jitter * cell)
            moved = F.col(name) + shift
            out = out.withColumn(name, F.when(moved < 0, moved + side).when(moved > side, moved - side).otherwise(moved))
    return out


def velocities(particles: DataFrame, step: float = 0.016, temperature: float = 0.722, seed: str = "velocity") -> DataFrame:
    """particles with vhx, vhy, vhz: normal draws, without drift, scaled to the temperature and multiplied by the step."""
    rows = particles
    for axis in "xyz":
        r = F.sqrt(-2 * F.log(1 - uniform(f"{seed}{axis}r", F.col("id"))))
        rows = rows.withColumn(f"u{axis}", r * F.cos(2 * math.pi * uniform(f"{seed}{axis}a", F.col("id"))))
    mean = rows.agg(F.count("*").alias("n"), *(F.avg(f"u{a}").alias(f"m{a}") for a in "xyz"))
    rows = rows.crossJoin(F.broadcast(mean))  # one row
    for a in "xyz":
        rows = rows.withColumn(f"u{a}", F.col(f"u{a}") - F.col(f"m{a}"))
    energy = rows.agg(F.sum(F.col("ux") ** 2 + F.col("uy") ** 2 + F.col("uz") ** 2).alias("e"))
    rows = rows.crossJoin(F.broadcast(energy))
    scale = step * F.sqrt(temperature * 3 * (F.col("n") - 1) / F.when(F.col("e") > 0, F.col("e")))
    return rows.select(*(F.col(c) for c in particles.columns), *((F.coalesce(F.col(f"u{a}") * scale, F.lit(0.0))).alias(f"vh{a}") for a in "xyz"))


def lehmer(count: int, seed: int = 1073741823) -> list[float]:
    """The first draws of the multiplicative generator 16807 modulo 2 ** 31 - 1, on the driver."""
    out = []
    for _ in range(count):
        seed = 16807 * seed % (2**31 - 1)
        out.append(seed / (2**31 - 1))
    return out
