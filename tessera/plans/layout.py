"""Layouts of edges and grids: tiles, groups without conflicts, stencils."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Usual tile sides of graphs and of particle pairs, and rows to a group.
GRAPH_TILE, PAIR_TILE, LANES = 32768, 32684, 16


def tile(edges: DataFrame, size: int = GRAPH_TILE, src: str = "src", dst: str = "dst") -> DataFrame:
    """edges with the tile (tx, ty) of each."""
    return edges.withColumn("tx", F.floor(F.col(src) / size)).withColumn("ty", F.floor(F.col(dst) / size))


def lay_out_tiles(edges: DataFrame, size: int = GRAPH_TILE, position: str | None = None) -> DataFrame:
    """Tiled edges in row-major order of tiles, ranges of tiles to a partition, stable by position."""
    order = ["tx", "ty", *([position] if position else [])]
    return tile(edges, size).repartitionByRange(*order).sortWithinPartitions(*order)


def conflict_free_groups(tiled: DataFrame, position: str = "pos", dst: str = "dst", lanes: int = LANES) -> DataFrame:
    """Tiled edges with layer and group: the n-th edge of a target is in layer n of its tile, and a layer is cut into groups of lanes; so no group has a target twice."""
    layer = F.row_number().over(Window.partitionBy("tx", "ty", dst).orderBy(position)) - 1
    rows = tiled.withColumn("layer", layer)
    place = F.row_number().over(Window.partitionBy("tx", "ty", "layer").orderBy(dst)) - 1
    return rows.withColumn("group", F.floor(place / lanes))


def padded_edges(grouped: DataFrame, lanes: int = LANES) -> DataFrame:
    """One row (edges, padded): edges, and slots when each group of a layer is filled up to lanes."""
    sizes = grouped.groupBy("tx", "ty", "layer").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("edges"), F.sum(F.ceil(F.col("n") / lanes) * lanes).alias("padded"))


def pair_groups(tiled: DataFrame, position: str = "pos", ends: tuple[str, str] = ("src", "dst"), lanes: int = LANES) -> DataFrame:
    """Tiled pairs with group, such that neither end is in a group twice: the first group with room in which both are new, by position, within each tile.

    First-fit is sequential, so each tile is one group of applyInPandas; the size of the tiles bounds its memory.
    """
    import pandas as pd

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position)
        groups: list[set] = []
        sizes: list[int] = []
        first, out = 0, []
        for a, b in zip(pdf[ends[0]], pdf[ends[1]], strict=True):
            g = first
            while g < len(groups) and (sizes[g] >= lanes or a in groups[g] or b in groups[g]):
                g += 1
            if g == len(groups):
                groups.append(set())
                sizes.append(0)
            groups[g] |= {a, b}
            sizes[g] += 1
            while first < len(groups) and sizes[first] >= lanes:
                first += 1
            out.append(g)
        return pdf.assign(group=pd.Series(out, index=pdf.index, dtype="int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiled.schema.fields)
    return tiled.groupBy("tx", "ty").applyInPandas(fit, f"{schema}, group long")


def stencil(grid: DataFrame, offsets: list[tuple[int, ...]], axes: tuple[str, ...] = ("i", "j"), value: str = "v") -> DataFrame:
    """(axes, value, around): for each cell the sum of the cells at the offsets; outside the grid is zero.

    Each cell sends its value to the cells that see it, so one shuffle serves any number of offsets.
    """
    sends = [F.struct(*(F.col(a).alias(a) for a in axes), F.col(value).alias("own"), F.lit(None).cast("double").alias("seen"))]
    sends += [F.struct(*((F.col(a) - d).alias(a) for a, d in zip(axes, o, strict=True)), F.lit(None).cast("double").alias("own"), F.col(value).cast("double").alias("seen")) for o in offsets]
    rows = grid.select(F.inline(F.array(sends[0].cast(grid.select(sends[1]).schema[0].dataType), *sends[1:])))
    summed = rows.groupBy(*axes).agg(F.max("own").alias(value), F.coalesce(F.sum("seen"), F.lit(0.0)).alias("around"), F.count("own").alias("n"))
    return summed.filter("n > 0").drop("n")


def to_columns(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(field, key, value): an array of structures as a structure of arrays."""
    return rows.select(key, F.expr(f"stack({len(values)}, " + ", ".join(f"'{v}', `{v}`" for v in values) + ") AS (field, value)"))


def to_rows(columns: DataFrame, key: str, values: list[str]) -> DataFrame:
    return columns.groupBy(key).pivot("field", values).agg(F.first("value"))
