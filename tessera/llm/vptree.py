"""Nearest neighbours by cosine through vantage-point trees, one per shard of the vectors.

On unit vectors the largest cosine is the smallest distance, which obeys the triangle inequality. Shards are metric: each
vector goes to the nearest of some pivots, and cells of over SHARD vectors are dealt to several shards. A tree halves its
vectors by the distance to a vantage point.

A query first searches one shard of its own cell, which bounds its k-th distance. It then goes to those cells only that
the triangle inequality, by the cell's radius and by the pivots' distances, leaves within factor times that bound; in
a tree, to such subtrees only. Factor 1 is exact, less trades recall for time. Queries travel in blocks of one cell.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import ship, store

#: Vectors to a shard, queries to a block and vectors to a leaf, on average: these bound the memory of a task. Pivots for each vector length, at most: 1,024 of 64 components are 0.5 MB.
SHARD, BLOCK, LEAF, PIVOTS = 8192, 2048, 64, 1024
#: What rounding may add to a distance.
ROUNDING = 1e-7


@dataclass
class Tree:
    """Vectors in the order of the tree; node i has a vantage point, a radius, and the range of its vectors; children have larger numbers."""

    ids: np.ndarray
    vectors: np.ndarray
    point: np.ndarray  # -1: a leaf
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        return cls(**np.load(io.BytesIO(data)))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors times powers of two that bring their largest components near one: no cosine changes, no norm under- or overflows."""
    if not len(vectors):
        return vectors
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


def units(vectors: np.ndarray) -> np.ndarray:
    """scaled() vectors of length one."""
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree over vectors (rows, none of them zero), by whatever ids."""
    order = np.argsort(ids, kind="stable")
    vectors = scaled(vectors)
    unit = units(vectors)
    rows: list[list] = []
    stack = [(0, len(ids), -1, 0)]
    rng = np.random.default_rng(7)
    while stack:
        low, high, parent, side = stack.pop()
        number = len(rows)
        rows.append([-1, 0.0, low, high, -1, -1])
        if parent >= 0:
            rows[parent][4 + side] = number
        if high - low <= leaf:
            continue
        own = order[low:high]
        at = int(rng.integers(high - low))
        far = np.sqrt(np.maximum(0, 2 - 2 * unit[own] @ unit[own[at]]))
        radius = float(np.median(far))
        within = far <= radius
        if within.all():
            continue
        rows[number][:2] = own[at], radius
        order[low:high] = np.concatenate([own[within], own[~within]])
        middle = low + int(within.sum())
        stack += [(middle, high, number, 1), (low, middle, number, 0)]
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    table = list(zip(*rows, strict=True))
    point = np.array([place[p] if p >= 0 else -1 for p in table[0]])
    return Tree(ids[order], vectors[order], point, np.array(table[1]), *(np.array(c) for c in table[2:]))


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, id, score) of up to k nearest of each query but itself, and how many pairs were compared. known: k-th scores found elsewhere; what lies below them need not be found."""
    queries = scaled(queries)
    n, norm = len(ids), np.linalg.norm(queries, axis=1)
    known = np.full(n, -np.inf) if known is None else known
    norms = np.linalg.norm(tree.vectors, axis=1)
    unit = queries / norm[:, None]
    best, names = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    seen, compared = np.full(n, -1), 0

    def offer(node: int, rows: np.ndarray) -> None:
        nonlocal compared
        a, b = tree.low[node], tree.high[node]
        compared += len(rows) * (b - a)
        scores = np.einsum("qd,nd->qn", queries[rows], tree.vectors[a:b]) / (norm[rows, None] * norms[None, a:b])
        scores[ids[rows, None] == tree.ids[None, a:b]] = -np.inf
        all_scores = np.concatenate([best[rows], scores], 1)
        all_names = np.concatenate([names[rows], np.broadcast_to(tree.ids[a:b], scores.shape)], 1)
        first = np.lexsort((all_names, -all_scores), axis=1)[:, :k]
        best[rows], names[rows] = np.take_along_axis(all_scores, first, 1), np.take_along_axis(all_names, first, 1)

    def far(node: int, rows: np.ndarray) -> np.ndarray:
        p = tree.point[node]
        return np.sqrt(np.maximum(0, 2 - 2 * unit[rows] @ (tree.vectors[p] / norms[p])))

    stack = [(0, np.flatnonzero(~np.isfinite(known)))] if n and len(tree.ids) else []
    while stack:
        node, rows = stack.pop()
        if not len(rows):
            continue
        if tree.point[node] < 0:
            seen[rows] = node
            offer(node, rows)
            continue
        inside = far(node, rows) <= tree.radius[node]
        stack += [(child, part) for child, part in ((tree.inner[node], rows[inside]), (tree.outer[node], rows[~inside])) if len(part)]
    stack = [(0, np.arange(n))] if n and len(tree.ids) else []
    while stack:
        node, rows = stack.pop()
        if tree.point[node] < 0:
            if len(rows := rows[seen[rows] != node]):
                offer(node, rows)
            continue
        d, radius = far(node, rows), tree.radius[node]
        reach = factor * np.sqrt(np.maximum(0, 2 - 2 * np.maximum(best[rows, k - 1], known[rows]))) + ROUNDING
        stack += [(child, part) for child, part in ((tree.outer[node], rows[d + reach >= radius]), (tree.inner[node], rows[d - reach <= radius])) if len(part)]
    found = np.isfinite(best)
    return np.nonzero(found)[0], names[found], best[found], compared


def usable(vector) -> F.Column:
    """Whether a vector has components, all finite, not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _lists(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _away(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * unit @ pivots.T))


def _pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """By vector length, unit vectors that cut the space into about as many cells as there are shards, PIVOTS at most: those with the smallest hashes."""
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"))
    wanted = F.least(F.lit(PIVOTS), F.ceil(F.col("n") / SHARD))
    first = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id", "v"), "id"))
    picked = rows.withColumn("first", first).filter(F.col("first") <= PIVOTS).join(counts, "dim").filter(F.col("first") <= wanted).select("dim", "v").collect()
    by: dict[int, list] = {}
    for r in picked:
        by.setdefault(r["dim"], []).append(r["v"])
    return {d: units(scaled(np.unique(np.array(v, float), axis=0))) for d, v in by.items()}


def _in_cells(rows: DataFrame, pivots) -> DataFrame:
    """(dim, cell, turn, id, v, far): the nearest pivot and its distance; turn counts the rows of a task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                if d not in pivots.value:
                    continue
                far = _away(units(scaled(_lists(own.column(1), int(d)))), pivots.value[int(d)])
                cell = far.argmin(1)
                turns = turn + np.arange(len(cell))
                turn += len(cell)
                yield pa.RecordBatch.from_arrays([own.column(2), pa.array(cell, pa.int32()), pa.array(turns), own.column(0), own.column(1), pa.array(far[np.arange(len(cell)), cell])], names=["dim", "cell", "turn", "id", "v", "far"])

    return rows.mapInArrow(each, "dim int, cell int, turn long, id long, v array<double>, far double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors of each query but those of its own id, by cosine in double precision; ties to smaller ids.

    Vectors that are null, empty, zero, or with null or non-finite components take no part, as queries or otherwise;
    only vectors of one length are compared, and pivots are held for each length. With fewer candidates, all are
    returned. Ids name vectors: rows repeating an id are one candidate each. All rows are indexed; empty tables give no
    rows; other columns aren't read.
    """
    spark = vectors.sparkSession
    ship(spark)
    pick = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    found_pivots = _pivots(pick(vectors))
    pivots = spark.sparkContext.broadcast(found_pivots)
    placed, asked = store(_in_cells(pick(vectors), pivots), "placed"), store(_in_cells(pick(queries), pivots), "asked")

    def dealt(df: DataFrame, most: int, name: str) -> tuple[DataFrame, DataFrame]:
        parts = df.groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / most).cast("int").alias("parts"))  # a row for each pivot
        return df.join(F.broadcast(parts.select("dim", "cell", "parts")), ["dim", "cell"]).withColumn(name, F.pmod(F.xxhash64("turn"), F.col("parts")).cast("int")), parts

    placed, parts = dealt(placed, SHARD, "shard")
    asked, _ = dealt(asked, BLOCK, "block")
    cells: dict[int, list[tuple[int, float, int]]] = {}
    for r in parts.collect():
        cells.setdefault(r["dim"], []).append((r["cell"], r["radius"], r["parts"]))
    cells = spark.sparkContext.broadcast({d: tuple(np.array(c) for c in zip(*sorted(x), strict=True)) for d, x in cells.items()})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        return pd.DataFrame({"dim": [first["dim"]], "cell": [first["cell"]], "shard": [first["shard"]], "tree": [build(pdf.id.to_numpy(), _matrix(pdf.v)).dump()]})

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        first, ids = pdf.iloc[0], pdf.id.to_numpy()
        order = np.argsort(ids, kind="stable")
        data = _packed(ids=ids[order], v=_matrix(pdf.v)[order], known=np.full(len(ids), -np.inf))
        own = cells.value.get(first["dim"])
        at = np.flatnonzero(own[0] == first["cell"]) if own else []
        # a cell without vectors sends its queries to the nearest that has some
        cell = first["cell"] if len(at) else int(own[0][_away(pivots.value[first["dim"]][[first["cell"]]], pivots.value[first["dim"]][own[0]])[0].argmin()])
        shards = int(own[2][np.flatnonzero(own[0] == cell)[0]])
        return pd.DataFrame({"dim": [first["dim"]], "cell": [cell], "shard": [int(first["block"]) % shards], "home": [True], "queries": [data]})

    trees = store(placed.groupBy("dim", "cell", "shard").applyInPandas(pack, "dim int, cell int, shard int, tree binary"), "trees")
    kind = "dim int, cell int, shard int, home boolean, queries binary"
    bundles = asked.groupBy("dim", "cell", "block").applyInPandas(bundle, kind)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The neighbours found, and from the first shard the bundle for each shard that is left."""
        for batch in batches:
            for d, c, s, home, q, t in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                with np.load(io.BytesIO(q)) as block:
                    ids, v, known = block["ids"], block["v"], block["known"]
                row, name, score, _ = search(Tree.load(t), ids, v, k, factor, None if home else known)
                more: list[tuple[int, int, bytes]] = []
                if home:
                    place = np.flatnonzero(np.diff(row, prepend=-1))  # scores descend within a query
                    many = np.bincount(row, minlength=len(ids))
                    known = np.full(len(ids), -np.inf)
                    full = many == k
                    known[full] = score[place[full[row[place]]] + k - 1]
                    numbers, radius, parts_of = cells.value[d]
                    away = _away(units(scaled(v)), pivots.value[d])
                    reach = factor * np.where(full, np.sqrt(np.maximum(0, 2 - 2 * np.maximum(known, -1))), np.inf) + ROUNDING
                    lower = np.maximum(away[:, numbers] - radius, (away[:, numbers] - away.min(1, keepdims=True)) / 2)
                    for at in np.flatnonzero((lower <= reach[:, None]).any(0)):
                        rows = lower[:, at] <= reach
                        data = _packed(ids=ids[rows], v=v[rows], known=known[rows])
                        more += [(int(numbers[at]), i, data) for i in range(int(parts_of[at])) if (numbers[at], i) != (c, s)]
                yield found_rows(d, ids[row], name, score, more)

    names = ["query_id", "vec_id", "score", "dim", "cell", "shard", "queries"]
    out = "query_id long, vec_id long, score double, dim int, cell int, shard int, queries binary"

    def found_rows(d: int, ids: np.ndarray, near: np.ndarray, scores: np.ndarray, more: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        columns = [(ids, pa.int64()), (near, pa.int64()), (scores, pa.float64())]
        columns = [pa.concat_arrays([pa.array(x, kind), pa.nulls(len(more), kind)]) for x, kind in columns] + [pa.array([d] * (len(ids) + len(more)), pa.int32())]
        rest = [([x[i] for x in more], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns + [pa.concat_arrays([pa.nulls(len(ids), kind), pa.array(x, kind)]) for x, kind in rest], names=names)

    def met(rows: DataFrame) -> DataFrame:
        return rows.join(trees, ["dim", "cell", "shard"]).select("dim", "cell", "shard", "home", "queries", "tree").mapInArrow(each, out)

    first = store(met(bundles), "first")
    second = met(first.filter("queries is not null").select("dim", "cell", "shard", F.lit(False).alias("home"), "queries"))
    found = first.filter("query_id is not null").select("query_id", "vec_id", "score").unionByName(second.filter("query_id is not null").select("query_id", "vec_id", "score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
