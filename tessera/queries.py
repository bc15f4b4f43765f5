"""The queries over the reference tables, each with SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import aggregate as A
from .operators import joins as J
from .operators import windows as W
from .plans import cluster, graphs, layout, particles, reorder
from .plans.fixpoint import cut, shared_folder
from .sources import generators as G
from .sources import readers as R
from .sources.generators import box_side

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Cells of the lattice along an axis, and how far its points are moved, as a share of a cell.
CELLS, JITTER = 8, 0.2


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# inputs ------------------------------------------------------------------------------------------------------------

KV = "kv AS (SELECT l_suppkey AS key, CAST(l_quantity AS BIGINT) AS value, l_orderkey, l_linenumber FROM lineitem)"
POS = KV + ", p AS (SELECT key, value, row_number() OVER (ORDER BY l_orderkey, l_linenumber, key, value) - 1 AS pos FROM kv)"
DIR = (
    "g AS (SELECT src, dst, min(w) AS weight FROM (SELECT user_id AS src, value AS w, lead(user_id) OVER "
    "(PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY 1, 2)"
)
CHAIN = "g AS (SELECT p_partkey AS src, p_partkey + 1 AS dst, CAST(p_size AS DOUBLE) AS weight FROM part WHERE p_partkey % 16 <> 15 AND p_partkey + 1 < (SELECT count(*) FROM part))"
BIP = "g AS (SELECT l_suppkey AS src, (SELECT count(*) FROM supplier) + l_partkey AS dst, min(l_quantity) AS weight FROM lineitem GROUP BY 1, 2)"
NUMBERED = "e AS (SELECT *, row_number() OVER (ORDER BY src, dst) - 1 AS pos FROM g)"


def key_values(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_quantity").cast("long").alias("value"), "l_orderkey", "l_linenumber")


def positioned(spark: SparkSession, d: str) -> DataFrame:
    return W.numbered(key_values(spark, d), "l_orderkey", "l_linenumber", "key", "value").select("key", "value", "pos")


def user_graph(spark: SparkSession, d: str) -> DataFrame:
    """Users who act one after the other, by kind of event and day; the smallest value is the weight."""
    from pyspark.sql import Window

    by = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    rows = _t(spark, d, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(by).alias("dst"), F.col("value").alias("w"))
    return rows.filter("dst IS NOT NULL").groupBy("src", "dst").agg(F.min("w").alias("weight"))


def chain_graph(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    n = part.count()
    return part.filter((F.col("p_partkey") % 16 != 15) & (F.col("p_partkey") + 1 < n)).select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"), F.col("p_size").cast("double").alias("weight"))


def supply_graph(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "supplier").count()
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + n).alias("dst"), "l_quantity")
    return rows.groupBy("src", "dst").agg(F.min("l_quantity").alias("weight"))


def numbered_edges(spark: SparkSession, d: str) -> DataFrame:
    return W.numbered(user_graph(spark, d), "src", "dst")


# aggregates --------------------------------------------------------------------------------------------------------


@_query("WITH " + KV + " SELECT key, count(*) AS cnt, CAST(sum(value) AS BIGINT) AS sum, CAST(sum(value * value) AS BIGINT) AS sumsq FROM kv GROUP BY key")
def a1_hash_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return A.key_aggregate(key_values(spark, d))


@_query(
    "SELECT CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_partkey END AS key, count(*) AS cnt, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum, "
    "CAST(sum(CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT)) AS BIGINT) AS sumsq FROM lineitem GROUP BY 1"
)
def a1_hash_aggregate_skewed(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 2 == 0, F.lit(0).cast("long")).otherwise(F.col("l_partkey")).alias("key"), F.col("l_quantity").cast("long").alias("value"))
    return A.key_aggregate(rows)


@_query("WITH " + KV + ", a AS (SELECT key, count(*) AS cnt, CAST(sum(value) AS BIGINT) AS sum, CAST(sum(value * value) AS BIGINT) AS sumsq FROM kv GROUP BY key) SELECT key, cnt, sum, sumsq, round(sum / cnt, 6) AS mean, round(sumsq / cnt - (sum / cnt) * (sum / cnt), 6) AS variance FROM a")
def a1_derived_moments(spark: SparkSession, d: str) -> DataFrame:
    return A.key_aggregate(key_values(spark, d), derived=True).withColumn("mean", F.round("mean", 6)).withColumn("variance", F.round("variance", 6))


@_query("WITH " + KV + " SELECT key, count(*) AS cnt, CAST(sum(value) AS BIGINT) AS sum, CAST(sum(value * value) AS BIGINT) AS sumsq FROM kv WHERE key = (SELECT key FROM kv ORDER BY l_orderkey, l_linenumber, key, value LIMIT 1) GROUP BY key")
def k1_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = key_values(spark, d)
    first = rows.agg(F.min_by("key", F.struct("l_orderkey", "l_linenumber", "key", "value")).alias("key"))
    return A.key_aggregate(rows.join(F.broadcast(first), "key", "left_semi"))  # first is one row


@_query("SELECT (l_partkey * 2654435769 % 4294967296) >> 20 AS slot, count(*) AS cnt FROM lineitem GROUP BY 1")
def p1_multiplicative_hash(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").groupBy(S.multiplicative_hash(F.col("l_partkey"), 20).alias("slot")).agg(F.count("*").alias("cnt"))


_OPS = {"add": "sum(v)", "sub": "1000.0 - sum(v)", "mul": "product(v)", "div": "1.0 / product(v)", "min": "min(v)", "max": "max(v)"}


@_query(
    "WITH r AS (SELECT l_suppkey AS key, 1 + l_tax / 1000 AS v FROM lineitem) SELECT key, "
    + ", ".join(f'round({sql}, 6) AS "{op}"' for op, sql in _OPS.items())
    + ", count(*) FILTER (WHERE v > 1.00004) AS count_if FROM r GROUP BY key"
)
def a7_scatter_reduce(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), (1 + F.col("l_tax") / 1000).alias("v"))
    wanted = {op: ("v", op, {"sub": 1000.0}.get(op)) for op in _OPS} | {"count_if": (F.col("v") > 1.00004, "count_if", None)}
    out = A.scatter_reduces(rows, "key", wanted)
    return out.select("key", *(F.round(op, 6).alias(op) for op in _OPS), "count_if")


@_query("WITH " + POS + " SELECT pos // 16 AS block, key, min(pos) AS first, CAST(sum(value) AS BIGINT) AS value FROM p GROUP BY 1, 2")
def a8_block_reduce(spark: SparkSession, d: str) -> DataFrame:
    return A.block_reduce(positioned(spark, d), "pos", "key", "value")


@_query("WITH " + DIR + " SELECT src AS node, count(*) AS degree FROM g GROUP BY 1")
def a10_out_degree(spark: SparkSession, d: str) -> DataFrame:
    return user_graph(spark, d).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


@_query("WITH " + DIR + ", x AS (SELECT n, count(*) AS degree FROM (SELECT src AS n FROM g UNION ALL SELECT dst FROM g) GROUP BY n) SELECT degree, count(*) AS nodes, (SELECT max(degree) FROM x) AS largest FROM x GROUP BY degree")
def a15_degree_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = W.degree_histogram(user_graph(spark, d))
    return rows.crossJoin(F.broadcast(rows.agg(F.max("degree").alias("largest"))))  # one row


# windows, sorts, sets ----------------------------------------------------------------------------------------------


@_query("WITH " + POS + " SELECT pos, key, row_number() OVER (PARTITION BY pos // 16, key ORDER BY pos) = 1 AS first FROM p")
def w1_first_in_block(spark: SparkSession, d: str) -> DataFrame:
    return A.first_in_block(positioned(spark, d), "pos", "key").select("pos", "key", "first")


@_query("WITH " + DIR + ", l AS (SELECT src AS node, count(*) AS n, CAST(string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS VARCHAR) AS partners FROM g GROUP BY 1) SELECT node, CAST(coalesce(sum(n) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", partners FROM l")
def w2_csr_offsets(spark: SparkSession, d: str) -> DataFrame:
    return W.csr(user_graph(spark, d)).withColumn("partners", F.array_join(F.col("partners").cast("array<string>"), ","))


@_query("WITH " + POS + ", b AS (SELECT pos - lag(pos) OVER (PARTITION BY key // 4 ORDER BY pos) AS back FROM p) SELECT count(back) AS reuses, count(*) FILTER (WHERE back <= 1000) AS near, round(avg(back) FILTER (WHERE back <= 1000), 6) AS mean_near FROM b")
def w3_reuse_distance(spark: SparkSession, d: str) -> DataFrame:
    return W.reuse_distance(positioned(spark, d), "pos", "key").withColumn("mean_near", F.round("mean_near", 6))


@_query("WITH " + BIP + " SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS pos FROM g")
def o1_edge_sort(spark: SparkSession, d: str) -> DataFrame:
    return W.numbered(supply_graph(spark, d), "src", "dst").select("src", "dst", "pos")


@_query("WITH " + DIR + ", x AS (SELECT n, count(*) AS degree FROM (SELECT src AS n FROM g UNION ALL SELECT dst FROM g) GROUP BY n) SELECT n AS old_id, row_number() OVER (ORDER BY degree DESC, n) - 1 AS new_id FROM x")
def o4_degree_sort(spark: SparkSession, d: str) -> DataFrame:
    return W.degree_order(user_graph(spark, d))


@_query("WITH " + BIP + " SELECT src, dst FROM g UNION SELECT dst, src FROM g")
def u2_symmetrise(spark: SparkSession, d: str) -> DataFrame:
    return W.symmetrise(supply_graph(spark, d).select("src", "dst"))


# joins -------------------------------------------------------------------------------------------------------------

_DEG = ", deg AS (SELECT src AS node, count(*) AS degree FROM g GROUP BY 1)"


@_query("WITH " + DIR + _DEG + " SELECT g.src, g.dst, round(1.0 / degree, 6) AS sent FROM g JOIN deg ON g.src = deg.node")
def j1_gather(spark: SparkSession, d: str) -> DataFrame:
    g = user_graph(spark, d)
    return J.gather(g.select("src", "dst"), "src", g.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))).select("src", "dst", F.round(F.lit(1.0) / F.col("degree"), 6).alias("sent"))


@_query("WITH " + CHAIN + _DEG + " SELECT src, dst, CASE WHEN weight > 25 AND degree IS NOT NULL THEN degree ELSE -1 END AS degree FROM g LEFT JOIN deg ON g.dst = deg.node")
def j2_masked_gather(spark: SparkSession, d: str) -> DataFrame:
    g = chain_graph(spark, d)
    state = g.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return J.masked_gather(g, F.col("weight") > 25, "dst", state, "degree", F.lit(-1)).select("src", "dst", "degree")


@_query("WITH " + DIR + " SELECT src, dst, weight FROM g WHERE src IN (SELECT dst FROM g WHERE weight < 5)")
def j3_frontier_expansion(spark: SparkSession, d: str) -> DataFrame:
    g = cut(user_graph(spark, d))
    return J.expand_frontier(g, g.filter("weight < 5").select(F.col("dst").alias("node"))).select("src", "dst", "weight")


@_query("WITH " + DIR + ", s AS (SELECT DISTINCT src AS node FROM g), m AS (SELECT dst AS node, min(weight) AS best FROM g GROUP BY 1 HAVING min(weight) < 10) SELECT node, coalesce(best, 99999999.0) AS value FROM s LEFT JOIN m USING (node)")
def j5_upsert(spark: SparkSession, d: str) -> DataFrame:
    g = cut(user_graph(spark, d))
    state = g.select(F.col("src").alias("node")).distinct().withColumn("value", F.lit(graphs.UNREACHED))
    best = A.scatter_reduce(g, "dst", "weight", "min", name="value").filter("value < 10").withColumnRenamed("dst", "node")
    return J.upsert(state, best, "node", "value")


def _lattice(name: str = "q") -> str:
    side = box_side(4 * CELLS**3)
    cell = side / CELLS
    point = f"SELECT i * 4 + o AS id, (i % {CELLS} + CASE WHEN o IN (2, 3) THEN 0.5 ELSE 0.0 END) * {cell!r} AS x, (i // {CELLS} % {CELLS} + CASE WHEN o IN (1, 3) THEN 0.5 ELSE 0.0 END) * {cell!r} AS y, (i // {CELLS * CELLS} + CASE WHEN o IN (1, 2) THEN 0.5 ELSE 0.0 END) * {cell!r} AS z FROM range({CELLS**3}) a(i), range(4) b(o)"
    moved = ", ".join(f"{c} + ((id * 3 + {a + 1}) * 2654435769 % 4294967296 / 4294967296.0::DOUBLE - 0.5::DOUBLE) * {JITTER * cell!r}::DOUBLE AS {c}" for a, c in enumerate("xyz"))
    wrapped = ", ".join(f"CASE WHEN {c} < 0 THEN {c} + {side!r}::DOUBLE WHEN {c} > {side!r} THEN {c} - {side!r}::DOUBLE ELSE {c} END AS {c}" for c in "xyz")
    point = point.replace("0.5 ", "0.5::DOUBLE ").replace("0.0 ", "0.0::DOUBLE ").replace(repr(cell), f"{cell!r}::DOUBLE")
    return f"l AS ({point}), m AS (SELECT id, {moved} FROM l), {name} AS (SELECT id, {wrapped} FROM m)"


def _pairs(radius: float, strict: bool = False) -> str:
    side = box_side(4 * CELLS**3)
    delta = ", ".join(f"CASE WHEN a.{c} - b.{c} < -{side / 2!r} THEN a.{c} - b.{c} + {side!r}::DOUBLE WHEN a.{c} - b.{c} > {side / 2!r} THEN a.{c} - b.{c} - {side!r}::DOUBLE ELSE a.{c} - b.{c} END AS d{c}" for c in "xyz")
    return f"w AS (SELECT a.id AS i, b.id AS j, {delta} FROM q a JOIN q b ON a.id < b.id), n AS (SELECT *, dx * dx + dy * dy + dz * dz AS rd FROM w WHERE dx * dx + dy * dy + dz * dz {'<' if strict else '<='} {radius * radius!r})"


def lattice(spark: SparkSession) -> DataFrame:
    return cut(G.fcc_lattice(spark, CELLS, JITTER))


_SETTINGS = particles.Settings(4 * CELLS**3)
_FORCE = ", f AS (SELECT *, (1.0::DOUBLE / rd) AS r FROM n), k AS (SELECT *, r * r * r * r * r * r * r - 0.5::DOUBLE * r * r * r * r AS push FROM f), s AS (SELECT i AS id, dx * push AS fx, dy * push AS fy, dz * push AS fz FROM k UNION ALL SELECT j, -dx * push, -dy * push, -dz * push FROM k)"


@_query("WITH " + _lattice() + ", " + _pairs(3.6) + " SELECT i, j FROM n")
def j7_periodic_range_join(spark: SparkSession, d: str) -> DataFrame:
    return J.near_pairs(lattice(spark), _SETTINGS.side, _SETTINGS.tolerance * _SETTINGS.cutoff)


@_query("WITH " + _lattice() + ", " + _pairs(2.4) + " SELECT i, j FROM n")
def j6_theta_self_join(spark: SparkSession, d: str) -> DataFrame:
    """Every pair is compared: what the range join is checked against on small sets."""
    return J.all_near_pairs(lattice(spark), _SETTINGS.side, 2.4)


@_query("WITH " + DIR + ", a AS (SELECT src AS i, dst AS j FROM g WHERE weight < 250), b AS (SELECT src AS i, dst AS j FROM g WHERE weight > 125) SELECT i, j, CASE WHEN a.i IS NULL THEN 'added' WHEN b.i IS NULL THEN 'removed' ELSE 'kept' END AS change FROM a FULL JOIN b USING (i, j)")
def j8_pair_delta(spark: SparkSession, d: str) -> DataFrame:
    g = cut(user_graph(spark, d)).select(F.col("src").alias("i"), F.col("dst").alias("j"), "weight")
    return J.pair_delta(g.filter("weight < 250"), g.filter("weight > 125"))


@_query("WITH " + DIR + ", x AS (SELECT n, count(*) AS degree FROM (SELECT src AS n FROM g UNION ALL SELECT dst FROM g) GROUP BY n), p AS (SELECT n, row_number() OVER (ORDER BY degree DESC, n) - 1 AS m FROM x) SELECT a.m AS src, b.m AS dst FROM g JOIN p a ON g.src = a.n JOIN p b ON g.dst = b.n")
def j9_relabel(spark: SparkSession, d: str) -> DataFrame:
    g = cut(user_graph(spark, d).select("src", "dst"))
    return J.relabel(g, W.degree_order(g))


_NEAR = "c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cid, embedding AS m FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 4)), w AS (SELECT vec_id, embedding, cid, sqrt(list_sum(list_transform(list_zip(embedding, m), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))) AS dist FROM embeddings, c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cid) AS k FROM w)"


@_query("WITH " + _NEAR + " SELECT vec_id, CAST(cid AS INTEGER) AS cid, round(dist, 6) AS distance FROM b WHERE k = 1")
def j11_nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    points = _t(spark, d, "embeddings")
    return J.nearest_centroid(points, cluster.lowest_ids(points, 4)).select("vec_id", "cid", F.round("distance", 6).alias("distance"))


@_query("WITH " + _NEAR + " SELECT CAST(cid AS INTEGER) AS cid, " + ", ".join(f"round(sum(CAST(embedding[{i}] AS DOUBLE)), 6) AS sum_{i}" for i in (1, 2, 3)) + ", count(*) AS n, round(sum(dist), 6) AS total FROM b WHERE k = 1 GROUP BY cid")
def g6_kmeans_pass(spark: SparkSession, d: str) -> DataFrame:
    points = _t(spark, d, "embeddings")
    out = cluster.kmeans_pass(points, cluster.lowest_ids(points, 4))
    return out.select("cid", *(F.round(f"sum_{i}", 6).alias(f"sum_{i}") for i in (1, 2, 3)), "n", F.round("total", 6).alias("total"))


# graphs ------------------------------------------------------------------------------------------------------------


def _rank_sql(graph: str, steps: int) -> str:
    return (
        f"WITH RECURSIVE {graph}, nodes AS (SELECT src AS node FROM g UNION SELECT dst FROM g), cn AS (SELECT count(*) AS n FROM nodes), deg AS (SELECT src, count(*) AS deg FROM g GROUP BY 1), "
        "pr(i, node, v) AS (SELECT 0, node, 1.0::DOUBLE FROM nodes UNION ALL SELECT i + 1, node, any_value(0.15::DOUBLE / n) + 0.85::DOUBLE * coalesce(sum(contrib), 0) FROM ("
        "SELECT p.i, e.dst AS node, p.v / deg.deg AS contrib, cn.n FROM pr p JOIN g e ON p.node = e.src JOIN deg ON deg.src = e.src, cn UNION ALL SELECT p.i, p.node, 0.0, cn.n FROM pr p, cn) "
        f"WHERE i < {steps} GROUP BY i, node) SELECT node, round(v, 6) AS rank FROM pr WHERE i = {steps}"
    )


def _search_sql(graph: str, start: str, message: str, better: str, worst: str, agg: str, name: str) -> str:
    return (
        f"WITH RECURSIVE {graph}, r(node, v) USING KEY (node) AS ({start} UNION SELECT e.dst, {agg}({message}) FROM r d JOIN g e ON d.node = e.src LEFT JOIN recurring.r o ON o.node = e.dst "
        f"GROUP BY e.dst, o.v HAVING {agg}({message}) {better} coalesce(o.v, {worst})) SELECT n.node, round(coalesce(v, {{}}), 6) AS {name} FROM (SELECT src AS node FROM g UNION SELECT dst FROM g) n LEFT JOIN r ON n.node = r.node"
    )


@_query(_rank_sql(DIR, 10))
def g1_page_rank(spark: SparkSession, d: str) -> DataFrame:
    return graphs.page_rank(user_graph(spark, d), 10).withColumn("rank", F.round("rank", 6))


@_query(
    _rank_sql(DIR, 60).replace("SELECT node, round(v, 6) AS rank FROM pr WHERE i = 60", "")
    + ", seen AS (SELECT i, v, lag(v) OVER (ORDER BY i) AS last FROM pr WHERE node = 0) SELECT round(v, 6) AS rank, CAST(i AS INTEGER) AS steps FROM seen WHERE abs(v - last) <= 0.05 * last ORDER BY i LIMIT 1"
)
def g1_page_rank_until(spark: SparkSession, d: str) -> DataFrame:
    """The rank of a probed node, and the steps until it changes by a twentieth at most."""
    state, steps = graphs.page_rank_until(user_graph(spark, d), probe=0, tolerance=0.05)
    return state.filter("node = 0").select(F.round("rank", 6).alias("rank"), F.lit(steps).alias("steps"))


_FROM_0 = "SELECT 0::BIGINT, 0.0::DOUBLE"
_WIDE_0 = "SELECT 0::BIGINT, 99999999.0::DOUBLE"


@_query(_search_sql(DIR, _FROM_0, "d.v + e.weight", "<", "'infinity'::DOUBLE", "min", "dist").format("99999999.0"))
def g2_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    return graphs.shortest_paths(user_graph(spark, d), 0, parity=True)[0].withColumn("dist", F.round("dist", 6))


@_query(_search_sql(CHAIN, _FROM_0, "d.v + e.weight", "<", "'infinity'::DOUBLE", "min", "dist").format("99999999.0"))
def g2_shortest_paths_chain(spark: SparkSession, d: str) -> DataFrame:
    return graphs.shortest_paths(chain_graph(spark, d), 0, parity=True)[0].withColumn("dist", F.round("dist", 6))


@_query(_search_sql(DIR, _WIDE_0, "least(d.v, e.weight)", ">", "0", "max", "width").format("0.0"))
def g3_widest_paths(spark: SparkSession, d: str) -> DataFrame:
    return graphs.widest_paths(user_graph(spark, d), 0, parity=True)[0].withColumn("width", F.round("width", 6))


_LABELS = (
    "WITH RECURSIVE {graph}, r(node, v) USING KEY (node) AS (SELECT n, n FROM (SELECT src AS n FROM g UNION SELECT dst FROM g) UNION SELECT e.dst, min(d.v) FROM r d JOIN {edges} e ON d.node = e.src "
    "JOIN recurring.r o ON o.node = e.dst GROUP BY e.dst, o.v HAVING min(d.v) < o.v) SELECT node, v AS comp FROM r"
)


@_query(_LABELS.format(graph=CHAIN, edges="g"))
def g4_label_spreading(spark: SparkSession, d: str) -> DataFrame:
    return graphs.spread_labels(chain_graph(spark, d))[0]


@_query(_LABELS.format(graph=CHAIN + ", h AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g)", edges="h"))
def g4_weak_components(spark: SparkSession, d: str) -> DataFrame:
    return graphs.weak_components(chain_graph(spark, d))


@_query(
    "WITH RECURSIVE " + CHAIN + ", far(node, d) AS (SELECT src, 0 FROM g WHERE src NOT IN (SELECT dst FROM g) UNION ALL SELECT g.dst, d + 1 FROM far JOIN g ON g.src = far.node) "
    "SELECT CAST(max(d) + 1 AS INTEGER) AS steps, (SELECT count(*) FROM g) AS edges FROM far"
)
def m4_step_count(spark: SparkSession, d: str) -> DataFrame:
    g = cut(chain_graph(spark, d))
    steps = graphs.spread_labels(g)[1]
    return g.agg(F.lit(steps).alias("steps"), F.count("*").alias("edges"))


@_query("WITH " + BIP + " SELECT DISTINCT src, dst FROM g")
def g8_csr_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return W.csr_edges(W.csr(supply_graph(spark, d)))


# particles ---------------------------------------------------------------------------------------------------------


@_query("WITH " + _lattice() + " SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM q")
def s12_lattice(spark: SparkSession, d: str) -> DataFrame:
    return G.fcc_lattice(spark, CELLS, JITTER).select("id", *(F.round(c, 6).alias(c) for c in "xyz"))


@_query("WITH " + _lattice() + " SELECT " + ", ".join(f"round({f}({c}), 6) AS {f}_{c}" for c in "xyz" for f in ("min", "max")) + " FROM q")
def a12_bounding_box(spark: SparkSession, d: str) -> DataFrame:
    return lattice(spark).agg(*(F.round(getattr(F, f)(c), 6).alias(f"{f}_{c}") for c in "xyz" for f in ("min", "max")))


@_query("WITH " + _lattice() + ", " + _pairs(3.0, True) + _FORCE + " SELECT id, round(sum(fx), 6) + 0.0::DOUBLE AS fx, round(sum(fy), 6) + 0.0::DOUBLE AS fy, round(sum(fz), 6) + 0.0::DOUBLE AS fz FROM s GROUP BY id")
def a6_pair_forces(spark: SparkSession, d: str) -> DataFrame:
    rows = lattice(spark)
    pairs = J.near_pairs(rows, _SETTINGS.side, _SETTINGS.tolerance * _SETTINGS.cutoff)
    found = particles.forces(rows, pairs, _SETTINGS)
    return found.select("id", *((F.round(f, 6) + 0.0).alias(f) for f in ("fx", "fy", "fz")))  # 0.0 also for -0.0


_HALF = repr(_SETTINGS.step**2 / 2)


@_query("WITH " + _lattice() + ", " + _pairs(3.0, True) + _FORCE + f", t AS (SELECT id, sum(fx) * {_HALF} AS fx, sum(fy) * {_HALF} AS fy, sum(fz) * {_HALF} AS fz FROM s GROUP BY id), v AS (SELECT fx * fx + fy * fy + fz * fz AS e FROM t) SELECT round(sum(e) / {_SETTINGS.step**2!r}, 6) AS ekin, round(sum(sqrt(e)) / {_SETTINGS.step!r}, 6) AS vel, count(*) FILTER (WHERE sqrt(e) > {_SETTINGS.usual_speed * _SETTINGS.step!r}) AS fast FROM v")
def g5_dynamics_step(spark: SparkSession, d: str) -> DataFrame:
    """One step from rest, and its observables."""
    still = lattice(spark).select("id", *"xyz", *(F.lit(0.0).alias(f"vh{c}") for c in "xyz"))
    state = particles.simulate(still, _SETTINGS, 1)
    return particles.observables(state, _SETTINGS).select(F.round("ekin", 6).alias("ekin"), F.round("vel", 6).alias("vel"), "fast")


#: A draw in [0, 1), as uniform() makes it.
_DRAW = "CAST('0x' || substr(md5('{}:' || {}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


def _velocities(points: str) -> str:
    draws = ", ".join(f"sqrt(-2 * ln(1 - {_DRAW.format('velocity' + c + 'r', 'id')})) * cos(2 * pi() * {_DRAW.format('velocity' + c + 'a', 'id')}) AS u{c}" for c in "xyz")
    centred = ", ".join(f"u{c} - avg(u{c}) OVER () AS u{c}" for c in "xyz")
    scaled = ", ".join(f"u{c} * 0.016 * sqrt(0.722 * 3 * (n - 1) / e) AS vh{c}" for c in "xyz")
    return f"vu AS (SELECT id, {draws} FROM {points}), vw AS (SELECT id, {centred} FROM vu), vt AS (SELECT count(*) AS n, sum(ux * ux + uy * uy + uz * uz) AS e FROM vw), vel AS (SELECT id, {scaled} FROM vw, vt)"


def _moved() -> str:
    """q: the particles of q0 after one move by vel."""
    at = ", ".join(f"CASE WHEN {c} + vh{c} < 0 THEN {c} + vh{c} + {_SETTINGS.side!r}::DOUBLE WHEN {c} + vh{c} > {_SETTINGS.side!r} THEN {c} + vh{c} - {_SETTINGS.side!r}::DOUBLE ELSE {c} + vh{c} END AS {c}" for c in "xyz")
    return f"q AS (SELECT id, {at} FROM q0 JOIN vel USING (id))"


def _observed(e: str) -> str:
    return f"sum({e}) / {_SETTINGS.step**2!r} AS ekin, sum(sqrt({e})) / {_SETTINGS.step!r} AS vel, count(*) FILTER (WHERE sqrt({e}) > {_SETTINGS.usual_speed * _SETTINGS.step!r}) AS fast"


@_query(
    f"WITH {_lattice('q0')}, {_velocities('q0')}, {_moved()}, {_pairs(3.0, True)}{_FORCE}, t AS (SELECT id, sum(fx) * {_HALF} AS fx, sum(fy) * {_HALF} AS fy, sum(fz) * {_HALF} AS fz FROM s GROUP BY id), "
    + "v AS (SELECT " + " + ".join(f"pow(vh{c} + coalesce(f{c}, 0), 2)" for c in "xyz") + f" AS e FROM vel LEFT JOIN t USING (id)), o AS (SELECT {_observed('e')} FROM v) SELECT round(ekin, 6) AS ekin, round(vel, 6) AS vel, fast FROM o"
)
def g5_dynamics_moving_step(spark: SparkSession, d: str) -> DataFrame:
    """One step with velocities: particles move, wrap and push each other."""
    state = particles.simulate(G.velocities(lattice(spark)), _SETTINGS, 1)
    return particles.observables(state, _SETTINGS).select(F.round("ekin", 6).alias("ekin"), F.round("vel", 6).alias("vel"), "fast")


_REPORT = {"ek": "24 * ekin", "epot": "4 * e", "etot": "24 * ekin + 4 * e", "temp": "ekin * (16.0::DOUBLE / (c - 1))", "pres": "0.83134::DOUBLE * 16 * (ekin - v) / c", "vel": "vel / c", "rp": "fast / c * 100"}


@_query(
    f"WITH {_lattice()}, {_velocities('q')}, {_pairs(3.0, True)}, f AS (SELECT rd, 1.0::DOUBLE / rd AS r FROM n), p AS (SELECT sum(pow(r, 6) - pow(r, 3)) AS e, sum(rd * (pow(r, 7) - 0.5::DOUBLE * pow(r, 4))) AS v FROM f), "
    + f"h AS (SELECT vhx * vhx + vhy * vhy + vhz * vhz AS e FROM vel), o AS (SELECT {_observed('e')}, count(*)::DOUBLE AS c FROM h) SELECT " + ", ".join(f"round({sql}, 4) AS {name}" for name, sql in _REPORT.items()) + " FROM p, o"
)
def k5_physics_report(spark: SparkSession, d: str) -> DataFrame:
    """Energies, temperature, pressure and speeds of the particles at the start."""
    state = G.velocities(lattice(spark))
    found = particles.report(state, J.near_pairs(state, _SETTINGS.side, _SETTINGS.tolerance * _SETTINGS.cutoff), _SETTINGS)
    return found.select(*(F.round(c, 4).alias(c) for c in _REPORT))


@_query()
def g5_dynamics_run(spark: SparkSession, d: str) -> DataFrame:
    """Five steps with velocities, pairs made anew every two."""
    return particles.simulate(G.velocities(lattice(spark)), _SETTINGS, 5, rebuild_every=2)


# layouts and relabellings ------------------------------------------------------------------------------------------


@_query("SELECT tx, ty, count(*) AS edges FROM (WITH " + BIP + " SELECT src // 512 AS tx, dst // 512 AS ty FROM g) GROUP BY 1, 2")
def r1_tiles(spark: SparkSession, d: str) -> DataFrame:
    return layout.tile(supply_graph(spark, d), 512).groupBy("tx", "ty").agg(F.count("*").alias("edges"))


_GROUPS = "WITH " + DIR + ", " + NUMBERED + ", l AS (SELECT src, dst, src // 64 AS tx, dst // 64 AS ty, row_number() OVER (PARTITION BY src // 64, dst // 64, dst ORDER BY pos) - 1 AS layer FROM e)"


@_query(_GROUPS + " SELECT src, dst, layer, (row_number() OVER (PARTITION BY tx, ty, layer ORDER BY dst) - 1) // 16 AS \"group\" FROM l")
def r2_conflict_free_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = layout.conflict_free_groups(layout.tile(numbered_edges(spark, d), 64))
    return rows.select("src", "dst", F.col("layer").cast("long").alias("layer"), "group")


@_query(_GROUPS + ", c AS (SELECT count(*) AS n FROM l GROUP BY tx, ty, layer) SELECT CAST(sum(n) AS BIGINT) AS edges, CAST(sum((n + 15) // 16 * 16) AS BIGINT) AS padded FROM c")
def m3_padded_edges(spark: SparkSession, d: str) -> DataFrame:
    return layout.padded_edges(layout.conflict_free_groups(layout.tile(numbered_edges(spark, d), 64)))


@_query("WITH " + DIR + ", x AS (SELECT n, count(*) AS degree FROM (SELECT src AS n FROM g UNION ALL SELECT dst FROM g) GROUP BY n) SELECT row_number() OVER (ORDER BY degree DESC, n) - 1 AS node, n AS back, degree FROM x")
def j10_reposition(spark: SparkSession, d: str) -> DataFrame:
    """Rows moved to their new numbers, and the old ones that moving back gives."""
    g = cut(user_graph(spark, d).select("src", "dst"))
    degrees = g.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    order = cut(W.degree_order(g))
    moved = J.reposition(degrees, order)
    return moved.join(J.reposition(moved.select("node", F.col("node").alias("new")), order, inverse=True).select(F.col("new").alias("node"), F.col("node").alias("back")), "node").select("node", "back", "degree")


@_query("WITH " + DIR + ", " + NUMBERED + " SELECT src, dst, row_number() OVER (ORDER BY src // 64, dst // 64, pos) - 1 AS place FROM e")
def o6_tile_order(spark: SparkSession, d: str) -> DataFrame:
    return W.numbered(layout.lay_out_tiles(numbered_edges(spark, d), 64, "pos"), "tx", "ty", "pos", name="place").select("src", "dst", "place")


@_query("SELECT p_partkey AS old_id, row_number() OVER (ORDER BY p_size % 4, p_partkey) - 1 AS new_id FROM part")
def r5_by_part(spark: SparkSession, d: str) -> DataFrame:
    return reorder.by_part(_t(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 4).alias("part")))


@_query(
    "WITH " + DIR + ", x AS (SELECT n, count(*) AS degree FROM (SELECT src AS n FROM g UNION ALL SELECT dst FROM g) GROUP BY n), p AS (SELECT n, row_number() OVER (ORDER BY degree DESC, n) - 1 AS m FROM x), "
    "r AS (SELECT a.m AS src, b.m AS dst FROM g JOIN p a ON g.src = a.n JOIN p b ON g.dst = b.n) SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS place FROM r"
)
def r12_adjust_edges(spark: SparkSession, d: str) -> DataFrame:
    g = cut(user_graph(spark, d).select("src", "dst"))
    return W.numbered(reorder.adjust_edges(g, W.degree_order(g)), "src", "dst", name="place")


@_query("WITH " + DIR + ", t AS (SELECT src // 64 AS tx, dst // 64 AS ty, count(*) AS edges FROM g GROUP BY 1, 2) SELECT tx, ty, edges, 0::BIGINT AS conflicts FROM t")
def r3_pair_groups_without_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """By tile: its edges, and the ends that a group of it has twice."""
    rows = layout.tile(layout.pair_groups(layout.tile(numbered_edges(spark, d).select("src", "dst", "pos"), 64)).select("src", "dst", "group"), 64)
    rows = cut(rows)
    ends = rows.select("tx", "ty", "group", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node")).groupBy("tx", "ty", "group", "node").agg(F.count("*").alias("n"))
    twice = ends.groupBy("tx", "ty").agg(F.count_if(F.col("n") > 1).alias("conflicts"))
    return rows.groupBy("tx", "ty").agg(F.count("*").alias("edges")).join(twice, ["tx", "ty"])


@_query()
def r3_pair_groups(spark: SparkSession, d: str) -> DataFrame:
    return layout.pair_groups(layout.tile(numbered_edges(spark, d).select("src", "dst", "pos"), 64)).select("src", "dst", "pos", "group")


@_query(
    "WITH " + _lattice() + ", a AS (SELECT *, row_number() OVER (ORDER BY x, y, z, id) - 1 AS p FROM q), b AS (SELECT *, p >= 1024 AS h FROM a), "
    "c AS (SELECT *, row_number() OVER (ORDER BY h, y, z, x, id) - 1 AS p2 FROM b) SELECT id AS old_id, p2 AS new_id FROM c"
)
def r4_recursive_bisection(spark: SparkSession, d: str) -> DataFrame:
    return reorder.recursive_bisection(lattice(spark), 2)


@_query()
def r6_clustered_order(spark: SparkSession, d: str) -> DataFrame:
    return reorder.clustered(cut(chain_graph(spark, d).select("src", "dst")), passes=2, rounds=1)


@_query("WITH " + DIR + ", " + NUMBERED + ", t AS (SELECT n, min(k) AS k FROM (SELECT src AS n, pos * 2 AS k FROM e UNION ALL SELECT dst, pos * 2 + 1 FROM e) GROUP BY n) SELECT n AS old_id, row_number() OVER (ORDER BY k) - 1 AS new_id FROM t")
def r7_first_touch(spark: SparkSession, d: str) -> DataFrame:
    return reorder.first_touch(numbered_edges(spark, d))


@_query()
def r8_breadth_first(spark: SparkSession, d: str) -> DataFrame:
    return reorder.breadth_first(numbered_edges(spark, d))


@_query("WITH " + DIR + " SELECT src, dst FROM g WHERE src // 16 <> dst // 16")
def r9_without_local(spark: SparkSession, d: str) -> DataFrame:
    return reorder.without_local(user_graph(spark, d), lambda n: F.floor(n / 16)).select("src", "dst")


@_query("WITH " + DIR + " SELECT src, dst, CASE WHEN src BETWEEN 10 AND 59 AND dst BETWEEN 10 AND 59 THEN 'both' WHEN src BETWEEN 10 AND 59 THEN 'left' WHEN dst BETWEEN 10 AND 59 THEN 'right' ELSE 'none' END AS owned FROM g")
def r10_ownership(spark: SparkSession, d: str) -> DataFrame:
    return reorder.ownership(user_graph(spark, d), 10, 60).select("src", "dst", "owned")




@_query("WITH n AS (SELECT p_partkey AS node, row_number() OVER (ORDER BY " + _DRAW.format("swap", "p_partkey") + ", p_partkey) - 1 AS at FROM part), c AS (SELECT count(*) * 20 // 100 // 2 AS pairs FROM part) SELECT n.node AS old_id, coalesce(m.node, n.node) AS new_id FROM n CROSS JOIN c LEFT JOIN n m ON n.at // 2 < c.pairs AND m.at = n.at + CASE WHEN n.at % 2 = 0 THEN 1 ELSE -1 END")
def r11_random_swaps(spark: SparkSession, d: str) -> DataFrame:
    return reorder.random_swaps(_t(spark, d, "part").select(F.col("p_partkey").alias("node")), 20)


@_query("WITH v AS (SELECT p_partkey % 40 AS i, p_partkey // 40 AS j, CAST(p_size AS DOUBLE) AS v FROM part) SELECT a.i, a.j, any_value(a.v) AS v, coalesce(sum(b.v), 0) AS around FROM v a LEFT JOIN v b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY a.i, a.j")
def g7_stencil(spark: SparkSession, d: str) -> DataFrame:
    grid = _t(spark, d, "part").select((F.col("p_partkey") % 40).alias("i"), F.floor(F.col("p_partkey") / 40).alias("j"), F.col("p_size").cast("double").alias("v"))
    return layout.stencil(grid, [(0, 1), (0, -1), (1, 0), (-1, 0)])


# metrics -----------------------------------------------------------------------------------------------------------


@_query("WITH " + POS + ", c AS (SELECT count(*) AS n FROM p GROUP BY pos // 16, key) SELECT round(16.0 * count(*) FILTER (WHERE n >= 2) / sum(n), 6) AS overhead FROM c")
def m2_conflict_overhead(spark: SparkSession, d: str) -> DataFrame:
    return A.conflict_overhead(positioned(spark, d), "pos", "key").withColumn("overhead", F.round("overhead", 6))


@_query("WITH " + POS + ", c AS (SELECT pos // 16 AS b, count(*) AS n FROM p GROUP BY pos // 16, key), x AS (SELECT sum(n) AS n, max(n) AS m FROM c GROUP BY b) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(m) AS BIGINT) AS passes, round(sum(n) / (16.0 * sum(m)), 6) AS utilisation FROM x")
def m1_lane_utilisation(spark: SparkSession, d: str) -> DataFrame:
    return A.lane_utilisation(positioned(spark, d), "pos", "key").withColumn("utilisation", F.round("utilisation", 6))


@_query("WITH " + POS + ", c AS (SELECT count(*) AS n FROM p GROUP BY pos // 16, key) SELECT round(16.0 * count(*) FILTER (WHERE n >= 3) / sum(n), 6) AS overhead FROM c")
def m2_overhead_of_three(spark: SparkSession, d: str) -> DataFrame:
    return A.conflict_overhead(positioned(spark, d), "pos", "key", least=3).withColumn("overhead", F.round("overhead", 6))


# scalar functions --------------------------------------------------------------------------------------------------

_LANES = "l AS (SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN 'NaN'::DOUBLE ELSE value END AS a, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE ELSE 250.0 END AS b FROM events)"


def _lanes(spark: SparkSession, d: str) -> DataFrame:
    nan = F.lit(float("nan"))
    return _t(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 == 0, nan).otherwise(F.col("value")).alias("a"), F.when(F.col("event_id") % 7 == 0, nan).otherwise(F.lit(250.0)).alias("b"))


@_query("WITH " + _LANES + " SELECT user_id, count(*) FILTER (WHERE isnan(a) OR isnan(b)) AS unordered, count(*) FILTER (WHERE isnan(a) OR isnan(b) OR a >= b) AS not_less, count(*) FILTER (WHERE isnan(a) OR isnan(b) OR a > b) AS not_less_equal FROM l GROUP BY 1")
def p24_unordered_comparisons(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _lanes(spark, d).groupBy("user_id").agg(*(F.count_if(f(a, b)).alias(f.__name__) for f in (S.unordered, S.not_less, S.not_less_equal)))


@_query("SELECT l_orderkey, l_linenumber, least(greatest(l_partkey * 2000000 + l_suppkey, -2147483648), 2147483647) AS up, least(greatest(l_suppkey - l_partkey * 2000000, -2147483648), 2147483647) AS down, CASE WHEN l_quantity > 25 THEN l_partkey ELSE l_suppkey END AS chosen FROM lineitem")
def p25_saturating_and_masked(spark: SparkSession, d: str) -> DataFrame:
    big, small = F.col("l_partkey") * 2_000_000, F.col("l_suppkey")
    rows = _t(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", S.saturating_add(big, small).alias("up"), S.saturating_sub(small, big).alias("down"), S.masked(F.col("l_quantity") > 25, F.col("l_partkey"), F.col("l_suppkey")).alias("chosen"))


# files -------------------------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"


@_query("WITH " + KV + " SELECT key, count(*) AS cnt, CAST(sum(value) AS BIGINT) AS sum, CAST(sum(value * value) AS BIGINT) AS sumsq FROM kv GROUP BY key")
def s1_key_value_file(spark: SparkSession, d: str) -> DataFrame:
    """Key-value lines, written and read back, aggregated."""
    path = _scratch(spark, "kv")
    key_values(spark, d).select(F.concat_ws(" ", "key", "value").alias("value")).write.text(path)
    return A.key_aggregate(R.read_key_values(spark, path))


@_query("WITH " + DIR + " SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, round(weight, 6) AS weight, (SELECT count(*) FROM (SELECT src FROM g UNION SELECT dst FROM g)) AS nodes FROM g")
def s2_weighted_edge_file(spark: SparkSession, d: str) -> DataFrame:
    """Weighted edges, written with a header and read back."""
    g, path = cut(user_graph(spark, d)), _scratch(spark, "edges")
    R.write_edges(g.select("src", "dst", "weight"), path, graphs.nodes_of(g).count())
    rows, nodes = R.read_weighted_edges(spark, path)
    return rows.select("src", "dst", F.round("weight", 6).alias("weight"), F.lit(nodes).cast("long").alias("nodes"))


@_query("WITH " + BIP + " SELECT CAST(src AS INTEGER) AS src, count(*) AS degree FROM g GROUP BY 1")
def s3_edge_file_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Edges without weights, written with a header, read back, and their out-degrees."""
    g, path = cut(supply_graph(spark, d)), _scratch(spark, "links")
    R.write_edges(g.select("src", "dst"), path, graphs.nodes_of(g).count())
    return R.out_degrees(R.read_edges(spark, path)[0])


def _write_mesh(g: DataFrame, path: str) -> None:
    """A comment, the line "nodes edges" and a line of 1-based neighbours for each node."""
    n, lines = g.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1, g.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list(F.col("dst") + 1)), " ").alias("line"))
    rows = g.sparkSession.range(n).join(lines, F.col("id") == F.col("src"), "left").select("id", F.coalesce("line", F.lit("")).alias("value"))
    head = g.sparkSession.createDataFrame([(-2, "% neighbours"), (-1, f"{n} {g.count()}")], "id long, value string")
    rows.unionByName(head).orderBy("id").select("value").write.text(path)


@_query("WITH " + DIR + " SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM g")
def s4_mesh_file(spark: SparkSession, d: str) -> DataFrame:
    """A mesh, written as lines of neighbours and read back."""
    path = _scratch(spark, "mesh")
    _write_mesh(cut(user_graph(spark, d)), path)
    return R.read_mesh(spark, path)[0]


@_query("WITH " + DIR + ", h AS (SELECT src AS node, list(dst ORDER BY dst) AS partners FROM g WHERE dst >= src GROUP BY src) SELECT CAST(node AS INTEGER) AS node, CAST(coalesce(sum(len(partners)) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, array_to_string(partners, ' ') AS partners FROM h")
def s5_mesh_file_csr(spark: SparkSession, d: str) -> DataFrame:
    """A mesh read with each edge once, as offsets and partners."""
    path = _scratch(spark, "mesh")
    _write_mesh(cut(user_graph(spark, d)), path)
    return W.csr(R.read_mesh(spark, path, once=True)[0]).withColumn("partners", F.array_join("partners", " "))


@_query("WITH " + _lattice() + " SELECT id, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y, round(z, 6) + 0.0::DOUBLE AS z FROM q")
def s6_coordinates_file(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates, written in the order of particles and numbered again when they are read."""
    path = _scratch(spark, "coordinates")
    lattice(spark).orderBy("id").select(F.concat_ws(" ", *"xyz").alias("value")).write.text(path)
    return R.read_coordinates(spark, path, 4 * CELLS**3).select("id", *((F.round(c, 6) + 0.0).alias(c) for c in "xyz"))


# generators --------------------------------------------------------------------------------------------------------


def _generated(key: str, top: int, rows: int, seed: str) -> str:
    return f"SELECT key, count(*) AS cnt, CAST(sum(value) AS BIGINT) AS sum, CAST(sum(value * value) AS BIGINT) AS sumsq FROM (SELECT {key} AS key, 1 + CAST(floor({_DRAW.format(seed + 'v', 'i')} * {top}) AS BIGINT) AS value FROM range({rows}) r(i)) GROUP BY key"


@_query(_generated(f"CASE WHEN {_DRAW.format('hitterh', 'i')} < 0.5 THEN 0 ELSE 1 + CAST(floor({_DRAW.format('hitterk', 'i')} * 63) AS BIGINT) END", 5, 50000, "hitter"))
def s9_heavy_hitter(spark: SparkSession, d: str) -> DataFrame:
    return A.key_aggregate(G.heavy_hitter(spark, 50_000, 64))


@_query(_generated(f"CAST(floor(i // 64 * 1024 / {2 * 782}.0) AS BIGINT) + CAST(floor({_DRAW.format('clusterk', 'i')} * 17) AS BIGINT)", 5, 50000, "cluster"))
def s10_moving_cluster(spark: SparkSession, d: str) -> DataFrame:
    return A.key_aggregate(G.moving_cluster(spark, 50_000, 1024))


_ZIPF = [r**-2.0 for r in range(1, 65)]
_CDF = [sum(_ZIPF[: i + 1]) / sum(_ZIPF) for i in range(63)]


@_query(_generated(f"(SELECT count(*) FROM unnest({json.dumps(_CDF)}::DOUBLE[]) u(x) WHERE x <= {_DRAW.format('zipfk', 'i')})", 3, 5000, "zipf"))
def s11_zipf(spark: SparkSession, d: str) -> DataFrame:
    return A.key_aggregate(G.zipf(spark, 5_000, 64))


@_query(f"WITH {_lattice()}, {_velocities('q')} SELECT id, " + ", ".join(f"round(vh{c}, 6) + 0.0::DOUBLE AS vh{c}" for c in "xyz") + " FROM vel")
def s13_velocities(spark: SparkSession, d: str) -> DataFrame:
    return G.velocities(lattice(spark)).select("id", *((F.round(f"vh{c}", 6) + 0.0).alias(f"vh{c}") for c in "xyz"))
