"""Invariants and hand-made cases of the engine."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import queries as Q
from tessera.functions import scalar as S
from tessera.operators import aggregate as A
from tessera.operators import joins as J
from tessera.operators import windows as W
from tessera.plans import cluster, graphs, layout, particles, reorder
from tessera.sources import generators as G
from tessera.sources import readers as R
from tessera.streaming import aggregate as T
from tests.compare import connect, differences


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edges(spark, *e):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in e], "src long, dst long, weight double")


def test_aggregate_takes_any_key_and_nothing(spark):
    df = spark.createDataFrame([(-1, 2), (None, 3), (-1, 4)], "key int, value int")
    assert sorted(map(tuple, A.key_aggregate(df).collect()), key=str) == sorted([(-1, 2, 6, 20), (None, 1, 3, 9)], key=str)
    assert A.key_aggregate(df.limit(0)).collect() == []


def test_aggregate_does_not_depend_on_partitions(spark):
    df = G.zipf(spark, 2000, 32)
    assert rows(A.key_aggregate(df.repartition(1))) == rows(A.key_aggregate(df.repartition(7)))
    total = A.key_aggregate(df).agg(F.sum("cnt"), F.min(F.col("sumsq") - F.col("sum") ** 2 / F.col("cnt"))).first()
    assert total[0] == 2000 and total[1] >= -1e-9


def test_widest_path_does_not_depend_on_edge_order(spark):
    for e in ([(0, 2, 5), (0, 2, 3)], [(0, 2, 3), (0, 2, 5)]):
        assert dict(rows(graphs.widest_paths(edges(spark, *e))[0])) == {0: graphs.UNREACHED, 2: 5.0}


def test_shortest_paths_meet_the_triangle_inequality(spark):
    e = edges(spark, (0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 1, 9), (3, 4, 1), (2, 1, 8))
    found, steps = graphs.shortest_paths(e)
    dist = dict(rows(found.fillna(math.inf)))
    assert dist == {0: 0, 1: 3, 2: 1, 3: math.inf, 4: math.inf} and steps == 3
    assert all(dist[r.dst] <= dist[r.src] + r.weight for r in e.collect())


def test_labels_follow_direction_unless_told_otherwise(spark):
    e = edges(spark, (2, 1, 1), (1, 0, 1))
    assert rows(graphs.spread_labels(e)[0]) == [(0, 0), (1, 1), (2, 2)]
    assert rows(graphs.spread_labels(e, directed=False)[0]) == [(0, 0), (1, 0), (2, 0)]


def test_page_rank_loses_what_dangling_nodes_hold(spark):
    assert dict(rows(graphs.page_rank(edges(spark, (0, 1, 1)), 1))) == pytest.approx({0: 0.075, 1: 0.925})
    state, steps = graphs.page_rank_until(edges(spark, (0, 1, 1), (1, 0, 1)), probe=1)
    assert steps >= 1 and state.count() == 2


def test_near_pairs_equal_all_pairs(spark):
    for b in (2, 4):
        p, side = G.fcc_lattice(spark, b, 0.2), G.box_side(4 * b**3)
        assert rows(J.near_pairs(p, side, 1.9)) == rows(J.all_near_pairs(p, side, 1.9))
    edge = spark.createDataFrame([(0, 0.1, 1.0, 1.0), (1, 9.9, 1.0, 1.0)], "id long, x double, y double, z double")
    assert rows(J.near_pairs(edge, 10.0, 1.0)) == [(0, 1)]


def test_forces_cancel_and_coinciding_particles_have_none(spark):
    p, s = G.fcc_lattice(spark, 3, 0.2), particles.Settings(108)
    pairs = J.near_pairs(p, s.side, 3.0)
    assert all(abs(x) < 1e-9 for x in particles.forces(p, pairs, s).agg(*(F.sum(f) for f in ("fx", "fy", "fz"))).first())
    same = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0)], "id long, x double, y double, z double")
    assert {r[1] for r in particles.forces(same, J.near_pairs(same, 10.0, 3.0), particles.Settings(2)).collect()} == {0.0}
    assert particles.report(G.velocities(p), pairs, s).first()["ek"] > 0


def test_velocities_have_no_drift(spark):
    v = G.velocities(G.fcc_lattice(spark, 3))
    assert all(abs(x) < 1e-12 for x in v.agg(*(F.avg(f"vh{c}") for c in "xyz")).first())


@pytest.mark.parametrize("method", ["none", "clustered", "breadth_first", "first_touch", "degree", "bisection", "partition"])
def test_every_relabelling_is_a_bijection(spark, method):
    e = W.numbered(edges(spark, (0, 3, 1), (3, 1, 1), (1, 2, 1), (5, 4, 1)), "src", "dst")
    points = spark.createDataFrame([(i, float(i * 7 % 6), float(i % 2), 0.0) for i in range(6)], "id long, x double, y double, z double")
    parts = spark.createDataFrame([(i, i % 2) for i in range(6)], "node long, part long")
    found = rows(reorder.reorder(method, e, points, parts, 2))
    assert [a for a, _ in found] == list(range(6)) and sorted(b for _, b in found) == list(range(6))


def test_breadth_first_follows_edge_order(spark):
    e = spark.createDataFrame([(0, 2, 0), (0, 1, 1), (1, 3, 2), (2, 4, 3), (6, 5, 4)], "src long, dst long, pos long")
    assert dict(rows(reorder.breadth_first(e, reverse=False))) == {0: 0, 2: 1, 1: 2, 4: 3, 3: 4, 5: 5, 6: 6}


def test_groups_have_no_target_twice(spark):
    e = W.numbered(edges(spark, *((i, i * 7 % 5, 1) for i in range(60))), "src", "dst")
    for found in (layout.conflict_free_groups(layout.tile(e, 64)).withColumn("g", F.concat_ws("-", "layer", "group")), layout.pair_groups(layout.tile(e.select("src", "dst", "pos"), 64)).withColumn("g", F.col("group"))):
        assert found.count() == 60 and found.groupBy("tx", "ty", "g", "dst").count().agg(F.max("count")).first()[0] == 1
        assert found.groupBy("tx", "ty", "g").count().agg(F.max("count")).first()[0] <= 16


def test_swaps_are_their_own_inverse(spark):
    found = dict(rows(reorder.random_swaps(spark.range(50).withColumnRenamed("id", "node"), 40)))
    assert all(found[b] == a for a, b in found.items()) and sum(a != b for a, b in found.items()) == 20


def test_columns_and_rows_round_trip(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (4, 5.0, 6.0)], "id long, x double, y double")
    assert rows(layout.to_rows(layout.to_columns(df, "id", ["x", "y"]), "id", ["x", "y"])) == rows(df)


def test_kmeans_keeps_empty_clusters(spark):
    points = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate((0, 0, 10, 11))], "vec_id long, embedding array<double>")
    assert cluster.kmeans(points, 2, 1) == [(0, [5.25]), (1, [0.0])]
    assert cluster.kmeans(points, 2, 3) == [(0, [10.5]), (1, [0.0])]


def test_scalar_functions(spark):
    one = spark.createDataFrame([(float("nan"), 1.0, 2147483647)], "a double, b double, i int")
    a, b, i = F.col("a"), F.col("b"), F.col("i")
    got = one.select(S.unordered(a, b), S.ordered(a, b), S.not_less(a, b), S.not_less_equal(b, a), S.saturating_add(i, i), S.saturating_sub(-i, i), S.masked(b > 0, F.lit(1), F.lit(2)), S.safe_divide(b, F.lit(0.0)), S.multiplicative_hash(F.lit(-1), 16)).first()
    assert tuple(got) == (True, False, True, True, 2147483647, -2147483648, 1, None, (-2654435769 % 2**32) >> 16)


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert rows(R.read_key_values(spark, put("kv", "1 2\n 3   4 \nx y\n"))) == [(1, 2), (3, 4)]
    e, n = R.read_weighted_edges(spark, put("e", "3 2\n0 1 0.5\n1 2 1.5\n"))
    assert rows(e) == [(0, 1, 0.5), (1, 2, 1.5)] and n == 3
    with pytest.raises(ValueError, match="header says"):
        R.read_weighted_edges(spark, put("bad", "3 3\n0 1 0.5\n"))
    assert rows(R.read_edges(spark, put("u", "3 2\n0 1\n1 2\n"))[0]) == [(0, 1), (1, 2)]
    mesh = put("m", "% note\n3 4\n2 3\n1\n1 0 9")
    assert rows(R.read_mesh(spark, mesh)[0]) == [(0, 1), (0, 2), (1, 0), (2, 0)]
    assert rows(R.read_mesh(spark, mesh, once=True)[0]) == [(0, 1), (0, 2)]
    assert rows(R.read_coordinates(spark, put("c", "1 2 3\n4 5 6\n"), 2)) == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)]
    assert R.read_run_config("16\n100\n20\n3.0\nmesh\nxyz\n5\n0\n10\n").rebuild_every == 20
    assert rows(R.out_degrees(e)) == [(0, 1), (1, 1)]


def test_lines_keep_their_numbers_in_many_splits(spark, tmp_path):
    (tmp_path / "c").write_text("".join(f"{i}  0 {i}.5\n\n" for i in range(3000)))
    (tmp_path / "m").write_text("% note\n%\n3000 2999\n" + "".join(f" {i}\n" if i else "\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert R.read_coordinates(spark, str(tmp_path / "c"), 3000).filter("x <> id OR z <> id + 0.5").count() == 0
        assert rows(R.read_mesh(spark, str(tmp_path / "m"))[0]) == [(i, i - 1) for i in range(1, 3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def folder_of(tmp_path, *texts):
    """A folder of files, later ones larger, as a sorted write makes it."""
    (tmp_path / "parts").mkdir()
    for i, text in enumerate(texts):
        (tmp_path / "parts" / f"part-{i:05}").write_text(text)
    return str(tmp_path / "parts")


def test_header_is_in_the_first_file_and_not_the_largest(spark, tmp_path):
    mesh = folder_of(tmp_path, "% note\n4 6\n2\n", "1 3 4\n\n", "1    2                      0\n")
    found, nodes = R.read_mesh(spark, mesh)
    assert nodes == 4 and rows(found) == [(0, 1), (1, 0), (1, 2), (1, 3), (3, 0), (3, 1)]


def test_mesh_read_once_keeps_every_line_of_a_folder(spark, tmp_path):
    mesh = folder_of(tmp_path, "% note\n5 8\n2\n", "1 3 4\n2\n", "2 5                        0\n4\n")
    lists = W.csr(R.read_mesh(spark, mesh, once=True)[0]).orderBy("node").collect()
    assert [(r.node, r.offset, r.partners) for r in lists] == [(0, 0, [1]), (1, 1, [2, 3]), (3, 3, [4])]


def test_mesh_written_in_several_files_equals_sql(spark, tmp_path):
    duckdb.execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, 300 + i * i % 101 AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value FROM range(2000) r(i)) TO '{tmp_path}/events.parquet'")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        assert not differences(Q.s5_mesh_file_csr(spark, str(tmp_path)), connect(str(tmp_path)), Q.oracle_sql()["s5_mesh_file_csr"])
    finally:
        spark.conf.set(key, before)


def test_header_of_edges_is_in_the_first_file(spark, tmp_path):
    path = folder_of(tmp_path, "5 4\n0 1\n", "1 2\n2 3\n3     4\n")
    assert R.read_edges(spark, path)[1] == 5 and rows(R.read_edges(spark, path)[0]) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_old_checkpoints_go(spark):
    from pathlib import Path

    from tessera.plans import fixpoint

    folder = Path(fixpoint.shared_folder(spark).removeprefix("file:"))
    count = lambda: len(list(folder.glob("rdd-*")))
    chain = spark.range(12).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    before = count()
    dist, rounds = graphs.shortest_paths(chain)
    assert rounds == 13 and rows(dist) == [(i, float(i)) for i in range(13)] and count() == before + 2  # the edges and the last round


def test_lehmer():
    assert G.lehmer(2, 1) == [16807 / (2**31 - 1), 282475249 / (2**31 - 1)]


def test_streams_end_as_batches_do(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = T.stream_key_aggregate(stream, "user_id", "value").writeStream.format("memory").queryName("so_far").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = df.groupBy("user_id").agg(F.count("*").alias("n"))
    assert rows(spark.table("so_far").select("key", "cnt")) == rows(want)
    windows = T.stream_window_aggregate(stream, "event_type", "value", "ts", "1 day", "1 hour")
    T.write_stream(windows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert 0 < spark.read.parquet(str(tmp_path / "out")).agg(F.sum("cnt")).first()[0] <= df.count()


def test_no_python_in_the_plan_of_the_aggregate(spark, sf_dir):
    from tessera import queries as Q

    plan = Q.a1_hash_aggregate(spark, sf_dir)._jdf.queryExecution().toString()
    assert "partial_sum" in plan and "Python" not in plan and "l_comment" not in plan


def test_weak_components_equal_spread_labels(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(9)] + [(2000 + i, 2000) for i in range(30)] + [(5, 5)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = {r.node: r.comp for r in graphs.spread_labels(df, directed=False)[0].collect()}
    assert {r.node: r.comp for r in graphs.weak_components(df).collect()} == want
    assert graphs.weak_components(df.limit(0)).collect() == []


def test_zipf_over_half_a_million_groups(spark):
    rows = G.zipf(spark, 4000, 1 << 19, 1.0).collect()
    counts = [sum(r.key < top for r in rows) / len(rows) for top in (1, 1024, 1 << 19)]
    whole = sum(1 / r for r in range(1, (1 << 19) + 1))
    assert abs(counts[0] - 1 / whole) < 0.03 and abs(counts[1] - sum(1 / r for r in range(1, 1025)) / whole) < 0.03 and counts[2] == 1


def test_edge_files_with_a_header(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 0.5), (2, 0, 1.5)], "src int, dst int, weight double").repartition(2)
    R.write_edges(df, f"{tmp_path}/w", 3)
    rows, nodes = R.read_weighted_edges(spark, f"{tmp_path}/w")
    assert nodes == 3 and sorted(map(tuple, rows.collect())) == [(0, 1, 0.5), (2, 0, 1.5)]
    R.write_edges(df.select("src", "dst"), f"{tmp_path}/u", 3)
    assert sorted(map(tuple, R.read_edges(spark, f"{tmp_path}/u")[0].collect())) == [(0, 1), (2, 0)]


def test_tiles_lie_in_row_major_order(spark):
    df = spark.createDataFrame([(i * 37 % 100, i * 61 % 100, i) for i in range(100)], "src long, dst long, pos long")
    rows = layout.lay_out_tiles(df, 10, "pos").collect()
    assert [(r.tx, r.ty, r.pos) for r in rows] == sorted((r.src // 10, r.dst // 10, r.pos) for r in rows)
