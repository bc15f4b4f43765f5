"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tessera import queries as Q
from tessera.session import build_session

HEADLINE = ["a1_hash_aggregate", "a1_hash_aggregate_skewed", "a7_scatter_reduce", "g1_page_rank", "g2_shortest_paths", "g3_widest_paths", "g4_weak_components", "j7_periodic_range_join", "a6_pair_forces", "g6_kmeans_pass", "o1_edge_sort", "r2_conflict_free_groups"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{"spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        Q.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1], "aggregate_mrows_per_s": round(rows / took["a1_hash_aggregate"] / 1e6, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
