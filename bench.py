"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from treeline.__main__ import clustered
from treeline.operators.mst import mst
from treeline.operators.spatial import spatial_mst
from treeline.plans import catalog
from treeline.session import local_session


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("treeline-bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    points = catalog.vectors(spark, d)
    n = points.count()
    work = {f"mst_s{s}": (lambda s=s: mst(points, s, 3)) for s in (1, 2, 4, 8)}
    work |= {f"mst_s{s}_part": (lambda s=s: mst(catalog.parts(spark, d), s, 3)) for s in (4,)}
    work["mst_32k_10d_s8"] = lambda: mst(clustered(spark, 32 * 1024, 10), 8, 3)
    work["spatial_32k_10d"] = lambda: spatial_mst(clustered(spark, 32 * 1024, 10))
    work["spatial_128k_5d"] = lambda: spatial_mst(clustered(spark, 128 * 1024, 5))
    work |= {name: (lambda name=name: catalog.QUERIES[name](spark, d)) for name in ("local_mst_stats", "merge_round_1", "nearest_neighbor", "component_root", "dendrogram_merges", "split_assign")}
    mst(points, 2, 3).write.format("noop").mode("overwrite").save()  # warms the JVM and the Python workers
    took = {}
    for name, make in work.items():
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "mst_s4_seconds", "value": took["mst_s4"], "unit": "sec", "queries": took, "sf": d, "points": n, "distances_per_sec": round(n * (n - 1) / 2 / took["mst_s4"])}))
    spark.stop()


if __name__ == "__main__":
    main()
