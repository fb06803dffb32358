"""``python -m treeline``: the spanning tree of a matrix file or a Parquet table.

``python -m treeline split INPUT --splits N --out DIR`` writes the splits and reads them back; ``python -m treeline sweep``
times the tree over a grid of point numbers, dimensions, splits and fan-ins.
"""

from __future__ import annotations

import argparse
import itertools
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.geometry import point_string
from treeline.model import Counters
from treeline.operators.mst import mst
from treeline.operators.spatial import spatial_mst
from treeline.plans.splits import with_splits
from treeline.sources import config, matrix, sequence, tables


def parser(prog: str, what: str) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=prog, description=what)
    p.add_argument("input", help="a binary matrix (.bin), a folder of sequence files (.seq) or a Parquet table")
    p.add_argument("--id", default="id", help="id column of a table")
    p.add_argument("--coords", nargs="+", default=["coords"], help="vector column, or numeric columns, of a table")
    p.add_argument("--rows", type=int, help="keep the first rows")
    p.add_argument("--dims", type=int, help="keep the first coordinates")
    p.add_argument("--splits", type=int, default=2)
    p.add_argument("--config", help="properties file with spark.* settings")
    p.add_argument("--sample", type=int, default=0, help="print so many of the first points")
    return p


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = parser("treeline", __doc__)
    p.add_argument("--fanin", type=int, default=3)
    p.add_argument("--spatial", action="store_true", help="by blocks of a kd-tree, for few dimensions; without splits and fan-in")
    p.add_argument("--out", help="write the edges there as Parquet")
    p.add_argument("--show", type=int, default=0, help="print so many of the heaviest edges")
    return p.parse_args(args)


def read_input(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.input.endswith(".bin"):
        points = matrix.read_matrix(spark, a.input, a.rows, a.dims)
    elif a.input.endswith(".seq"):
        points = matrix.prefix(sequence.read_points(spark, a.input), a.rows, a.dims)
    else:
        points = matrix.prefix(tables.read_vectors(spark, a.input, a.id, *a.coords), a.rows, a.dims)
    if a.sample:
        for r in points.orderBy("id").limit(a.sample).select(point_string(F.col("id"), F.col("coords")).alias("shown")).collect():
            print(r.shown)
    return points


def split(args: list[str]) -> int:
    """Writes the splits, reads all back, and prints the first points of both side by side."""
    p = parser("treeline split", split.__doc__)
    p.add_argument("--out", required=True, help="folder of the splits")
    p.add_argument("--show", type=int, default=5, help="print so many pairs")
    a = p.parse_args(args)
    spark = config.session(config.read_properties(a.config) if a.config else {})
    points = with_splits(read_input(spark, a), a.splits)
    tables.save_splits(points, a.out)
    back = tables.read_splits(spark, a.out)
    first = lambda df, name: df.orderBy("id").limit(a.show).select("id", point_string(F.col("id"), F.col("coords")).alias(name))
    for r in first(points, "left").join(first(back, "right"), "id", "full").orderBy("id").collect():
        print(f"{r.left} || {r.right}")
    for r in back.groupBy("split").count().orderBy("split").collect():
        print(f"split={r['split']} points={r['count']}")
    return 0


def clustered(spark: SparkSession, n: int, d: int, clusters: int = 32, seed: int = 7) -> DataFrame:
    """points(id, coords): n points about so many centres, made where they are used."""
    centre = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.pmod("id", F.lit(clusters)), F.lit(k)), F.lit(1000)) / 100
    return spark.range(n).select("id", F.array(*[centre(k) + F.randn(seed * 1000 + k) / 4 for k in range(d)]).alias("coords"))


def sweep(args: list[str]) -> int:
    """Times the tree over all combinations; one JSON line each."""
    p = argparse.ArgumentParser(prog="treeline sweep", description=sweep.__doc__)
    p.add_argument("--points", type=int, nargs="+", default=[32 * 1024])
    p.add_argument("--dims", type=int, nargs="+", default=[5, 10])
    p.add_argument("--splits", type=int, nargs="+", default=[8])
    p.add_argument("--fanin", type=int, nargs="+", default=[3])
    p.add_argument("--spatial", action="store_true", help="by blocks of a kd-tree; splits and fan-ins make no difference then")
    p.add_argument("--config", help="properties file with spark.* settings")
    a = p.parse_args(args)
    spark = config.session(config.read_properties(a.config) if a.config else {})
    for n, d, s, k in itertools.product(a.points, a.dims, a.splits, a.fanin):
        began = time.perf_counter()
        points = clustered(spark, n, d)
        r = (spatial_mst(points) if a.spatial else mst(points, s, k)).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight")).first()
        print(json.dumps({"points": n, "dims": d, "splits": s, "fanin": k, "edges": r["edges"], "weight": round(r["weight"] or 0, 6), "seconds": round(time.perf_counter() - began, 2)}), flush=True)
    return 0


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    if args and args[0] in ("split", "sweep"):
        return {"split": split, "sweep": sweep}[args[0]](args[1:])
    a = arguments(args)
    spark = config.session(config.read_properties(a.config) if a.config else {})
    points = read_input(spark, a)
    began = time.perf_counter()
    counters = Counters()
    edges = spatial_mst(points, counters=counters) if a.spatial else mst(points, a.splits, a.fanin, counters=counters)
    if a.out:
        edges.write.mode("overwrite").parquet(a.out)
        edges = spark.read.parquet(a.out)
    total = edges.agg(F.count("*").alias("edges"), F.sum("weight").alias("weight")).first()
    print(f"edges={total['edges']} weight={total['weight'] or 0:.6f} seconds={time.perf_counter() - began:.2f}")
    print(" ".join(f"{k}={v}" for k, v in counters.read().items()))
    if a.show:
        edges.orderBy(F.desc("weight"), "src", "dst").limit(a.show).show(a.show, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
