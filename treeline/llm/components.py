"""Connected components of a link table by alternating large-star and small-star steps.

Both steps take the least neighbour of each vertex with an aggregate and join it back, so a vertex with a third of all
links is split over tasks like any other skewed join. Each round is written to the shared folder, and each of its partitions
first puts stars in place of its links. Rounds go on until nothing changes or until at most TASK_ROWS links are left, which is
what a task holds of any partition, and which one task then finishes: what it holds doesn't grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from treeline.operators.kernels import greatest_reached
from treeline.session import release, written

MOST_ROUNDS = 50
TASK_ROWS = 1_000_000  # links that a task holds at once
LINK = "u long, v long"


def stars(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links (u, v) of a partition, some TASK_ROWS at a time: each vertex with the least that it reaches by them."""

    def reached(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        u, v = least_reached(held)
        return pa.table({"u": u[u != v], "v": v[u != v]}).to_batches(10_000)

    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= TASK_ROWS:
            yield from reached(held)
            held, size = [], 0
    if held:
        yield from reached(held)


def least_reached(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of links (u, v), and the least that each reaches."""
    table = pa.Table.from_batches(held)
    v, root = greatest_reached(*(~table.column(c).to_numpy() for c in ("u", "v")))  # the complement turns the order round
    return ~v, ~root


def rooted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links at once -> (v, root)."""
    if held := list(parts):
        yield from pa.table(dict(zip(("v", "root"), least_reached(held), strict=True))).to_batches(10_000)


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (v, root): each vertex of a link and the least vertex that it reaches."""

    def observed(made: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        return written(made.mapInArrow(stars, LINK).observe(seen, F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")), "links"), seen.get

    edges, state = observed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    for _ in range(MOST_ROUNDS):
        if state["n"] <= TASK_ROWS:
            return edges.coalesce(1).mapInArrow(rooted, "v long, root long")
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select("u", "v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new_edges, new = observed(small)
        release(edges)
        edges = new_edges
        if new == state:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(edges.select("v", F.col("v").alias("root"))).groupBy("v").agg(F.min("root").alias("root"))
        state = new
    raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """known(v, root), written, and more links(a, b) -> (v, root), written: the components by both. Only what links join is looked at."""
    moved = links
    for x in "ab":
        moved = moved.join(known.select(F.col("v").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
    more = written(components(moved.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))), "sides")
    old = known.join(more.select(F.col("v").alias("root"), F.col("root").alias("to")), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
    return written(old.unionByName(more.join(known.select("v"), "v", "left_anti")), "sides")
