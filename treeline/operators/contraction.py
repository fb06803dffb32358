"""Minimum spanning forests and components of edge tables by contraction: no task holds a whole tree.

Each set of vertices takes its least edge (or its greatest neighbour), sets that hang together become one by jumps along what
they took, and the edges that are left run between sets, the least of each two. A round at least halves the sets, so rounds
are logarithmic. All steps are joins and aggregates over tables in the shared folder; a vertex with a third of all edges is
a skewed join or a partial aggregate, not a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from treeline.operators.kernels import forest, greatest_reached
from treeline.session import release, written

TASK_ROWS = 4_000_000  # edges that one task may hold
FOREST = "src long, dst long, weight double"


def ends(links: DataFrame) -> DataFrame:
    """links(u, v, ...) -> (c, near, ...): each link from either side."""
    rest = [x for x in links.columns if x not in ("u", "v")]
    return links.select(F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("near")), F.struct(F.col("v").alias("c"), F.col("u").alias("near")))).alias("s"), *rest).select("s.*", *rest)


def roots_of(hooks: DataFrame) -> DataFrame:
    """hooks(c, p), written, with no cycle but of two -> (c, root), written. Of such two the greater is the root."""
    mutual = hooks.select(F.col("c").alias("p"), F.col("p").alias("back"))
    top = (F.col("back") == F.col("c")) & (F.col("c") > F.col("p"))
    state = written(hooks.join(mutual, "p", "left").select("c", F.when(top, F.col("c")).otherwise(F.col("p")).alias("root")), "roots")
    while True:
        up, seen = state.select(F.col("c").alias("root"), F.col("root").alias("up")), Observation()
        jumped = state.join(up, "root", "left").withColumn("up", F.coalesce("up", "root"))
        new = written(jumped.observe(seen, F.count_if(F.col("up") != F.col("root")).alias("moved")).select("c", F.col("up").alias("root")), "roots")
        release(state)
        if not seen.get["moved"]:
            return new
        state = new


def between(links: DataFrame, roots: DataFrame, *best: Column) -> DataFrame:
    """links(u, v, ...) between the sets that roots(c, root) name, one for each two sets, with the aggregates ``best``."""
    a, b = (roots.select(F.col("c").alias(x), F.col("root").alias(f"to_{x}")) for x in "uv")
    moved = links.join(a, "u", "left").join(b, "v", "left").withColumns({"u": F.coalesce("to_u", "u"), "v": F.coalesce("to_v", "v")}).where("u <> v")
    moved = moved.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})
    return moved.groupBy("u", "v").agg(*best) if best else moved.select("u", "v").distinct()


def partial(edges: DataFrame, *groups: str, rows: int = TASK_ROWS) -> DataFrame:
    """edges(*groups, src, dst, weight) without those that close a cycle among the edges of their group in their partition.

    What a partition holds at once is at most some ``rows`` edges: where their forest is still large it goes on as it is, and
    the next edges start anew, so an edge is only ever dropped for a cycle that it closes.
    """

    def thin(batches: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(batches)
        src, dst, weight = (table.column(c).to_numpy() for c in ("src", "dst", "weight"))
        if groups:  # edges of one group come together, and vertices of two groups are two
            keys = np.stack([table.column(g).to_numpy() for g in groups], 1)
            _, number = np.unique(keys, axis=0, return_inverse=True)
            kept = [at[forest(src[at], dst[at], weight[at])] for at in (np.flatnonzero(number.ravel() == k) for k in range(number.max(initial=-1) + 1))]
            return table.take(pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))
        return table.take(pa.array(forest(src, dst, weight)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            held.append(part)
            size += len(part)
            if size >= rows:
                table = thin(held)
                held, size = (table.to_batches(), len(table)) if 2 * len(table) < rows else ([], 0)
                if not held:
                    yield from table.to_batches()
        if held:
            yield from thin(held).to_batches()

    return edges.select(*groups, "src", "dst", "weight").mapInArrow(run, edges.select(*groups, "src", "dst", "weight").schema)


def spanning_forest(edges: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """edges(src, dst, weight) -> those of the minimum spanning forest, which is unique by the order (weight, src, dst).

    Rounds contract the edge table until at most ``task_rows`` edges are left between sets; one task finishes these.
    """

    def finish(table: pa.Table) -> pa.Table:
        u, v, weight, src, dst = (table.column(c).to_numpy() for c in ("u", "v", "weight", "src", "dst"))
        order = np.lexsort((dst, src, weight))
        rank = np.empty(len(order))
        rank[order] = np.arange(len(order))
        kept = forest(u, v, rank)  # sets are new vertices, the order of edges stays that of their ends
        return pa.table({"src": src[kept], "dst": dst[kept], "weight": weight[kept]})

    best = F.min(F.struct("weight", "src", "dst")).alias("e")
    links = partial(edges, rows=task_rows).where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(best)
    links, tree = written(links.select("u", "v", "e.*"), "links"), []
    while links.count() > task_rows:
        least = written(ends(links).groupBy("c").agg(F.min(F.struct("weight", "src", "dst", "near")).alias("e")).select("c", F.col("e.near").alias("p"), "e.weight", "e.src", "e.dst"), "least")
        tree.append(least.select("src", "dst", "weight").distinct())
        roots = roots_of(least.select("c", "p"))
        fewer = written(between(links, roots, best).select("u", "v", "e.*"), "links")
        release(links, roots)
        links = fewer
    out = links.groupBy(F.lit(0).alias("rest")).applyInArrow(finish, FOREST)
    for part in tree:
        out = out.unionByName(part)
    return out


def labelled(vertices: DataFrame, links: DataFrame, task_rows: int = 0) -> DataFrame:
    """vertices(id), links(u, v) -> (id, root): the greatest vertex that each reaches along links.

    With ``task_rows``, one task finishes once at most so many links between sets are left.
    """

    def finish(table: pa.Table) -> pa.Table:
        c, root = greatest_reached(table.column("u").to_numpy(), table.column("v").to_numpy())
        return pa.table({"c": c, "root": root})

    def stars(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the links of a partition, some TASK_ROWS at a time: each vertex with the greatest that it reaches by them."""
        held, size = [], 0
        for part in parts:
            held.append(part)
            size += len(part)
            if size >= TASK_ROWS:
                yield from reached(held)
                held, size = [], 0
        if held:
            yield from reached(held)

    def reached(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        u, v = greatest_reached(table.column("u").to_numpy(), table.column("v").to_numpy())
        return pa.table({"u": u[u != v], "v": v[u != v]}).to_batches(10_000)

    names = written(vertices.select("id", F.col("id").alias("root")), "names")
    links = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).mapInArrow(stars, "u long, v long")
    links = written(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "links")
    while n := links.count():
        if n <= task_rows:
            to = links.groupBy(F.lit(0).alias("rest")).applyInArrow(finish, "c long, root long").withColumnRenamed("root", "to")
            names = names.join(to, F.col("root") == F.col("c"), "left").select("id", F.coalesce("to", "root").alias("root"))
            break
        # Along greatest neighbours two steps never lead down, so the only cycles are of two.
        roots = roots_of(written(ends(links).groupBy("c").agg(F.max("near").alias("p")), "greatest"))
        new = written(names.join(roots.withColumnRenamed("root", "to"), F.col("root") == F.col("c"), "left").select("id", F.coalesce("to", "root").alias("root")), "names")
        fewer = written(between(links, roots), "links")
        release(names, links, roots)
        names, links = new, fewer
    top = names.groupBy("root").agg(F.max("id").alias("top"))
    return names.join(top, "root").select("id", F.col("top").alias("root"))
