"""Nearest neighbours by inner product through an inverted multi-index.

The two halves of the vectors are quantised separately: k-means on a sample of FIT_ROWS rows gives K centroids of each
half, and every row goes to the cell of its pair of centroids. A query meets cells by falling sum of its inner products
with the two centroids, which a heap over the two sorted lists gives pair by pair:

1. until the cells seen hold FIRST rows. These are compared exactly, and the last of the best k is a floor.
2. on from there, until a sum lies so far under the floor that rows of such a cell don't reach it: WIDTH times the spread
   that the rows around those centroids show in a random direction. All rows of these cells are compared exactly.

So the work follows the data: few cells where vectors cluster, most of them where they are drawn at random. No cell or
list is cut. K grows with the root of the rows up to MOST; recall is measured against brute force in the tests.

Defined results for odd input: null, empty and zero vectors, those with null or non-finite components and those of another
size than most take no part, nor do rows without an id or whose square length overflows; a query's own row is left out, an equal row of the same id isn't;
of equal scores the least id comes first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import vectors
from treeline.llm.sampling import thinned
from treeline.session import written

NAME = "op13_neighbours"
FIT_ROWS = 8192
MOST = 64  # centroids of a half
CELL_ROWS = 64  # rows of a cell, as long as K is under MOST
FIRST = 1024
WIDTH = 4.0
ROUNDS = 10


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids; the first ones are rows at even distances in the order of the first principal direction."""
    axis = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][0]
    c = x[np.argsort(x @ axis, kind="stable")[np.linspace(0, len(x) - 1, k).round().astype(int)]].copy()
    for _ in range(ROUNDS):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        for j in np.flatnonzero(n):
            c[j] = x[near == j].mean(0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)


def pairs(a: np.ndarray, b: np.ndarray):
    """(sum, i, j) of all pairs by falling a[i] + b[j]."""
    by_a, by_b = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    a, b = a.tolist(), b.tolist()
    heap = [(-(a[by_a[0]] + b[by_b[0]]), 0, 0)]
    while heap:
        s, i, j = heapq.heappop(heap)
        yield -s, by_a[i], by_b[j]
        if j + 1 < len(by_b):
            heapq.heappush(heap, (-(a[by_a[i]] + b[by_b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(by_a):  # each pair has one way into the heap
            heapq.heappush(heap, (-(a[by_a[i + 1]] + b[by_b[0]]), i + 1, 0))


def neighbours(rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """rows(id, vector) -> (query_id, rank, id, score): the best k rows for each row that ``queries``, a condition on id, names."""
    spark = rows.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(vectors.usable(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull())
    rows, d, n = vectors.of_one_size(rows)
    if not n:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    order = F.xxhash64("v"), F.col("id")
    sample = np.array([r[0] for r in rows.where(thinned(FIT_ROWS, n, "id", "v")).orderBy(*order).limit(FIT_ROWS).select("v").collect()] or [rows.first()["v"]])
    half = -(-d // 2)
    size = min(MOST, len(sample), max(1, round((n / CELL_ROWS) ** 0.5)))
    one = kmeans(sample[:, :half], size)
    two = kmeans(sample[:, half:], size) if d > half else np.zeros((1, 0))
    shared = spark.sparkContext.broadcast((one, two))  # at most 2 * MOST rows of half the size

    def place(parts):
        one, two = shared.value
        for part in parts:
            x = vectors.matrix(part.column("v"))
            a, b = nearest(x[:, :half], one), nearest(x[:, half:], two)
            off = [((y - c[at]) ** 2).sum(1) for y, c, at in ((x[:, :half], one, a), (x[:, half:], two, b))]
            yield part.append_column("cell", vectors.pa.array((a * len(two) + b).astype(np.int32))).append_column("off_a", vectors.pa.array(off[0])).append_column("off_b", vectors.pa.array(off[1]))

    placed = rows.select(F.monotonically_increasing_id().alias("row"), "id", F.lit(0).alias("label"), "v").mapInArrow(place, "row long, id long, label int, v array<double>, cell int, off_a double, off_b double")
    placed = written(placed, "multi-index")
    stats = placed.groupBy("cell").agg(F.count("*"), F.sum("off_a"), F.sum("off_b")).collect()  # at most MOST * MOST rows
    counts, off_a, off_b = np.zeros(len(one) * len(two), np.int64), np.zeros(len(one)), np.zeros(len(two))
    per_a, per_b = np.zeros(len(one)), np.zeros(len(two))
    for cell, m, x, y in stats:
        i, j = divmod(cell, len(two))
        counts[cell], per_a[i], per_b[j], off_a[i], off_b[j] = m, per_a[i] + m, per_b[j] + m, off_a[i] + x, off_b[j] + y
    spread = [s / np.maximum(m, 1) / max(1, w) for s, m, w in ((off_a, per_a, half), (off_b, per_b, d - half))]
    index = vectors.packed(placed.select("row", "id", "label", "v", "cell"), counts)

    def visits(first: bool):
        def cells(asks: dict[str, np.ndarray]) -> list[np.ndarray]:
            one, two = shared.value
            q, floor, out = asks["v"], asks["floor"], []
            for x, least in zip(q, floor.tolist(), strict=True):
                wide_a = spread[0] * (x[:half] ** 2).sum()
                wide_b = spread[1] * (x[half:] ** 2).sum()
                most = WIDTH * float(wide_a.max() + wide_b.max()) ** 0.5
                wide_a, wide_b = wide_a.tolist(), wide_b.tolist()
                seen, cells = 0, []
                for s, i, j in pairs(one @ x[:half], two @ x[half:]):
                    cell = i * len(wide_b) + j
                    if seen < FIRST:
                        seen += int(counts[cell])
                        if first and counts[cell]:
                            cells.append(cell)
                    elif first or s + most < least:
                        break
                    elif counts[cell] and not s + WIDTH * (wide_a[i] + wide_b[j]) ** 0.5 < least:
                        cells.append(cell)
                out.append(np.array(cells, np.int64))
            return out

        return cells

    asks = placed.where(queries).select(F.col("row").alias("probe"), F.col("row").alias("own"), "label", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), "v")
    found = vectors.search(index, asks, k, visits)
    names = placed.where(queries).select(F.col("row").alias("probe"), F.col("id").alias("query_id"))
    return found.join(names, "probe").select("query_id", "rank", F.col("id").alias(id_col), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
