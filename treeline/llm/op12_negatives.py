"""Hard negatives by a vantage-point tree: rows of another label whose score lies in a window under a positive's score.

With one more component, the root of M - |v|^2 for the greatest square length M, all vectors are equally long, and an anchor
(whose further component is 0) is the nearer to a row the greater their inner product. So a window of scores is an
annulus of distances.

1. A sample of FIT_ROWS rows gives the tree: each node halves its rows by their distance from a vantage point. All rows go
   down it to a leaf, and each leaf keeps its least and greatest distance from every vantage point above it.
2. By the triangle inequality these bound the scores of a leaf's rows with an anchor. Leaves that the annulus meets are
   taken nearest first until they hold FIRST rows. Their rows' scores are computed; the k-th best in the annulus is a floor.
3. Of the other leaves, those that can hold a better row inside the annulus are looked through as well.

Positives are found the same way, with the same label and no window. Every row that counts is compared exactly: what the
tree leaves out can't be in the result. Whole numbers below 2**53 make the scores exact.

Defined results for odd input: rows with a null label, a null or empty vector or a null or non-finite component take no part,
nor do rows without an id or of another size than most vectors; rows are told apart by row, so equal rows are each other's
positives, and an anchor that occurs twice is mined twice; a positive without rows in its window gives nothing, as does one
of a negative score; a vector whose square length overflows takes no part, and a score over 64 bits is null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import vectors
from treeline.llm.sampling import thinned
from treeline.session import written

NAME = "op12_hard_negatives"
FIT_ROWS = 8192
LEAF_ROWS = 512  # wanted rows of a leaf
DEPTH = 9  # at most
FIRST = 2048
TRIES = 8
POSITIVES, NEGATIVES = 5, 10
WINDOW = (30, 90)  # hundredths of the positive's score
ANCHORS = "id % 100 = 0"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def grown(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(vantage point, radius) of the nodes of a full tree, node i over 2 * i + 1 (within the radius) and 2 * i + 2."""
    nodes = (1 << depth) - 1
    vantage, radius = np.zeros((nodes, points.shape[1])), np.full(nodes, np.inf)
    own: list[np.ndarray] = [np.arange(len(points))]
    for i in range(nodes):
        x = points[own[i]]
        if not len(x):
            own += [own[i], own[i]]
            continue
        tried = x[np.linspace(0, len(x) - 1, TRIES).round().astype(int)]
        away = np.sqrt(np.maximum(((x[None] - tried[:, None]) ** 2).sum(2), 0)) if len(x) <= 512 else np.stack([np.sqrt(((x - t) ** 2).sum(1)) for t in tried])
        most = int(away.std(1).argmax())  # the point whose distances tell its rows apart best
        vantage[i], radius[i] = tried[most], np.median(away[most])
        within = away[most] <= radius[i]
        own += [own[i][within], own[i][~within]]
    return vantage, radius


def descend(points: np.ndarray, vantage: np.ndarray, radius: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, distances from the vantage points above it) of each point."""
    node, away = np.zeros(len(points), np.int64), np.zeros((len(points), depth))
    for level in range(depth):
        away[:, level] = np.sqrt(((points - vantage[node]) ** 2).sum(1))
        node = 2 * node + 1 + (away[:, level] > radius[node])
    return node - ((1 << depth) - 1), away


def bounds(q: np.ndarray, most: float, vantage: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score that rows of each leaf can have with each anchor. low, high: of leaves and levels."""
    leaves, depth = low.shape
    q = np.pad(q, ((0, 0), (0, 1)))
    square = (q * q).sum(1)
    d = np.sqrt(np.maximum(square[:, None] + (vantage * vantage).sum(1)[None] - 2 * q @ vantage.T, 0))
    near, far = np.zeros((len(q), leaves)), np.full((len(q), leaves), np.inf)
    leaf = np.arange(leaves)
    for level in range(depth):
        x = d[:, (1 << level) - 1 + (leaf >> (depth - level))]
        near = np.maximum(near, np.maximum(x - high[:, level], low[:, level] - x))
        far = np.minimum(far, x + high[:, level])
    room = 1e-9 * (square + most)[:, None]  # for rounding; more leaves do no harm
    return (square[:, None] + most - far**2) / 2 - room, (square[:, None] + most - near**2) / 2 + room


def mined(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """rows(id, label, v of whole numbers) -> RESULT, for each row that ``anchors``, a condition, names.

    ``window``: the share in hundredths, from and to, of the positive's score that a negative's score must have.
    """
    spark = rows.sparkSession
    usable = vectors.usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows, d, n = vectors.of_one_size(rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), F.col("v").cast("array<double>").alias("v")).where(usable))
    if not n:
        return spark.createDataFrame([], RESULT)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    most = rows.agg(F.max(square)).first()[0]
    picked = rows.where(thinned(FIT_ROWS, n, "id", "v")).orderBy(F.xxhash64("v"), "id").limit(FIT_ROWS).select("v").collect() or rows.limit(1).select("v").collect()
    sample = longer(np.array([r["v"] for r in picked]), most)
    depth = int(min(DEPTH, max(1, round(np.log2(n / LEAF_ROWS)))))
    shared = spark.sparkContext.broadcast(grown(sample, depth))  # at most 2 ** DEPTH vectors

    def place(parts):
        vantage, radius = shared.value
        for part in parts:
            leaf, away = descend(longer(vectors.matrix(part.column("v")), most), vantage, radius, depth)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1) * depth, pa.int32()), pa.array(away.ravel()))
            yield part.append_column("cell", pa.array(leaf.astype(np.int32))).append_column("away", lists)

    placed = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v").mapInArrow(place, "row long, id long, label int, v array<double>, cell int, away array<double>")
    placed = written(placed, "vantage-points")
    ends = [f(F.col("away")[k]) for f in (F.min, F.max) for k in range(depth)]
    counts, low, high = np.zeros(1 << depth, np.int64), np.zeros((1 << depth, depth)), np.zeros((1 << depth, depth))
    for leaf, m, *rest in placed.groupBy("cell").agg(F.count("*"), *ends).collect():  # a row a leaf
        counts[leaf], low[leaf], high[leaf] = m, rest[:depth], rest[depth:]
    index = vectors.packed(placed.select("row", "id", "label", "v", "cell"), counts)

    def visits(scale: float):
        def of(first: bool):
            def cells(asks: dict[str, np.ndarray]) -> list[np.ndarray]:
                least, greatest = (scale * x for x in bounds(asks["v"], most, shared.value[0], low, high))
                out = []
                for lo, hi, floor, a, b in zip(asks["lo"], asks["hi"], asks["floor"], least, greatest, strict=True):
                    bare = lo if np.isnan(floor) or lo > scale * floor else -np.inf
                    met = np.flatnonzero((counts > 0) & (b >= bare) & (a <= hi))
                    near = met[np.argsort(-np.minimum(b[met], hi), kind="stable")]  # nearest first within the annulus
                    early = np.cumsum(counts[near]) - counts[near] < FIRST
                    out.append(near[early] if first else near[~early & (b[near] >= lo)])
                return out

            return cells

        return of

    own = placed.where(anchors).select("row", "id", "label", "v")
    ends = F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")
    asks = own.select(F.col("row").alias("probe"), F.col("row").alias("own"), "label", *ends, "v")
    good = vectors.search(index, asks, positives, visits(1.0), 1.0, "same").select(F.col("probe").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    good = written(good.where("positive_score >= 0").withColumn("probe", F.monotonically_increasing_id()), "positives")
    windows = [(F.col("positive_score") * x).alias(c) for c, x in zip(("lo", "hi"), window, strict=True)]
    asks = written(good.join(own.withColumnRenamed("row", "anchor"), "anchor").select("probe", F.col("anchor").alias("own"), "label", *windows, "v"), "windows")
    bad = vectors.search(index, asks, negatives, visits(100.0), 100.0, "other")
    named = good.join(own.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return bad.join(named, "probe").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("positive_score").try_cast("long").alias("positive_score"), F.col("score").try_cast("long").alias("negative_score"))


def longer(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that gives all of them the same length."""
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]], 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op12: labels of one row in seven are moved on, components are 256ths, rounded down."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = lambda x: F.when(F.abs(256 * x) < 2.0**53, F.floor(256 * x).cast("double")).when(F.abs(x) < float("inf"), 256 * x)  # noqa: E731  null if not finite
    parts = F.transform(F.col("embedding").cast("array<double>"), whole)
    return mined(rows.select(F.col("vec_id").alias("id"), label.alias("label"), parts.alias("v")), F.expr(ANCHORS))


ORACLE = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r AS a, a.id AS anchor_id, b.r AS b, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5)
SELECT anchor_id, positive_id, CAST(k AS INT) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id) AS k
  FROM p JOIN s n ON p.a = n.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
WHERE k <= 10
"""
