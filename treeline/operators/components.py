"""Components, flat clusters and merge order of a spanning tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.operators.contraction import labelled
from treeline.plans.splits import numbered
from treeline.session import written


def component_roots(vertices: DataFrame, edges: DataFrame, in_one_task: int = 0) -> DataFrame:
    """vertices(id), edges(src, dst) -> (id, root): the greatest id that each vertex reaches.

    By rounds that contract the edges; with ``in_one_task``, one task finishes what at most so many edges between sets hold.
    """
    return labelled(vertices, edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), in_one_task)


def component_count(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_components) of a forest: vertices less edges."""
    return vertices.agg(F.count("*").alias("v")).crossJoin(edges.agg(F.count("*").alias("e"))).select((F.col("v") - F.col("e")).alias("n_components"))


def connected(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs(a, b) + connected."""
    a, b = (roots.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", (F.col("root_a") == F.col("root_b")).alias("connected"))


def cut_at(edges: DataFrame, height: float | Column) -> DataFrame:
    """The edges that a cut of the dendrogram at the height leaves."""
    return edges.where(F.col("weight") <= height)


def merges(edges: DataFrame) -> DataFrame:
    """(step, src, dst, weight): the merges of single linkage, in order: ranges of the order are numbered side by side."""
    return numbered(written(edges.select("src", "dst", "weight"), "edges"), "weight", "src", "dst").select((F.col("index") + 1).cast("long").alias("step"), "src", "dst", "weight")


def labels_of(vertices: DataFrame, edges: DataFrame, k: int, in_one_task: int = 0) -> DataFrame:
    """(id, label): k flat clusters, the tree without its k - 1 last edges. Edges are written first, as they are read twice.

    ``in_one_task`` as in ``component_roots``.
    """
    edges = written(edges.select("src", "dst", "weight"), "edges")
    last = edges.orderBy(F.desc("weight"), F.desc("src"), F.desc("dst")).limit(k - 1)
    return component_roots(vertices, edges.join(last.select("src", "dst"), ["src", "dst"], "left_anti"), in_one_task).select("id", F.col("root").alias("label"))
