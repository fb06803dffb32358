"""Forests and components by contraction, against Kruskal with a union-find."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeline.operators.components import component_roots
from treeline.operators.contraction import partial, spanning_forest
from treeline.operators.kernels import forest, greatest_reached, kruskal

EDGE = "src long, dst long, weight double"


def rows(df):
    return sorted((r.src, r.dst, r.weight) for r in df.collect())


def graph(seed: int, n: int, m: int, weights: int) -> list[tuple[int, int, float]]:
    rng = np.random.default_rng(seed)
    ids = rng.permutation(10 * n)[:n]
    ends = np.sort(ids[rng.integers(0, n, (m, 2))], 1)
    return sorted({(int(a), int(b), float(w)) for (a, b), w in zip(ends, rng.integers(0, weights, m), strict=True) if a != b})


def least(edges):
    src, dst, weight = (np.array(x) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return sorted(edges[k] for k in kruskal(src, dst, weight).tolist())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25), st.integers(0, 4)), max_size=90))
def test_array_forest_is_kruskals(edges):
    src, dst, weight = (np.array([e[k] for e in edges], t) for k, t in enumerate((np.int64, np.int64, float)))
    assert forest(src, dst, weight).tolist() == kruskal(src, dst, weight).tolist()


def test_a_million_edges_take_seconds():
    rng = np.random.default_rng(1)
    src, dst, weight = rng.integers(0, 200_000, 1_000_000), rng.integers(0, 200_000, 1_000_000), rng.random(1_000_000)
    began = time.process_time()
    assert len(forest(src, dst, weight)) == 200_000 - len(np.unique(greatest_reached(src, dst)[1])) - (200_000 - len(np.unique(np.concatenate([src, dst]))))
    assert time.process_time() - began < 3


@pytest.mark.parametrize("task_rows", [0, 40, 10**6])
def test_forest_for_any_budget(spark, task_rows):
    edges = graph(3, 300, 1500, 6)
    df = spark.createDataFrame(edges + edges[::7] + [(5, 5, 0.0)], EDGE).repartition(3)
    assert rows(spanning_forest(df, task_rows)) == least(edges)


def test_no_task_is_over_the_budget(spark, monkeypatch, tmp_path):
    """The arrays that a task sorts are never longer than the budget and a batch, whatever the graph."""
    from treeline.operators import contraction

    edges, folder = graph(4, 2000, 6000, 1000), str(tmp_path)

    def counted(src, dst, weight, real=forest):
        with open(f"{folder}/sizes", "a") as f:
            f.write(f"{len(src)}\n")
        return real(src, dst, weight)

    monkeypatch.setattr(contraction, "forest", counted)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = rows(spanning_forest(spark.createDataFrame(edges, EDGE).repartition(2), 500))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sizes = [int(x) for x in (tmp_path / "sizes").read_text().split()]
    assert got == least(edges) and len(sizes) > 2 and max(sizes) <= 600


def test_partial_forest_keeps_what_counts(spark):
    edges = graph(5, 60, 900, 20)
    df = spark.createDataFrame([(k % 2, *e) for k, e in enumerate(edges)], "grp int, " + EDGE).repartition(4)
    thin = partial(df, "grp", rows=100)
    assert thin.count() < 500 < len(edges)
    for grp in (0, 1):
        kept = [tuple(r)[1:] for r in thin.where(F.col("grp") == grp).collect()]
        assert least(sorted(kept)) == least(edges[grp::2])


def test_rounds_are_logarithmic_on_a_path(spark, monkeypatch):
    n, calls = 100_000, []
    from treeline.operators import contraction

    monkeypatch.setattr(contraction, "between", lambda *a, real=contraction.between: calls.append(1) or real(*a))
    order = F.xxhash64("id")
    ids = spark.range(n).select("id")
    path = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert component_roots(ids, path).where(F.col("root") != n - 1).count() == 0
    mixed = spark.range(n - 1).select(order.alias("src"), F.xxhash64(F.col("id") + 1).alias("dst"))
    first = len(calls)
    assert component_roots(ids.select(order.alias("id")), mixed).select("root").distinct().count() == 1
    assert first <= 2 and len(calls) - first <= 17


def test_a_hub_and_many_small_sets(spark):
    links = [(0, k) for k in range(1, 400)] + [(1000 + 2 * k, 1001 + 2 * k) for k in range(100)]
    got = {r.id: r.root for r in component_roots(spark.createDataFrame([(k,) for k in [*range(400), *range(1000, 1200), 5000]], "id long"), spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {k: 399 for k in range(400)} | {k: k | 1 for k in range(1000, 1200)} | {5000: 5000}
