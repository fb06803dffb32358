"""Trees and nearest points by cells and matrix products against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.model import Counters
from treeline.operators import kernels
from treeline.operators.kernels import nearest, prim, tree
from treeline.operators.mst import cell_trees, local_trees, mst, nearest_neighbors
from treeline.plans import catalog
from treeline.plans.splits import n_subgraphs, with_splits
from treeline.sources.tables import literal

RNG = np.random.default_rng(5)
SETS = {
    "drawn": RNG.standard_normal((90, 7)),
    "grid": RNG.integers(0, 3, (90, 3)).astype(float),
    "equal": np.ones((60, 2)),
    "near copies": np.repeat(RNG.standard_normal((5, 4)), 18, 0) + 1e-7 * RNG.standard_normal((90, 4)),
    "far off": 1e8 + RNG.integers(0, 9, (90, 2)) * 0.1,
    "huge": RNG.standard_normal((40, 2)) * 1e160,
    "tiny": RNG.standard_normal((40, 2)) * 1e-170,
}


def edges(df):
    return sorted((r.src, r.dst, r.weight) for r in df.collect())


def points(spark, x, ids=None):
    return literal(spark, [(int(i), [float(c) for c in row]) for i, row in zip(range(len(x)) if ids is None else ids, x, strict=True)])


@pytest.mark.parametrize("bipartite", [False, True])
@pytest.mark.parametrize("listed", [1, 3, 12])
@pytest.mark.parametrize("name", SETS)
def test_a_tree_by_products_is_prims(name, listed, bipartite):
    x = SETS[name]
    ids = RNG.permutation(1000)[: len(x)]
    side = RNG.integers(1, 3, len(x)) if bipartite else np.zeros(len(x), int)
    with np.errstate(over="ignore"):
        want, got = prim(ids, x, side), tree(ids, x, side, listed)
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))


@pytest.mark.parametrize("listed", [1, 12])
@pytest.mark.parametrize("name", SETS)
def test_nearest_by_products_is_that_of_all_distances(monkeypatch, name, listed):
    monkeypatch.setattr(kernels, "LISTED", listed)
    monkeypatch.setattr(kernels, "TILE", (16, 24))
    x, ids = SETS[name], RNG.permutation(1000)[: len(SETS[name])]
    with np.errstate(over="ignore"):
        want = [min((w, i) for w, i in zip(kernels.distances(x[k], x).tolist(), ids.tolist(), strict=True) if i != ids[k]) for k in range(len(x))]
        got = {i: (w, j) for i, j, w in zip(*(c.tolist() for c in nearest(ids, x, np.zeros(len(x), int))), strict=True)}
    assert got == {i: m for i, m in zip(ids.tolist(), want, strict=True) if np.isfinite(m[0])}


@pytest.mark.parametrize("bipartite", [False, True])
def test_each_square_is_computed_about_once(monkeypatch, bipartite):
    """One product for both ends of a pair, but for a sample and what few points go on; before, one for each end and more."""
    x = np.random.default_rng(8).standard_normal((4000, 24))
    side = np.arange(4000) % 2 + 1 if bipartite else np.zeros(4000, int)
    seen = []
    monkeypatch.setattr(kernels.Cell, "squares", lambda *a, real=kernels.Cell.squares: (seen.append(p[2].size) or p for p in real(*a)))
    assert len(tree(np.arange(4000), x, side)[0]) == 3999
    assert sum(seen) < 4000 * 4000 // 2
    seen.clear()
    assert len(nearest(np.arange(4000), x, side)[0]) == 4000
    assert sum(seen) < 4000 * 4000 // 2


def test_what_is_held_at_once_does_not_grow_with_the_cell(monkeypatch):
    monkeypatch.setattr("treeline.operators.kernels.AT_ONCE", 100)
    x, ids, side = SETS["grid"], np.arange(90), np.zeros(90, int)
    assert all(np.array_equal(a, b) for a, b in zip(prim(ids, x, side), tree(ids, x, side), strict=True))
    assert len(nearest(ids, x, side)[0]) == 90


@pytest.mark.parametrize("name", ["drawn", "grid"])
def test_cells_change_no_tree(spark, name):
    p = points(spark, SETS[name], RNG.permutation(1000)[:90])
    divided = with_splits(p, 3)
    _, parts = cell_trees(divided, 3, cell_rows=4)
    assert parts == 8
    by_sg = lambda df: sorted((r.sg, r.src, r.dst, r.weight) for r in df.collect())
    assert by_sg(local_trees(divided, 3, cell_rows=4)) == by_sg(local_trees(divided, 3))
    assert edges(mst(p, 3, 2, cell_rows=4)) == edges(mst(p, 3, 2)) == edges(mst(p, 3, 2, cell_rows=4, task_rows=50))
    near = lambda df: sorted((r.id, r.near, r.weight) for r in df.collect())
    assert near(nearest_neighbors(p, 3, cell_rows=4)) == near(nearest_neighbors(p, 3))


def test_a_task_holds_a_cell_and_not_two_splits(spark):
    p = points(spark, RNG.standard_normal((400, 2)))
    trees, parts = cell_trees(with_splits(p, 2), 2, cell_rows=20)
    assert parts == 10
    rows = trees.groupBy("cell").agg(F.count("*").alias("n")).collect()
    assert len(rows) == n_subgraphs(20) and max(r.n for r in rows) < 100  # of two splits: 399


def test_equal_points_are_compared_once(spark):
    counters = Counters()
    got = edges(mst(points(spark, [[k % 5] for k in range(400)]), 2, 3, counters=counters))
    assert counters.read()["points"] == 400 and counters.read()["distances"] == 10  # before: 79,800
    assert len(got) == 399 and [e for e in got if e[2]] == [(k, k + 1, 1.0) for k in range(4)]
    assert all(s == d % 5 for s, d, w in got if not w)


def test_supplier_edges_do_not_take_all_distances(spark, tmp_path, monkeypatch):
    rows = [(k, k % 25, float(k * 37 % 1009)) for k in range(2000)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(catalog, "mst", None)
    want = edges(mst(points(spark, [r[1:] for r in rows]), 2, 2))
    assert sorted(r.shown for r in catalog.edge_format(spark, str(tmp_path)).collect()) == sorted(f"[({s} {d}) {w:.6f}]" for s, d, w in want)
