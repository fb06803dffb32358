import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.functions import geometry as G
from treeline.model import InvalidPoints, MstConfig
from treeline.operators import components as C
from treeline.operators.boruvka import boruvka
from treeline.operators.mst import local_trees, mst
from treeline.plans.catalog import all_pairs
from treeline.plans.splits import n_subgraphs, schedule, subgraphs, with_splits
from treeline.sources.tables import literal, read_splits, save_splits

SQUARE = [(0, [0.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 2.0]), (3, [1.2, 2.0])]


def points(spark, coords, ids=None):
    return literal(spark, [(int(i), [float(x) for x in c]) for i, c in zip(ids if ids is not None else range(len(coords)), coords, strict=True)])


def edges(df):
    return sorted((r.src, r.dst, r.weight) for r in df.collect())


@pytest.mark.parametrize(("splits", "fanin"), [(1, 2), (2, 3), (3, 2), (4, 3), (9, 2)])
def test_square_for_any_division(spark, splits, fanin):
    got = edges(mst(literal(spark, SQUARE), splits, fanin))
    assert [e[:2] for e in got] == [(0, 1), (1, 3), (2, 3)]
    assert math.isclose(sum(e[2] for e in got), 4.35407, abs_tol=1e-5)


def test_ties_do_not_depend_on_the_division(spark):
    grid = np.random.default_rng(2).integers(0, 4, (40, 2))
    ids = np.random.default_rng(3).permutation(1000)[:40]
    p = points(spark, grid, ids)
    want = edges(mst(p, 1, 2))
    assert len(want) == 39
    assert all(edges(mst(p.repartition(3), s, k)) == want for s, k in ((2, 3), (5, 2)))
    assert edges(boruvka(p.select("id"), all_pairs(p))) == want


def test_few_points(spark):
    assert edges(mst(points(spark, []), 3, 2)) == []
    assert edges(mst(points(spark, [[1, 2]]), 2, 3)) == []
    assert edges(mst(points(spark, [[1, 2], [1, 2]]), 4, 2)) == [(0, 1, 0.0)]


@pytest.mark.parametrize("rows", [[(0, [1.0]), (1, [float("nan")])], [(0, [1.0]), (1, [float("inf")])], [(0, [1.0]), (1, [1.0, 2.0])], [(0, [1.0]), (0, [2.0])]])
def test_bad_points_are_refused(spark, rows):
    with pytest.raises(InvalidPoints):
        mst(literal(spark, rows))


def test_config():
    for bad in ((0, 2), (1, 1), (2, 0)):
        with pytest.raises(ValueError):
            MstConfig(*bad)
    assert schedule(4, 3) == [10, 4, 2, 1] and schedule(1, 2) == [1] and n_subgraphs(50_000) == 1_250_025_000


def test_plan_and_local_edges(spark):
    got = [(r.sg, r.l, r.r) for r in subgraphs(spark, 4).orderBy("sg").collect()]
    assert got == [(0, 0, 1), (1, 0, 2), (2, 1, 2), (3, 0, 3), (4, 1, 3), (5, 2, 3), (6, 0, 0), (7, 1, 1), (8, 2, 2), (9, 3, 3)]
    p = points(spark, np.random.default_rng(0).random((50, 3)))
    sizes = {r.split: r["count"] for r in with_splits(p, 4).groupBy("split").count().collect()}
    assert sizes == {0: 12, 1: 13, 2: 12, 3: 13}
    assert local_trees(with_splits(p, 4), 4).count() == 4 * 50 - 4 * 5 // 2


def test_split_folders(spark, tmp_path):
    p = with_splits(points(spark, [[k, k] for k in range(7)]), 3)
    save_splits(p, str(tmp_path / "s"))
    save_splits(p, str(tmp_path / "s"))
    assert {r.id for r in read_splits(spark, str(tmp_path / "s"), 1).collect()} == {2, 3}
    assert read_splits(spark, str(tmp_path / "s")).count() == 7


def test_components_along_a_path(spark):
    ids = spark.range(64).select(F.col("id"))
    path = spark.createDataFrame([(k, k + 1, float(k % 5)) for k in range(63) if k != 20], "src long, dst long, weight double")
    roots = {r.id: r.root for r in C.component_roots(ids, path).collect()}
    assert roots == {k: 20 if k <= 20 else 63 for k in range(64)}
    assert {r.id: r.root for r in C.component_roots(ids, path, in_one_task=10).collect()} == roots
    assert C.component_count(ids, path).first()[0] == 2
    asked = spark.createDataFrame([(0, 20), (20, 21)], "a long, b long")
    assert {(r.a, r.connected) for r in C.connected(asked, C.component_roots(ids, path)).collect()} == {(0, True), (20, False)}
    assert C.labels_of(ids, path, 4).select("label").distinct().count() == 5  # a forest of 2 without its 3 last edges
    assert [r.step for r in C.merges(path).orderBy("step").collect()] == list(range(1, 63))


def test_scalar_functions(spark):
    df = literal(spark, [(7, [3.0, 4.5])])
    row = df.select(
        G.point_hash(F.col("id"), F.col("coords")).alias("h"), G.point_string(F.col("id"), F.col("coords")).alias("s"), G.dimension(F.col("coords")).alias("d"),
        G.distance(F.col("coords"), F.array(F.lit(0.0), F.lit(0.5))).alias("w"), G.swap_bytes(F.lit(-2)).alias("b"), G.edge_string(F.lit(1), F.lit(2), F.lit(0.5)).alias("e"),
        G.point_equals(F.col("id"), F.col("coords"), F.lit(7), F.array(F.lit(3.0), F.lit(4.5))).alias("q"), G.point_distance(F.lit(1), F.col("coords"), F.lit(1), F.array(F.lit(9.0), F.lit(9.0))).alias("z"),
    ).first()
    assert tuple(row) == (7 * 163 + 2 * 57 + 7, "7: [3.00, 4.50]", 2, 5.0, -16777217, "[(1 2) 0.500000]", True, 0.0)
    assert df.select(G.point_hash(F.lit(1 << 40), F.col("coords")).alias("h")).first().h == ((1 << 40) * 163 + 121 + (1 << 31)) % (1 << 32) - (1 << 31)
    with pytest.raises(Exception, match="dimension 3 asked"):
        df.select(G.prefix(F.col("coords"), 3)).collect()
