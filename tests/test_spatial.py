"""Trees by blocks of a kd-tree against trees of all pairs, and what is spared."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.__main__ import clustered
from treeline.model import Counters, InvalidPoints
from treeline.operators.mst import local_trees, merge_round, mst
from treeline.operators.pairs import pairs, pairs_across, pairs_within
from treeline.operators.spatial import block_of, bottlenecks, kd_tree, spatial_mst
from treeline.plans.splits import numbered, with_splits
from treeline.session import shared_dir
from treeline.sources.tables import literal, read_splits, save_splits


def points(spark, coords, ids=None):
    return literal(spark, [(int(i), [float(x) for x in c]) for i, c in zip(ids if ids is not None else range(len(coords)), coords, strict=True)])


def edges(df):
    return sorted((r.src, r.dst, r.weight) for r in df.collect())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["clusters", "grid", "copies", "line"])
def test_same_tree_as_all_pairs(spark, kind):
    rng = np.random.default_rng(7)
    x = {
        "clusters": rng.normal(size=(9, 3))[rng.integers(0, 9, 300)] * 4 + rng.normal(size=(300, 3)) / 3,
        "grid": rng.integers(0, 9, (250, 2)).astype(float),
        "copies": np.concatenate([np.full((120, 2), 2.0), rng.random((120, 2)) * 3]),
        "line": np.stack([np.arange(200.0), np.zeros(200)], 1),
    }[kind]
    p = points(spark, x, rng.permutation(5000)[: len(x)])
    counters = Counters()
    assert edges(spatial_mst(p, block_rows=20, counters=counters)) == edges(mst(p, 1, 2))
    assert counters.read()["distances"] < len(x) * (len(x) - 1) // 2


def test_few_and_bad_points(spark):
    assert edges(spatial_mst(points(spark, []))) == []
    assert edges(spatial_mst(points(spark, [[1, 2]]))) == []
    assert edges(spatial_mst(points(spark, [[1, 2]] * 3, [4, 9, 6]), block_rows=1)) == [(4, 6, 0.0), (4, 9, 0.0)]
    with pytest.raises(InvalidPoints):
        spatial_mst(literal(spark, [(0, [1.0]), (0, [2.0])]))


def test_a_tenth_of_the_distances(spark):
    counters = Counters()
    p = clustered(spark, 8192, 5)
    n, total = spatial_mst(p, block_rows=256, counters=counters).agg(F.count("*"), F.sum("weight")).first()
    seen = counters.read()
    assert n == 8191 and seen["distances"] < 8192 * 8191 // 2 // 10 and seen["pairs_met"] < 32 * 31 // 2
    assert abs(total - mst(p, 4, 3).agg(F.sum("weight")).first()[0]) < 1e-6


def test_parts_of_blocks():
    x = np.random.default_rng(3).random((1000, 2))
    tree = kd_tree(x, 16)
    sizes = np.bincount(block_of(x, tree), minlength=16)
    assert 15 <= sizes.min() and sizes.max() <= 140 and sizes.sum() == 1000
    apart = np.concatenate([x, x[:300] + [9.0, 0.0]])
    block = block_of(apart, kd_tree(apart, 8))
    assert not set(block[:1000]) & set(block[1000:])  # no block spans the gap
    got = bottlenecks(4, [(0, 1, 3.0), (1, 2, 1.0), (2, 3, 2.0)])
    assert got.tolist() == [[0, 3, 3, 3], [3, 0, 1, 2], [3, 1, 0, 2], [3, 2, 2, 0]]


def test_counters_of_a_run(spark):
    p, counters = points(spark, np.random.default_rng(5).random((60, 4))), Counters()
    assert mst(p, 3, 2, counters=counters).count() == 59  # one action
    seen = counters.read()
    assert seen["points"] == 60 and seen["distances"] == 60 * 59 // 2 and seen["edges_local"] == 3 * 60 - 3 * 4 // 2
    assert [seen[f"edges_round_{k}"] for k in (1, 2, 3)][-1] == 59


def test_fewer_edges_are_shuffled_when_partitions_merge_first(spark):
    p = with_splits(points(spark, np.random.default_rng(6).random((200, 3))), 4)
    trees = local_trees(p, 4, 4).withColumnRenamed("sg", "grp")
    early, late = (merge_round(trees, 3, 4, early=e) for e in (True, False))
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, late.collect()))

    def shuffled(df):
        """Rows that the exchange by group wrote."""
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        found, todo = [], [plan]
        while todo:
            node = todo.pop()
            if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                todo.append(node.executedPlan())
            elif "QueryStage" in node.getClass().getSimpleName():
                todo.append(node.plan())
            else:
                if node.getClass().getSimpleName() == "ShuffleExchangeExec":
                    found.append(node.metrics().apply("shuffleRecordsWritten").value())
                todo += [node.children().apply(k) for k in range(node.children().size())]
        return found

    before, after = shuffled(late)[0], shuffled(early)[0]
    assert before == trees.count() and after < 0.8 * before


def test_contraction_gives_the_same_tree(spark):
    p = points(spark, np.random.default_rng(8).integers(0, 12, (150, 2)))
    assert edges(mst(p, 4, 3, task_rows=30)) == edges(mst(p, 1, 2))


def test_pairs_meet_once_and_by_an_equi_join(spark):
    x = np.random.default_rng(9).random((41, 3))
    p = with_splits(points(spark, x), 4)
    across, within = pairs_across(p, 4), pairs_within(p, 4)
    assert [n for df in (across, within) for n in ("NestedLoop", "CartesianProduct") if n in plan_of(df)] == []
    assert within.count() == 3 * 45 + 55 and across.count() == 41 * 40 // 2 - within.count()
    assert {r.sg for r in across.collect()} == set(range(6)) and {r.sg for r in within.collect()} == set(range(6, 10))
    want = sorted((i, j, float(np.linalg.norm(x[i] - x[j]))) for i in range(41) for j in range(i + 1, 41))
    got = edges(pairs(p, 4))
    assert [e[:2] for e in got] == [e[:2] for e in want] and np.allclose([e[2] for e in got], [e[2] for e in want])


def test_numbering_writes_nothing_and_is_dense(spark):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("id"), F.lit(1.0).alias("w"))
    got = {r.id: r["index"] for r in numbered(df, "w", "id").collect()}
    sizes = [r["count"] for r in with_splits(points(spark, [[k] for k in range(103)]), 7).groupBy("split").count().collect()]
    assert got == {k: k for k in range(5000)} and sorted(sizes) == [14, 14, 15, 15, 15, 15, 15]
    assert set(folder.iterdir()) == before
    assert numbered(df.limit(0), "id").count() == 0
    assert [r["index"] for r in numbered(spark.createDataFrame([(None,), ("b",), ("a",)], "s string"), "s").orderBy("s").collect()] == [0, 1, 2]


def test_split_runs_stay_readable(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        read_splits(spark, path)
    save_splits(with_splits(points(spark, [[k] for k in range(9)]), 3), path)
    first = read_splits(spark, path)
    save_splits(with_splits(points(spark, [[k] for k in range(4)]), 2), path)
    second = read_splits(spark, path, 0)
    assert first.count() == 9 and second.count() == 2 and read_splits(spark, path).count() == 4
