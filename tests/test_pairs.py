"""All pairs in blocks: the same pairs and bits as one join, with a task for each block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.functions.geometry import distance
from treeline.operators import pairs as operator
from treeline.operators.pairs import pairs_across, pairs_within
from treeline.plans.splits import with_splits

ODD = [(3, None), (5, [1.0]), (8, [1.0, None, 2.0]), (9, [float("nan"), 0.0, 1.0]), (9, [2.0, 0.0, 1.0]), (12, [])]


@pytest.mark.parametrize("odd", [False, True])
def test_blocks_give_what_a_join_gives(spark, odd):
    rows = [(k, [(k * 37 % 101) / 7, (k * k % 53) / 3, k / 9]) for k in range(20, 80)] + ODD * odd
    p = with_splits(spark.createDataFrame(rows, "id long, coords array<double>"), 3).localCheckpoint()
    a, b = (p.select(F.col("id").alias(f"id_{x}"), F.col("coords").alias(f"c_{x}"), F.col("split").alias(f"k_{x}")) for x in "ab")
    met = a.join(b, F.expr("id_a < id_b")).select("id_a", "id_b", distance(F.col("c_a"), F.col("c_b")), "k_a", "k_b")
    want = {True: [], False: []}
    for x, y, w, k, m in met.collect():
        low, high = sorted((k, m))
        want[k != m].append((low + high * (high - 1) // 2 if k != m else 3 + k, x, y, repr(w)))
    for across, pairs in ((True, pairs_across), (False, pairs_within)):
        made = pairs(p, 3, 8)
        got = made.withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r.sg, r.src, r.dst, repr(r.weight)) for r in got) == sorted(want[across])
        tasks = [r.task for r in got]
        assert max(map(tasks.count, set(tasks))) <= 1200 and len(set(tasks)) >= 9 * (1 + across)  # before: a task for each subgraph


@pytest.mark.parametrize("made", [pairs_across, operator.pairs, pairs_within])
def test_points_are_not_dealt_to_each_block_they_meet(spark, made):
    """Scratch has a point once; before, a shuffle had it once for each block that its own meets."""
    p = with_splits(spark.range(200).select("id", F.array(F.col("id") / 7, F.col("id") % 5 * 1.0).alias("coords")), 2).localCheckpoint()
    plan = made(p, 2, 8)._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString() and "Shuffle" not in plan.toRdd().toDebugString()


def test_blocks_hold_each_point_once(spark, monkeypatch):
    """In half the bits where nothing is lost; a block ends at its rows or its bytes, and long rows have blocks of their own."""
    rows = [(k, [k / 8] * (k % 4)) for k in range(90)] + [(90, [0.1] * 2), (91, None), (92, [None, 1.0]), (None, [1.0]), (93, [float("nan"), -0.0, 1e300]), (94, [0.5] * 40)]
    p = with_splits(spark.createDataFrame(rows, "id long, coords array<double>"), 2).localCheckpoint()
    monkeypatch.setattr(operator, "BLOCK_BYTES", 100)
    blocks = [operator._points(r.block) for r in operator._Blocks(p, 2, 12, None).table.collect()]
    assert sorted(str(r) for b in blocks for r in zip(*b.to_pydict().values(), strict=True)) == sorted(str(r) for r in rows if r[0] is not None)
    assert all(len(b) <= 12 and (len(b) == 1 or sum(len(c or []) for c in b.column("coords").to_pylist()[:-1]) * 8 < 100) for b in blocks)


def test_rounding_is_that_of_spark(spark):
    """Of ties, of their neighbours and of what has no more digits too."""
    r = np.random.default_rng(3)
    ties = (r.integers(0, 10**7, 4000) + 0.5) / 1e6
    odd = np.array([0.0, 1e-9, 5e-7, 4.9999999999999998e-7, 1.0000005, 2.5e-6, 1e15, 1e16 / 3, 1e300, float("inf"), float("nan"), 2.0**40 / 1e6, 2.0**33 + 0.1234565])
    x = np.concatenate([ties, np.nextafter(ties, 0), np.nextafter(ties, 9e9), r.random(4000) * 3, r.random(4000) * 1e7, -ties, odd])
    want = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "k int, v double").select(F.round("v", 6), "k").orderBy("k").collect()
    assert [repr(v) for v in operator.rounded(x.reshape(1, -1), 6).ravel().tolist()] == [repr(w[0]) for w in want]


@pytest.mark.parametrize(("n", "splits"), [(0, 2), (1, 3), (7, 1)])
def test_few_points_and_one_split(spark, n, splits):
    p = with_splits(spark.range(n).select("id", F.array(F.col("id") * 1.0).alias("coords")), splits).localCheckpoint()
    across, within, both = (made(p, splits, 2).count() for made in (pairs_across, pairs_within, operator.pairs))
    assert across + within == both == n * (n - 1) // 2 and (splits > 1 or not across)
