"""Trees from near pairs, with what is remote from them, against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.operators import mst as M
from treeline.operators import near
from treeline.operators.kernels import distances, prim, within
from treeline.operators.mst import cell_trees, local_trees, mst
from treeline.plans import catalog
from treeline.plans.splits import with_splits
from treeline.session import written
from treeline.sources.tables import literal

RNG = np.random.default_rng(11)
DRAWN = RNG.standard_normal((240, 6))
SETS = {
    "drawn": DRAWN,
    "far points": np.vstack([DRAWN, 50 + 20 * RNG.standard_normal((5, 6)), DRAWN[:1] + 90, DRAWN[:1] + 90.01]),
    "grid": np.unique(RNG.integers(0, 9, (240, 3)), axis=0).astype(float),
}


def points(spark, x):
    return literal(spark, [(int(i), [float(c) for c in row]) for i, row in zip(np.random.default_rng(2).permutation(2000), x)])


def edges(df, *more):
    return sorted(tuple(r[c] for c in (*more, "src", "dst", "weight")) for r in df.collect())


@pytest.mark.parametrize("bipartite", [False, True])
@pytest.mark.parametrize("name", SETS)
def test_all_pairs_within_a_bound_are_listed(name, bipartite):
    x = SETS[name]
    ids, side = RNG.permutation(1000)[: len(x)], RNG.integers(1, 3, len(x)) if bipartite else np.zeros(len(x), int)
    top = float(np.sort(distances(x[0], x))[9])
    want = sorted((min(ids[i], ids[j]), max(ids[i], ids[j]), w) for i in range(len(x)) for j, w in enumerate(distances(x[i], x)) if i < j and w <= top and (not bipartite or side[i] != side[j]))
    assert sorted(zip(*(c.tolist() for c in within(ids, x, side, top, len(x))), strict=True)) == want
    assert within(ids, x, side, 1e3, 1) is None  # too many to list
    assert within(ids, x * 1e160, side, top) is None


@pytest.mark.parametrize("name", SETS)
def test_trees_from_near_pairs_are_those_of_cells(spark, name):
    p = points(spark, SETS[name])
    n = len(SETS[name])
    one = written(p.withColumn("split", F.lit(0)), "one")
    got = near.near_forests(one, n, 1, 4_000_000, near_rows=20)
    s, d, w = prim(*(np.array(c) for c in zip(*((r.id, r.coords) for r in p.collect()), strict=True)), np.zeros(n, int))
    assert edges(got) == sorted(zip(s.tolist(), d.tolist(), w.tolist(), strict=True)) == edges(mst(p, 3, 2, near_from=0))
    if name == "far points":
        assert edges(near.near_forests(one, n, 1, 50, near_rows=20)) == edges(got)  # by contraction
    divided = written(with_splits(p, 3), "divided")
    want = edges(local_trees(divided, 3), "sg")
    assert edges(near.near_forests(divided, n, 3, 4_000_000, near_rows=20), "sg") == want
    assert edges(local_trees(divided, 3, near_from=0), "sg") == want
    for kind, of in (("bipartite", range(3)), ("complete", range(3, 6))):
        assert edges(local_trees(divided, 3, kind=kind, near_from=0), "sg") == edges(local_trees(divided, 3, kind=kind, cell_rows=30), "sg") == [e for e in want if e[0] in of]


def test_few_links_leave_a_cell(spark):
    """Of cells, each point's edges of every tree are shuffled: one for each part, however many there are."""
    p = written(points(spark, SETS["drawn"]).withColumn("split", F.lit(0)), "p")
    top = near.bound(p, 240, 1, 10)
    assert near.links(p, 1, 12, top).count() < cell_trees(p, 1, cell_rows=20)[0].count()


def test_without_a_bound_that_serves_trees_come_by_cells(spark, monkeypatch):
    x = np.exp(3 * RNG.standard_normal((240, 1))) * DRAWN  # of very different densities
    p = points(spark, x)
    divided = written(with_splits(p, 2), "divided")
    assert near.near_forests(divided, 240, 2, 4_000_000, remote=3) is None
    monkeypatch.setattr(M, "near_forests", lambda *a, **k: None)
    assert edges(local_trees(divided, 2, near_from=0), "sg") == edges(local_trees(divided, 2), "sg")
    assert edges(mst(p, 2, 3, near_from=0)) == edges(mst(p, 2, 3))


def test_only_the_subgraphs_asked_for_are_solved(spark, tmp_path, monkeypatch):
    """Before, all subgraphs were solved and those of the other kind dropped."""
    rows = [(k, [float(c) for c in x]) for k, x in enumerate(DRAWN)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    kinds = []
    monkeypatch.setattr(catalog, "local_trees", lambda *a, real=local_trees, **k: (kinds.append(k.get("kind")), real(*a, **k))[1])
    whole = edges(catalog.rounded(catalog.local(spark, str(tmp_path))), "sg")
    assert edges(catalog.local_mst_complete(spark, str(tmp_path)), "sg") == [e for e in whole if e[0] >= 6]
    assert edges(catalog.local_mst_bipartite(spark, str(tmp_path)), "sg") == [e for e in whole if e[0] < 6]
    assert kinds == [None, "complete", "bipartite"]
