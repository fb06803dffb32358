"""Searches of vectors against brute force: hard negatives row for row, neighbours by recall."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm import op12_negatives, op13_neighbours, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, row string, cell int, probe long"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)


def mixture(seed: int, n: int, d: int, clusters: int, wide: float) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)] + wide * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


@pytest.fixture(scope="module")
def rows():
    """A third of all rows is one vector; there are ties, equal rows, rows that take no part and one long vector."""
    rng = np.random.default_rng(1)
    x = mixture(2, 900, 6, 12, 0.2).astype(float).tolist()
    for k in range(0, 900, 3):
        x[k] = x[0]
    out = [(k, v, int(rng.integers(0, 4))) for k, v in enumerate(x)]
    out += [(100, x[100], 2), (200, x[200], None), (300, None, 1), (None, x[5], 1), (901, [], 1), (902, [0.0] * 6, 1), (903, [1.0], 3), (904, [*x[1][:5], None], 2), (905, [*x[1][:5], math.nan], 2), (906, [*x[1][:5], math.inf], 2)]
    return [*out, (1000, [30 * y for y in x[7]], 1), (1001, x[1], 0), (1001, x[1], 0), (-100, x[4], 1), (-7, x[7], 3)]


def mined(rows) -> list[tuple]:
    kept = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(np.float32(y))) for y in v]) for i, v, lab in rows if i is not None and v and lab is not None and len(v) == 6 and all(y is not None and math.isfinite(y) for y in v)]
    x = np.array([v for _, _, v in kept], np.int64)
    out = []
    for a, (anchor, label, _) in enumerate(kept):
        if anchor % 100:
            continue
        score = x @ x[a]
        near = sorted((b for b in range(len(kept)) if b != a), key=lambda b: (-score[b], kept[b][0]))
        for p in [b for b in near if kept[b][1] == label][:5]:
            inside = [b for b in near if kept[b][1] != label and 30 * score[p] <= 100 * score[b] <= 90 * score[p]]
            out += [(anchor, kept[p][0], k + 1, kept[b][0], int(score[p]), int(score[b])) for k, b in enumerate(inside[:10])]
    return sorted(out)


def small(monkeypatch):
    """Many leaves, chunks and blocks for a few rows."""
    for m, name, value in ((vectors, "ROWS", 64), (vectors, "PROBES", 8), (vectors, "AT_ONCE", 3), (op12_negatives, "LEAF_ROWS", 8), (op12_negatives, "FIRST", 20), (op13_neighbours, "CELL_ROWS", 8), (op13_neighbours, "FIRST", 40), (op13_neighbours, "FIT_ROWS", 300)):
        monkeypatch.setattr(m, name, value)


@pytest.mark.parametrize("fine", [False, True])
def test_hard_negatives(spark, rows, tmp_path, monkeypatch, fine):
    if fine:
        small(monkeypatch)
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op12_negatives.query(spark, str(tmp_path))
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    want = mined(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300


def test_tree_bounds_hold():
    x = np.floor(256 * mixture(5, 2000, 8, 30, 0.1).astype(float))
    most = float((x * x).sum(1).max())
    longer = op12_negatives.longer(x, most)
    vantage, radius = op12_negatives.grown(longer[::5], 5)
    leaf, away = op12_negatives.descend(longer, vantage, radius, 5)
    low, high = (np.stack([f(away[leaf == k], axis=0) if (leaf == k).any() else np.zeros(5) for k in range(32)]) for f in (np.min, np.max))
    least, greatest = op12_negatives.bounds(x[:50], most, vantage, low, high)
    score = x[:50] @ x.T
    assert (score >= least[:, leaf]).all() and (score <= greatest[:, leaf]).all()
    top = np.sort(score, 1)[:, -10]
    assert (greatest[:, np.unique(leaf)] >= top[:, None]).mean() < 0.5  # half of the leaves can't hold one of the best ten


def test_neighbours_of_odd_rows(spark, rows, monkeypatch):
    small(monkeypatch)
    got = op13_neighbours.neighbours(table(spark, rows), F.col("id") % 20 == 0, 20).collect()
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and len(v) == 6 and all(y is not None and math.isfinite(y) for y in v) and any(v)]
    x = np.stack([v for _, v in kept])
    lists = {}
    for r in got:
        lists.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(lists) == {i for i, _ in kept if i % 20 == 0}
    found = total = 0
    for a, (query, v) in enumerate(kept):
        if query % 20 or sum(i == query for i, _ in kept) > 1:
            continue
        score = np.zeros(len(x))
        for c in range(6):
            score += v[c] * x[:, c]
        want = sorted((-score[b], kept[b][0]) for b in range(len(kept)) if b != a)[:20]
        mine = sorted(lists[query])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and mine == [(k + 1, i, s) for k, (s, i) in enumerate(sorted(((s, i) for _, i, s in mine), key=lambda z: (-z[0], z[1])))]
        found += len({(i, s) for _, i, s in mine} & {(i, -s) for s, i in want})
        total += 20
    assert found / total >= 0.95


@pytest.mark.parametrize(("clusters", "wide"), [(40, 0.05), (40, 0.4), (1, 9.0)])
def test_recall(spark, monkeypatch, clusters, wide):
    """Of clusters, of overlapping ones, and of directions drawn at random."""
    monkeypatch.setattr(op13_neighbours, "FIRST", 200)
    x = mixture(9, 4000, 32, clusters, wide)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], T._parse_datatype_string("vec_id long, embedding array<float>"))
    got = op13_neighbours.neighbours(df, F.col("id") % 20 == 0).collect()
    score = x[::20].astype(float) @ x.astype(float).T
    score[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    want = {(20 * q, int(i)) for q, top in enumerate(np.argsort(-score, 1)[:, :20]) for i in top}
    assert len(got) == 4000 and len({(r.query_id, r.vec_id) for r in got} & want) / 4000 >= 0.9


def test_pairs_come_by_falling_sum():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=9), rng.normal(size=7)
    got = list(op13_neighbours.pairs(a, b))
    assert len({(i, j) for _, i, j in got}) == 63 and all(s == a[i] + b[j] for s, i, j in got)
    assert [s for s, _, _ in got] == sorted((s for s, _, _ in got), reverse=True)


def test_huge_components(spark, tmp_path):
    """Vectors whose square length overflows take no part; scores that fit no long are null."""
    rows = [(k, [float(k % 5), 1.0], k % 2) for k in range(1, 40)] + [(100, [1.0, 2.0], 1), (200, [1e300, 1.0], 0), (300, [1e20, 1e20], 1), (301, [1e19, 1e19], 1), (302, [8e18, 2e18], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op12_negatives.query(spark, str(tmp_path)).collect()
    assert {r.anchor_id for r in got} == {100, 300} and any(r.anchor_id == 300 and r.positive_score is None for r in got)
    got = op13_neighbours.neighbours(df, F.col("id") % 100 == 0, 3).collect()
    assert {r.query_id for r in got} == {100, 300} and [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 100] == [300, 301, 302]


def test_few_and_no_rows(spark):
    none = table(spark, [])
    assert op13_neighbours.neighbours(none, F.lit(True)).count() == 0
    assert op12_negatives.mined(none.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")), F.lit(True)).count() == 0
    two = table(spark, [(20, [1.0, 0.0], 1), (21, [1.0, 1.0], None)])
    assert [tuple(r) for r in op13_neighbours.neighbours(two, F.col("id") % 20 == 0).collect()] == [(20, 1, 21, 1.0)]
    assert op13_neighbours.neighbours(two, F.lit(False)).count() == 0
