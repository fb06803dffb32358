"""Queries over whole tables of the largest size."""

import os

import duckdb
import pytest

from treeline.operators import components, contraction
from treeline.plans import catalog

DATA = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize(("name", "rows"), [("mst_ties", 19_999), ("is_connected", 2_000), ("bipartite_pairs", 1_500_000), ("mono_pairs", 499_000), ("nearest_neighbor", 2_000), ("dendrogram_merges", 1_999)])
def test_whole_tables_match_their_oracles(spark, name, rows):
    c = duckdb.connect()
    for t in ("part", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), c.execute(catalog.ORACLES[name]).fetchdf()
    key = list(got.columns)[:-1]
    got, want = (x[list(got.columns)].sort_values(key, ignore_index=True) for x in (got, want))
    assert len(got) == rows and (got[key] == want[key]).all(axis=None)
    assert ((got.iloc[:, -1].astype(float) - want.iloc[:, -1].astype(float)).abs() < 2e-6).all()


def test_few_links_take_no_rounds(spark, monkeypatch):
    """One task finishes what fits it; before, every round wrote four tables and more."""
    small, rounds = "/root/testdata/sf0.001", []
    monkeypatch.setattr(contraction, "between", lambda *a, real=contraction.between: rounds.append(1) or real(*a))
    taken = [(r.id, r.root) for r in catalog.component_root(spark, small).collect()]
    assert catalog.single_linkage_labels(spark, small).count() == len(taken) and not rounds
    edges = components.cut_at(catalog.tree(spark, small), catalog.HEIGHT)
    assert sorted(taken) == sorted((r.id, r.root) for r in components.component_roots(catalog.vectors(spark, small).select("id"), edges).collect()) and rounds
