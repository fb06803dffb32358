import os

import duckdb
import pytest

import __spark_entry__
from treeline.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("part", "supplier", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    return sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ["mst_edges", "mst_ties", "local_mst_stats", "merge_round_1", "component_root", "nearest_neighbor", "split_assign", "subgraph_plan", "fanin_schedule", "point_hash", "swap_bytes", "edge_format", "single_linkage_labels", "mst_contracted", "forest_of_pairs", "mst_spatial", "matrix_scan", "sequence_roundtrip", "sample_display", "paired_display", "run_command", "split_command"])
def test_queries_match_their_oracles(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).fetchdf())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 499
    assert set(catalog.ORACLES) == set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_splits_stay_readable_when_others_are_saved(spark):
    first, second = catalog.QUERIES["split_roundtrip"](spark, DATA), catalog.QUERIES["splits_all"](spark, DATA)
    assert first.count() == 250 and second.count() == 500 and first.count() == 250


def test_no_pair_query_joins_all_with_all(spark):
    for name in ("pairwise_distance", "bipartite_pairs", "mono_pairs"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
