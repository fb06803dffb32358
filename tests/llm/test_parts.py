"""Queries with an oracle in SQL, over the small tables."""

import os

import duckdb
import pytest

from treeline.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", ["op6_jaccard_join", *registry.PARTS])
def test_matches_its_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = (registry.QUERIES | registry.PARTS)[name](spark, DATA).toPandas()
    want = c.execute((registry.ORACLES | registry.PART_ORACLES)[name]).fetchdf()[list(got.columns)]
    key = lambda df: sorted(map(tuple, df.astype(object).itertuples(index=False)))
    assert len(got) == len(want) > 0 and key(got) == key(want)
    assert [str(t) for t in got.dtypes] == [str(t) for t in want.dtypes]
