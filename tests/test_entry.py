import os

import duckdb
import pytest

import __spark_entry__ as entry
from arachne.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["graph_edge_upsert", "local_clustering", "pagerank_fixed", "normalized_laplacian", "bgp_two_hop", "score_transe", "gcn", "tokenize_counts", "memory_decay"])
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.removesuffix('.parquet')} as from '{SF}/{t}'")
    want = con.sql(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    norm = lambda d: sorted(str(tuple(round(v, 4) + 0.0 if isinstance(v, float) else v for v in r)) for r in d.astype(object).itertuples(index=False, name=None))
    assert norm(got) == norm(want)
