import duckdb
import pytest

import __spark_entry__ as entry
from inkmesh import queries, record_queries

QUERIES = queries.QUERIES | record_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | record_queries.ORACLE_SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


# a map's links come from the same build as its nodes, which are compared here
@pytest.mark.parametrize("name", [n for n in QUERIES if not (n.startswith("map_") and n.endswith("_links"))])
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLE_SQL:
        assert len(got) > 0
        return
    want = con.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
