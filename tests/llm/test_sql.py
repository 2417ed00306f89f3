"""The queries that SQL can state, on a whole sample table."""

import duckdb
import pytest

from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(found.fetchall())
    got = QUERIES[name](spark, SF)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == want
