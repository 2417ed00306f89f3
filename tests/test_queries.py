"""Every registered relational query against its SQL in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in [*Q.TABLES, "embeddings"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: "~" if v is None else f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    rel = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert norm(got, df.columns) == norm(want, names)
    if name not in ("limit_zero", "offset_past_end"):
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() == 5
