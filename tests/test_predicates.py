"""Random predicates against a plain evaluation of the two-valued rules."""

import math
import random

import pytest

from tidemark.plans.bind import Source
from tidemark.session import Engine
from tidemark.types import DataType

OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
COLUMNS = {"i": DataType.INTEGER, "b": DataType.BIGINT, "f": DataType.FLOAT, "t": DataType.BOOLEAN, "s": DataType.VARCHAR}


def literal(rng, kind):
    if kind in (DataType.INTEGER, DataType.BIGINT):
        return rng.choice([0, 1, -1, 5, 2**31, -(2**31) - 1, 2**53 + 1, 10**30, -(10**30), 2**63])
    if kind is DataType.FLOAT:
        return rng.choice([0, 1, 0.5, -0.5, 2**53 + 1, -(2**53) - 1, 10**400, -(10**400), 3])
    return rng.choice([True, False]) if kind is DataType.BOOLEAN else rng.choice(["", "a", "b", "é"])


def spell(v):
    if isinstance(v, bool):
        return str(v).upper()
    return f"'{v}'" if isinstance(v, str) else str(v)


def tree(rng, depth):
    """SQL text, and a function of a row."""
    kind = rng.choice(["and", "or", "not", "leaf"]) if depth else "leaf"
    if kind == "not":
        sql, f = tree(rng, depth - 1)
        return f"NOT ({sql})", lambda r: not f(r)
    if kind in ("and", "or"):
        (a, f), (b, g) = tree(rng, depth - 1), tree(rng, depth - 1)
        return f"({a} {kind.upper()} {b})", (lambda r: f(r) and g(r)) if kind == "and" else (lambda r: f(r) or g(r))
    c = rng.choice(list(COLUMNS))
    if rng.random() < 0.2:
        return (f"{c} IS NULL", lambda r: r[c] is None) if rng.random() < 0.5 else (f"{c} IS NOT NULL", lambda r: r[c] is not None)
    op, v = rng.choice(list(OPS)), literal(rng, COLUMNS[c])
    return f"{c} {op} {spell(v)}", lambda r: r[c] is not None and OPS[op](r[c], v)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for k in range(120):
        rows.append((k, rng.choice([None, 0, 1, -1, 5, 2**31 - 1, -(2**31)]), rng.choice([None, 0, 1, 2**53, 2**53 + 1, 2**63 - 1]), rng.choice([None, 0.0, -0.0, 0.5, 1.0, float(2**53), float(2**53) + 2, math.nan, math.inf, -math.inf]), rng.choice([None, True, False]), rng.choice([None, "", "a", "b", "é"])))
    df = spark.createDataFrame(rows, "k int, i int, b long, f double, t boolean, s string").coalesce(1).cache()
    engine = Engine(spark)
    engine.register_frame("r", df)
    return engine, [dict(zip(("k", *COLUMNS), r, strict=True)) for r in rows]


@pytest.mark.parametrize("seed", range(6))
def test_random_trees(table, seed):
    engine, rows = table
    rng = random.Random(seed)
    parts, want = [], []
    for _ in range(12):
        sql, f = tree(rng, 3)
        parts.append(engine.frame(f"SELECT k FROM r WHERE {sql}"))
        want.append((sql, {r["k"] for r in rows if f(r)}))
    from functools import reduce

    from pyspark.sql import functions as F

    got = reduce(lambda a, b: a.unionByName(b), [p.withColumn("n", F.lit(n)) for n, p in enumerate(parts)]).collect()
    for n, (sql, ks) in enumerate(want):
        assert {r.k for r in got if r.n == n} == ks, sql


@pytest.mark.parametrize("seed", range(3))
def test_random_orderings(table, seed):
    engine, rows = table
    rng = random.Random(seed)
    rows = [r for r in rows if r["f"] is None or not math.isnan(r["f"])]
    keys = rng.sample(list(COLUMNS), 2)
    down = [rng.random() < 0.5 for _ in keys]
    want = list(rows)
    for c, d in reversed(list(zip(keys, down, strict=True))):
        want.sort(key=lambda r: (r[c] is None, r[c] if r[c] is not None else 0 if COLUMNS[c] is not DataType.VARCHAR else ""), reverse=d)
    order = ", ".join(f"{c} {'DESC' if d else 'ASC'}" for c, d in zip(keys, down, strict=True))
    got = engine.execute(f"SELECT k, f FROM r ORDER BY {order}").rows
    assert [k for k, f in got if f is None or not math.isnan(f)] == [r["k"] for r in want]


def test_predicates_and_columns_reach_the_scan(spark):
    engine = Engine(spark)
    engine.register_parquet("lineitem", "/root/testdata/sf0.001/lineitem.parquet")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = engine.frame("SELECT l_orderkey FROM lineitem WHERE NOT l_linenumber < 3 AND l_quantity >= 45")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_linenumber,3)" in plan and "GreaterThanOrEqual(l_quantity,45.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan


def test_binding_reads_nothing(spark):
    from tidemark.dialect.grammar import parse
    from tidemark.plans.bind import bind_select
    from tidemark.types import Column, Schema

    source = Source("t", Schema((Column("a", DataType.INTEGER),)), None)
    assert bind_select(parse("SELECT a FROM t WHERE a = 1 ORDER BY a"), lambda name: source).outputs[0].label == "a"
