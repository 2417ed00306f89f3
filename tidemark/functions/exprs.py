"""Two-valued predicates, exact aggregates and null ordering as Column expressions.

A comparison with NULL is false, also under NOT. Negation is pushed to the leaves, so no leaf can
turn UNKNOWN, and every leaf is a form that reaches the Parquet scan. Literals are made to fit the
column's type here, so that no cast stands around a column.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import DataType

INVERSE = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
_OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _never(negate: bool) -> Column:
    return F.lit(negate)


def _always(c: Column, negate: bool) -> Column:
    """True for every value that isn't null."""
    return c.isNull() if negate else c.isNotNull()


def compare(c: Column, kind: DataType, op: str, value: object, negate: bool = False) -> Column:
    """c op value, or its two-valued negation."""
    if kind.bounds and not kind.bounds[0] <= value <= kind.bounds[1]:
        above = value > 0
        true = op == "!=" or op in ("<", "<=") and above or op in (">", ">=") and not above
        return _always(c, negate) if true else _never(negate)
    if kind is DataType.FLOAT:
        if type(value) is int:
            try:
                near = float(value)
            except OverflowError:
                near = sys.float_info.max if value > 0 else -sys.float_info.max
            if int(near) != value:  # no double equals it; the neighbour decides
                if op == "=":
                    return _never(negate)
                if op == "!=":
                    return _always(c, negate)
                if near < value:
                    op = "<=" if op in ("<", "<=") else ">"
                else:
                    op = "<" if op in ("<", "<=") else ">="
            value = near
        return _float(c, op, value, negate)
    leaf = F.lit(value).cast(kind.spark)
    return c.isNull() | _OPS[INVERSE[op]](c, leaf) if negate else _OPS[op](c, leaf)


def _float(c: Column, op: str, value: float, negate: bool) -> Column:
    """NaN compares false but for !=, while Spark ranks it above all."""
    leaf = F.lit(value)
    if not negate:
        return _OPS[op](c, leaf) & ~F.isnan(c) if op in (">", ">=") else _OPS[op](c, leaf)
    inverse = c.isNull() | _OPS[INVERSE[op]](c, leaf)
    return inverse | F.isnan(c) if op in (">", ">=") else inverse


def is_null(c: Column, negated: bool, negate: bool = False) -> Column:
    return c.isNotNull() if negated != negate else c.isNull()


def ordering(c: Column, descending: bool) -> Column:
    """Nulls last when ascending, first when descending."""
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def aggregate(function: str, c: Column | None, kind: DataType | None) -> Column:
    """Integer sums are exact whatever the order, and fail only if the total is out of range."""
    if c is None:
        return F.count(F.lit(1))
    if function == "COUNT":
        return F.count(c)
    if function in ("MIN", "MAX"):
        return getattr(F, function.lower())(c)
    if kind is DataType.FLOAT:
        return F.sum(c) if function == "SUM" else F.avg(c)
    total = F.sum(c.cast("decimal(38,0)"))
    return total.cast("bigint") if function == "SUM" else total.cast("double") / F.nullif(F.count(c), F.lit(0))


def result_type(function: str, kind: DataType | None) -> DataType:
    if function == "COUNT":
        return DataType.BIGINT
    if function == "AVG":
        return DataType.FLOAT
    if function == "SUM":
        return DataType.FLOAT if kind is DataType.FLOAT else DataType.BIGINT
    return kind
