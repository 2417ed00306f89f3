"""Queries built by calls instead of text; they bind and run as the text would.

    table(db, "users").where(col("age") >= 18).order_by("-age").select("name").limit(5).rows()

A predicate may also be a function of columns: where(lambda c: c("age") % 2 == 0). What it gives
for a row counts as false where it is NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame

from .dialect.grammar import And, Call, Compare, Custom, IsNull, Join, Not, Or, Ref, Select
from .plans.bind import bind_select
from .plans.compile import parse_ref, compile_query
from .session import Engine


@dataclass(frozen=True)
class Term:
    """A predicate that & | ~ combine."""

    node: object

    def __and__(self, other: Term) -> Term:
        return Term(And(self.node, other.node))

    def __or__(self, other: Term) -> Term:
        return Term(Or(self.node, other.node))

    def __invert__(self) -> Term:
        return Term(Not(self.node))


class col:
    """A column by name, or table.name in a join."""

    def __init__(self, name: str):
        self.ref = parse_ref(name)

    def _compare(self, op: str, value: object) -> Term:
        return Term(Compare(self.ref, op, value))

    def __eq__(self, value):
        return self._compare("=", value)

    def __ne__(self, value):
        return self._compare("!=", value)

    def __lt__(self, value):
        return self._compare("<", value)

    def __le__(self, value):
        return self._compare("<=", value)

    def __gt__(self, value):
        return self._compare(">", value)

    def __ge__(self, value):
        return self._compare(">=", value)

    __hash__ = None

    def is_null(self) -> Term:
        return Term(IsNull(self.ref))

    def is_not_null(self) -> Term:
        return Term(IsNull(self.ref, True))


@dataclass(frozen=True)
class Builder:
    engine: Engine
    statement: Select

    def _with(self, **changes) -> Builder:
        return replace(self, statement=replace(self.statement, **changes))

    def where(self, predicate: Term | Callable[[Callable[[str], SparkColumn]], SparkColumn]) -> Builder:
        """A further condition."""
        node = predicate.node if isinstance(predicate, Term) else Custom(predicate)
        before = self.statement.where
        return self._with(where=node if before is None else And(before, node))

    def join(self, table: str, left: str, right: str) -> Builder:
        return self._with(join=Join(table, parse_ref(left), parse_ref(right)))

    def select(self, *names: str) -> Builder:
        return self._with(items=(*(self.statement.items or ()), *map(parse_ref, names)))

    def group_by(self, *names: str) -> Builder:
        return self._with(group=tuple(map(parse_ref, names)))

    def agg(self, **functions: str | list[str]) -> Builder:
        """agg(count="*", sum=["a", "b"])"""
        calls = [Call(f.upper(), None if n == "*" else parse_ref(n)) for f, names in functions.items() for n in ([names] if isinstance(names, str) else names)]
        return self._with(items=(*(self.statement.items or ()), *calls))

    def order_by(self, *keys: str) -> Builder:
        """Names, with a minus before those that descend."""
        return self._with(order=tuple((parse_ref(k.lstrip("-")), k.startswith("-")) for k in keys))

    def limit(self, n: int, offset: int = 0) -> Builder:
        return self._with(limit=n, offset=offset)

    def frame(self) -> DataFrame:
        return compile_query(bind_select(self.statement, self.engine._source))

    def rows(self) -> tuple[tuple, ...]:
        return self.engine._collect(bind_select(self.statement, self.engine._source)).rows


def table(engine: Engine, name: str) -> Builder:
    return Builder(engine, Select(None, name))
