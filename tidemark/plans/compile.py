"""A bound query as one lazy DataFrame.

Columns carry internal names c<source>_<ordinal>, so Spark resolves nothing of the user's. Scan
order is a row ordinal per source: results are in that order where no ORDER BY rules, but a sort
is made only where order shows (LIMIT, or `ordered`). Pruning, pushdown, join strategy and top-k
are Catalyst's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dialect.grammar import And, Not, Or, Ref
from ..functions.exprs import aggregate, compare, is_null, ordering
from ..types import DataType
from .bind import Built, Query, Slot, Test, index_test


def name(slot: Slot) -> str:
    return f"c{slot.source}_{slot.ordinal}"


def parse_ref(text: str) -> Ref:
    table, _, column = text.rpartition(".")
    return Ref(column, table or None)


def predicate(p, negate: bool = False) -> Column:
    if isinstance(p, Not):
        return predicate(p.inner, not negate)
    if isinstance(p, (And, Or)):
        left, right = predicate(p.left, negate), predicate(p.right, negate)
        return left & right if isinstance(p, And) != negate else left | right
    if isinstance(p, Built):
        made = F.coalesce(p.build(lambda n: F.col(name(p.scope.slot(parse_ref(n))))), F.lit(False))
        return ~made if negate else made
    test: Test = p
    c = F.col(name(test.slot))
    if test.op in ("null", "not null"):
        return is_null(c, test.op == "not null", negate)
    return compare(c, test.slot.column.type, test.op, test.value, negate)


def scan(query: Query, k: int, rids: bool = True, below: int | None = None) -> DataFrame:
    """A source with internal names and, if asked for, its row ordinal r<k>; an index that the predicate
    names is read in place of the table. below: of a managed table, only ordinals below it."""
    source = query.sources[k]
    frame, rid = source.table.frame(rids)
    if source.table.managed and not query.on and (hit := index_test(query.where, source.table.indexes)):
        frame = source.table.index_frame(hit[0])
    if below is not None:
        frame = frame.where(rid < below)
    columns = [F.col(c.name).alias(f"c{k}_{i}") for i, c in enumerate(source.schema.columns)]
    return frame.select(*columns, *([rid.alias(f"r{k}")] if rids else ()))


def filtered(query: Query, rids: bool, below: int | None = None) -> DataFrame:
    df = scan(query, 0, rids, below)
    if query.on:
        left, right = query.on
        keys = F.col(name(left)) == F.col(name(right))
        if left.column.type is DataType.FLOAT:
            keys &= ~F.isnan(name(left))
        df = df.join(scan(query, 1, rids), keys, "inner")
    return df if query.where is None else df.where(predicate(query.where))


def compile_query(query: Query, ordered: bool = False, below: int | None = None) -> DataFrame:
    sort = (ordered or query.limit is not None) and query.group != ()
    df = filtered(query, sort, below)
    rids = [f"r{k}" for k in range(len(query.sources))]
    if query.group is None:
        keys = [ordering(F.col(name(s)), d) for s, d in query.order]
        out = [F.col(name(o.slot)).alias(f"o{i}") for i, o in enumerate(query.outputs)]
        df = df.orderBy(*keys, *(rids if sort else ())) if keys or sort else df
        df = _cut(df, query).select(*out)
    else:
        made = [aggregate(o.function, F.col(name(o.slot)) if o.slot else None, o.slot and o.slot.column.type).alias(f"a{i}") for i, o in enumerate(query.outputs) if o.function]
        groups = list(dict.fromkeys(name(s) for s in query.group))
        if groups and sort:
            made.append(F.min(F.struct(*rids)).alias("first"))
        df = df.groupBy(*groups).agg(*made) if groups else df.agg(*made)
        at = {o: f"a{i}" if o.function else name(o.slot) for i, o in enumerate(query.outputs)}
        keys = [ordering(F.col(at[o]), d) for o, d in query.order]
        if groups and (keys or sort):
            df = df.orderBy(*keys, *(["first"] if sort else ()))
        df = _cut(df, query).select(*(F.col(at[o]).alias(f"o{i}") for i, o in enumerate(query.outputs)))
    return df.toDF(*(o.label for o in query.outputs))


def _cut(df: DataFrame, query: Query) -> DataFrame:
    if query.limit is None:
        return df
    df = df.offset(query.offset) if query.offset else df
    return df.limit(query.limit)
