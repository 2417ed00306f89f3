"""UPDATE and DELETE as rewrites of a snapshot; the row ordinals stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import TupleSizeError
from ..plans.compile import predicate
from ..sources.catalog import RID, ManagedTable
from ..types import FIXED_BYTES, MAX_ROW_BYTES, Schema


def _frame(table: ManagedTable) -> DataFrame:
    df, _ = table.frame()
    schema = table.schema
    return df.select(*(F.col(c.name).alias(f"c0_{i}") for i, c in enumerate(schema.columns)), RID)


def _named(df: DataFrame, schema: Schema) -> DataFrame:
    return df.select(*(F.col(f"c0_{i}").alias(c.name) for i, c in enumerate(schema.columns)), RID)


def _row_bytes(schema: Schema):
    size = F.lit(schema.fixed_bytes())
    for i, c in enumerate(schema.columns):
        own = F.lit(FIXED_BYTES[c.type]) if c.type in FIXED_BYTES else F.octet_length(f"c0_{i}") + 2
        size = size + F.when(F.col(f"c0_{i}").isNotNull(), own).otherwise(0)
    return size


def _commit(table: ManagedTable, df: DataFrame, seen: Observation) -> int:
    """Writes the new snapshot and counts in the same job; commits if a row changed and all fit."""
    where = table.write(df)
    stats = seen.get
    n = stats["n"] or 0
    if n and not (stats.get("bytes") or 0) > MAX_ROW_BYTES:
        table.commit([where])
    else:
        table.catalog.files.delete(where)
    if (stats.get("bytes") or 0) > MAX_ROW_BYTES:
        raise TupleSizeError(f"a row would take {stats['bytes']} bytes; {MAX_ROW_BYTES} are allowed")
    return n


def update(table: ManagedTable, values: dict[int, object], where) -> int:
    """Rows that matched. All are judged on the snapshot before, and changed together or not at all."""
    if not table.entry["dirs"]:
        return 0
    schema, seen = table.schema, Observation()
    hit = F.lit(True) if where is None else F.coalesce(predicate(where), F.lit(False))
    df = _frame(table).withColumn("hit", hit)
    for k, v in values.items():
        df = df.withColumn(f"c0_{k}", F.when(F.col("hit"), F.lit(v).cast(schema.columns[k].type.spark)).otherwise(F.col(f"c0_{k}")))
    df = df.observe(seen, F.sum(F.col("hit").cast("long")).alias("n"), F.max(F.when(F.col("hit"), _row_bytes(schema))).alias("bytes"))
    return _commit(table, _named(df, schema), seen)


def delete(table: ManagedTable, where) -> int:
    if not table.entry["dirs"]:
        return 0
    if where is None:
        n = table.count()
        table.commit([])
        return n
    seen = Observation()
    df = _frame(table).withColumn("hit", F.coalesce(predicate(where), F.lit(False)))
    df = df.observe(seen, F.sum(F.col("hit").cast("long")).alias("n")).where(~F.col("hit"))
    return _commit(table, _named(df, table.schema), seen)


def update_row(table: ManagedTable, rid: int, values: tuple) -> None:
    """Replaces one row, by its ordinal."""
    schema = table.schema
    values = schema.check_row(tuple(values))
    table.get(rid)
    df = _frame(table)
    own = F.col(RID) == rid
    for k, v in enumerate(values):
        df = df.withColumn(f"c0_{k}", F.when(own, F.lit(v).cast(schema.columns[k].type.spark)).otherwise(F.col(f"c0_{k}")))
    table.commit([table.write(_named(df, schema))])


def delete_row(table: ManagedTable, rid: int) -> None:
    table.get(rid)
    df, column = table.frame()
    table.commit([table.write(df.where(column != rid))])
