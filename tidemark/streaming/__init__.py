"""SELECT over a stream of Parquet files: projection and filter, or grouped aggregates as running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dialect.grammar import parse
from ..errors import SQLBindingError
from ..plans.bind import Source, bind_select
from ..plans.compile import compile_query
from ..types import Schema


class StreamTable:
    managed = False
    indexes: list[tuple[str, int]] = []

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.name, self.path, self.spark = name, path, spark
        self.raw = spark.read.parquet(path).schema
        self.schema = Schema.of_spark(self.raw)

    def frame(self, rid: bool = True) -> tuple[DataFrame, Column]:
        return self.spark.readStream.schema(self.raw).parquet(self.path).select(*self.schema.names), F.lit(0)


def stream(table: StreamTable, sql: str) -> DataFrame:
    """A streaming DataFrame; start it with writeStream (append for rows, complete for groups)."""

    def find(name: str) -> Source:
        if name.lower() != table.name.lower():
            raise SQLBindingError(f"only {table.name} is streamed")
        return Source(table.name, table.schema, table)

    query = bind_select(parse(sql), find)
    if query.order or query.limit is not None:
        raise SQLBindingError("a stream has no end to sort or cut at")
    return compile_query(query)
