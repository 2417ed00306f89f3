"""Parquet files as read-only tables. Timestamps are epoch milliseconds (BIGINT); nested columns are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import Schema


class ExternalTable:
    managed = False

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path
        self.raw = spark.read.parquet(path).schema
        self.schema = Schema.of_spark(self.raw)
        self.indexes: list[tuple[str, int]] = []

    def frame(self, rid: bool = True) -> tuple[DataFrame, Column]:
        """Rows and their ordinal; without it the scan needn't count rows."""
        df = self.spark.read.schema(self.raw).parquet(self.path)
        place = [F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("__rid")] if rid else []
        kinds = {f.name: type(f.dataType) for f in self.raw}
        out = []
        for c in self.schema.columns:
            col = F.col(c.name)
            if kinds[c.name] in (T.TimestampType, T.TimestampNTZType):
                col = F.unix_millis(col.cast("timestamp"))
            elif kinds[c.name] is T.FloatType:
                col = col.cast("double")
            out.append(col.alias(c.name))
        return df.select(*out, *place), F.col("__rid")


class FrameTable:
    """Any DataFrame as a table, in the order of an expression if one is given."""

    managed = False

    def __init__(self, name: str, frame: DataFrame, order: str | None = None):
        self.name, self._frame = name, frame
        self.schema = Schema.of_spark(frame.schema)
        self.order = order or self.schema.columns[0].name
        self.indexes: list[tuple[str, int]] = []

    def frame(self, rid: bool = True) -> tuple[DataFrame, Column]:
        return self._frame.select(*self.schema.names, F.expr(self.order).alias("__rid")), F.col("__rid")
