"""The engine: a directory of managed tables, registered Parquet, and statements over both."""

from __future__ import annotations

import functools
import threading
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialect.grammar import Create, Delete, Drop, Insert, Select, Update, parse
from .errors import DatabaseBusyError, ExecutionError, StorageClosedError, TableAlreadyExistsError, TableNotFoundError
from .operators import changes
from .plans.bind import Query, Source, bind_delete, bind_select, bind_update, index_test
from .plans.compile import compile_query, predicate, scan
from .sources.catalog import Catalog, ManagedTable
from .sources.external import ExternalTable, FrameTable
from .types import Column, DataType, Schema

WAIT_S = 30


@dataclass(frozen=True)
class ResultColumn:
    name: str
    type: DataType
    nullable: bool
    max_length: int | None = None


@dataclass(frozen=True)
class QueryResult:
    columns: tuple[ResultColumn, ...]
    rows: tuple[tuple, ...]

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns)


@dataclass(frozen=True)
class CommandResult:
    affected_rows: int = 0


@dataclass(frozen=True)
class TableScanMetrics:
    tuples_examined: int


@dataclass(frozen=True)
class IndexScanMetrics:
    tree_pages_visited: int
    leaf_entries_examined: int
    rids_selected: int
    rows_fetched: int


@dataclass(frozen=True)
class Condition:
    column_name: str
    operator: str
    literal: object


@dataclass(frozen=True)
class QueryProfile:
    access_path: str
    table_name: str
    index_name: str | None
    condition: Condition | None
    metrics: TableScanMetrics | IndexScanMetrics


@dataclass(frozen=True)
class ProfiledResult:
    result: QueryResult | CommandResult
    profile: QueryProfile | None


def _held(method):
    """One statement at a time; waits for others for a while."""

    @functools.wraps(method)
    def run(self, *args, **kwargs):
        if not self._lock.acquire(timeout=self.wait_s):
            raise DatabaseBusyError("another statement is running")
        try:
            if self.closed:
                raise StorageClosedError("the engine is closed")
            return method(self, *args, **kwargs)
        finally:
            self._lock.release()

    return run


class Engine:
    def __init__(self, spark: SparkSession, path: str | None = None, wait_s: float = WAIT_S):
        self.spark, self.wait_s = spark, wait_s
        self._lock, self.closed = threading.RLock(), False
        self.catalog = Catalog(spark, path) if path else None
        self.external: dict[str, ExternalTable | FrameTable] = {}

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        with self._lock:
            if not self.closed and self.catalog:
                self.catalog.close()
            self.closed = True

    # tables

    def _own(self) -> Catalog:
        if self.catalog is None:
            raise TableNotFoundError("this engine has no directory for tables of its own")
        return self.catalog

    @_held
    def register_parquet(self, name: str, path: str) -> ExternalTable:
        return self._register(ExternalTable(self.spark, name, path))

    @_held
    def register_frame(self, name: str, df: DataFrame, order: str | None = None) -> FrameTable:
        return self._register(FrameTable(name, df, order))

    def _register(self, table):
        if self._find(table.name):
            raise TableAlreadyExistsError(f"{table.name} exists")
        self.external[table.name.lower()] = table
        return table

    def _find(self, name: str):
        return self.external.get(name.lower()) or (self.catalog.find(name) if self.catalog else None)

    def _source(self, name: str) -> Source:
        table = self._find(name)
        if table is None:
            raise TableNotFoundError(f"there is no table {name}")
        return Source(table.name, table.schema, table)

    @_held
    def create_table(self, name: str, schema: Schema) -> ManagedTable:
        if name.lower() in self.external:
            raise TableAlreadyExistsError(f"{name} exists")
        return self._own().create(name, schema)

    @_held
    def drop_table(self, name: str) -> None:
        self._own().drop(name)

    @_held
    def get_table(self, name: str):
        return self._source(name).table

    @_held
    def has_table(self, name: str) -> bool:
        return self._find(name) is not None

    @_held
    def list_tables(self) -> tuple[str, ...]:
        return (*(self.catalog.names() if self.catalog else ()), *(t.name for t in self.external.values()))

    @_held
    def create_index(self, index: str, table: str, column: str) -> None:
        self._own().create_index(index, table, column)

    @_held
    def status(self) -> dict:
        return {"tables": len(self.list_tables()), "indexes": len(self.catalog.manifest["indexes"]) if self.catalog else 0, "closed": self.closed}

    # statements

    @_held
    def frame(self, sql: str) -> DataFrame:
        """A SELECT as a lazy DataFrame, in no order but that of its ORDER BY."""
        s = parse(sql)
        if not isinstance(s, Select):
            raise ExecutionError("only SELECT gives a DataFrame")
        return compile_query(bind_select(s, self._source))

    @_held
    def execute(self, sql: str) -> QueryResult | CommandResult:
        s = parse(sql)
        if isinstance(s, Select):
            return self._collect(bind_select(s, self._source))
        return CommandResult(self._command(s))

    def _collect(self, query: Query) -> QueryResult:
        columns = tuple(ResultColumn(o.label, o.type, o.nullable, o.max_length) for o in query.outputs)
        try:
            rows = tuple(tuple(r) for r in self._first(query) or compile_query(query, ordered=True).collect())
        except (Py4JJavaError, PySparkException) as e:
            raise ExecutionError(str(e).split("\n", 1)[0]) from e
        return QueryResult(columns, rows)

    def _first(self, query: Query) -> list | None:
        """The rows of a LIMIT in scan order, from the first ordinals of a managed table, 16 times as many at a time; None if all are needed."""
        table = query.sources[0].table
        if not query.limit or query.group is not None or query.order or query.on or not table.managed:
            return None
        below, end = 4 * (query.limit + query.offset) + 1024, table.entry["next_rid"]
        while below < end:
            rows = compile_query(query, ordered=True, below=below).collect()
            if len(rows) == query.limit:
                return rows
            below *= 16
        return None

    def _changeable(self, name: str) -> ManagedTable:
        table = self._source(name).table
        if not table.managed:
            raise ExecutionError(f"{name} is read-only")
        return table

    def _command(self, s) -> int:
        if isinstance(s, Create):
            if s.table.lower() in self.external:
                raise TableAlreadyExistsError(f"{s.table} exists")
            self._own().create(s.table, Schema(tuple(Column(n, k, False, m) for n, k, m in s.columns)))
            return 0
        if isinstance(s, Drop):
            self._own().drop(s.table)
            return 0
        table = self._changeable(s.table)
        source = Source(table.name, table.schema, table)
        if isinstance(s, Insert):
            table.insert(s.values)
            return 1
        if isinstance(s, Update):
            return changes.update(table, *bind_update(s, source))
        assert isinstance(s, Delete)
        return changes.delete(table, bind_delete(s, source))

    @_held
    def execute_profiled(self, sql: str) -> ProfiledResult:
        """A profile comes with a SELECT from one table. Of an index, the pages are the files that held selected
        rows, and the leaf entries those rows."""
        s = parse(sql)
        if not isinstance(s, Select):
            return ProfiledResult(CommandResult(self._command(s)), None)
        query = bind_select(s, self._source)
        result = self._collect(query)
        return ProfiledResult(result, None if query.on else self._profile(query, result))

    def _profile(self, query: Query, result: QueryResult) -> QueryProfile:
        source = query.sources[0]
        df = scan(query, 0)
        hit = index_test(query.where, source.table.indexes)
        if hit:
            df = df.where(predicate(hit[1]))
        selected, files = df.select(F.input_file_name().alias("file")).agg(F.count(F.lit(1)), F.count_distinct("file")).first() if hit else (df.count(), 0)
        consumed = selected
        if query.limit is not None and query.group is None and not query.order:
            consumed = self._consumed(query, df, selected)
        if not hit:
            return QueryProfile("TableScan", source.name, None, None, TableScanMetrics(consumed))
        name, test = hit
        condition = Condition(test.slot.column.name, test.op, test.value)
        return QueryProfile("IndexScan", source.name, name, condition, IndexScanMetrics(files, selected, selected, consumed))

    def _consumed(self, query: Query, df: DataFrame, all_rows: int) -> int:
        """Rows up to the one that fills the limit, in scan order."""
        if query.limit == 0:
            return 0
        n = query.limit + query.offset
        kept = df if query.where is None else df.where(predicate(query.where))
        last = kept.orderBy("r0").select("r0").offset(n - 1).limit(1)
        return df.join(F.broadcast(last.withColumnRenamed("r0", "stop")), F.col("r0") <= F.col("stop")).count() if not last.isEmpty() else all_rows
