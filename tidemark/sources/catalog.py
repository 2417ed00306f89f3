"""Managed tables: immutable Parquet snapshots listed in one manifest.

A statement writes new files, then replaces the manifest by an atomic rename; readers stay with the
version that they began with. Files of past versions stay until vacuum(). The manifest and the
files may be in any Hadoop file system; the guard against a second engine is for local folders.

An index is a copy of the rows sorted by its column, so that a search reads the files and row groups
of its keys alone. It covers the folders of the snapshot that it was made from; what was inserted
since is read beside it, and it is made anew when a folder that it covers is replaced.
"""

from __future__ import annotations

import fcntl
import json
import os
import uuid
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import (
    CatalogCorruptionError,
    DatabaseInUseError,
    EngineError,
    IndexAlreadyExistsError,
    IndexNotFoundError,
    NullConstraintError,
    ReservedNameError,
    RowNotFoundError,
    TableAlreadyExistsError,
    TableNotFoundError,
    TupleSizeError,
    UnsupportedIndexTypeError,
    ValueOutOfRangeError,
)
from ..functions.exprs import compare
from ..types import FIXED_BYTES, MAX_ROW_BYTES, NAME, Column, DataType, Schema

FORMAT, MAX_DIRS, RID = 1, 64, "__rid"
#: Folders below this size are merged when there are more than MAX_DIRS of them, into files of about FILE bytes.
SMALL, FILE = 32 << 20, 128 << 20


class Files:
    """The few file operations that are needed, by Hadoop's API."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)
        self.fs.mkdirs(self.path(""))

    def path(self, rest: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rest}" if rest else self.root)

    def size(self, rest: str) -> int:
        return self.fs.getContentSummary(self.path(rest)).getLength()

    def exists(self, rest: str) -> bool:
        return self.fs.exists(self.path(rest))

    def delete(self, rest: str) -> None:
        self.fs.delete(self.path(rest), True)

    def names(self, rest: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(rest))] if self.exists(rest) else []

    def read(self, rest: str) -> str:
        stream = self.fs.open(self.path(rest))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, rest: str, text: str) -> None:
        """All or nothing: written aside, then renamed over."""
        aside = f".{rest}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(aside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context.rename(self.path(aside).makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()), self.path(rest).makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()), options)


class ManagedTable:
    """A table of the catalog; rows have an ordinal, assigned at insert and never used again."""

    managed = True

    def __init__(self, catalog: Catalog, table_id: int):
        self.catalog, self.id = catalog, table_id

    @property
    def entry(self) -> dict:
        return self.catalog.entry(self.id)

    @property
    def name(self) -> str:
        return self.entry["name"]

    @property
    def schema(self) -> Schema:
        return Schema(tuple(Column(c["name"], DataType(c["type"]), c["nullable"], c["max_length"]) for c in self.entry["columns"]))

    @property
    def indexes(self) -> list[tuple[str, int]]:
        own = sorted((i for i in self.catalog.manifest["indexes"] if i["table"] == self.id), key=lambda i: i["id"])
        return [(i["name"], i["column"]) for i in own]

    def frame(self, rid: bool = True) -> tuple[DataFrame, SparkColumn]:
        """The present snapshot; later statements don't change it."""
        return self._read(self.entry["dirs"]), F.col(RID)

    def _read(self, dirs: list[str]) -> DataFrame:
        struct = T.StructType([*self.schema.struct().fields, T.StructField(RID, T.LongType())])
        paths = [f"{self.catalog.files.root}/{d}" for d in dirs]
        spark = self.catalog.spark
        return spark.read.schema(struct).parquet(*paths) if paths else spark.createDataFrame([], struct)

    def index_frame(self, index: str) -> DataFrame:
        """All rows whose indexed column isn't null, those that the index covers sorted by it."""
        entry = next(i for i in self.catalog.manifest["indexes"] if i["table"] == self.id and i["name"].lower() == index.lower())
        fresh = [d for d in self.entry["dirs"] if d not in entry.get("covers", ())]
        df = self._read([*([entry["copy"]] if entry.get("copy") else ()), *fresh])
        return df.where(F.col(self.schema.columns[entry["column"]].name).isNotNull())

    def _index_copy(self, column: int, dirs: list[str]) -> dict:
        """The rows of the folders, sorted by a column, as an index entry has it."""
        if not dirs:
            return {"copy": None, "covers": []}
        c = self.schema.columns[column].name
        return {"copy": self.write(self._read(dirs).where(F.col(c).isNotNull()).repartitionByRange(c).sortWithinPartitions(c)), "covers": dirs}

    def scan(self) -> list[tuple[int, tuple]]:
        df, rid = self.frame()
        return [(r[RID], tuple(r)[:-1]) for r in df.orderBy(rid).collect()]

    def count(self) -> int:
        return self.frame()[0].count()

    def get(self, rid: int) -> tuple:
        df, column = self.frame()
        row = df.where(column == rid).first()
        if row is None:
            raise RowNotFoundError(f"{self.name} has no row {rid}")
        return tuple(row)[:-1]

    def search(self, index: str, key: object) -> list[int]:
        """Ordinals of the rows whose indexed column equals the key."""
        return self.scan_range(index, key, key)

    def scan_range(self, index: str, lower: object = None, upper: object = None, lower_inclusive: bool = True, upper_inclusive: bool = True) -> list[int]:
        """Ordinals of the rows between bounds, in order; no bound where it is None, NULL keys never."""
        return [r[RID] for r in self.range_frame(index, lower, upper, lower_inclusive, upper_inclusive).select(RID).orderBy(RID).collect()]

    def range_frame(self, index: str, lower: object = None, upper: object = None, lower_inclusive: bool = True, upper_inclusive: bool = True) -> DataFrame:
        ordinal = next((k for n, k in self.indexes if n.lower() == index.lower()), None)
        if ordinal is None:
            raise IndexNotFoundError(f"{self.name} has no index {index}")
        column = self.schema.columns[ordinal]
        c, df = F.col(column.name), self.index_frame(index)
        for bound, op in ((lower, ">=" if lower_inclusive else ">"), (upper, "<=" if upper_inclusive else "<")):
            if bound is not None:
                column.check(bound)
                df = df.where(compare(c, column.type, op, bound))
        return df

    def insert(self, values) -> int:
        return self.insert_many([values])[0]

    def insert_many(self, rows) -> list[int]:
        """All rows or none; their ordinals."""
        schema = self.schema
        rows = [schema.check_row(tuple(r)) for r in rows]
        first = self.entry["next_rid"]
        rids = list(range(first, first + len(rows)))
        if rows:
            struct = T.StructType([*schema.struct().fields, T.StructField(RID, T.LongType())])
            df = self.catalog.spark.createDataFrame([(*r, i) for r, i in zip(rows, rids, strict=True)], struct).coalesce(1)
            self.commit([*self.entry["dirs"], self.write(df)], first + len(rows))
        return rids

    def append(self, df: DataFrame) -> None:
        """Bulk load in one distributed write, which also checks the rows: all of them or none."""
        first, schema = self.entry["next_rid"], self.schema
        columns = [F.col(c.name).cast(c.type.spark).alias(c.name) for c in schema.columns]
        df = df.select(*columns, (F.monotonically_increasing_id() + first).alias(RID))
        bytes_ = F.lit(schema.fixed_bytes())
        faults = {"rows": F.count(F.lit(1)), "top": F.max(RID)}
        for i, c in enumerate(schema.columns):
            v = F.col(c.name)
            if not c.nullable:
                faults[f"null{i}"] = F.count_if(v.isNull())
            if c.max_length is not None:
                faults[f"long{i}"] = F.count_if(F.char_length(v) > c.max_length)
            size = F.lit(FIXED_BYTES[c.type]) if c.type in FIXED_BYTES else F.octet_length(v) + 2
            bytes_ += F.when(v.isNull(), 0).otherwise(size)
        faults["size"] = F.max(bytes_)
        seen = Observation()
        where = self.write(df.observe(seen, *(f.alias(n) for n, f in faults.items())))
        found = seen.get
        try:
            for i, c in enumerate(schema.columns):
                if found.get(f"null{i}"):
                    raise NullConstraintError(f"{c.name} takes no NULL")
                if found.get(f"long{i}"):
                    raise ValueOutOfRangeError(f"{c.name} holds at most {c.max_length} characters")
            if (found["size"] or 0) > MAX_ROW_BYTES:
                raise TupleSizeError(f"a row takes {found['size']} bytes; {MAX_ROW_BYTES} are allowed")
        except EngineError:
            self.catalog.files.delete(where)
            raise
        self.commit([*self.entry["dirs"], where], found["top"] + 1 if found["rows"] else first)

    def write(self, df: DataFrame) -> str:
        where = f"tables/{self.id}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.catalog.files.root}/{where}")
        return where

    def commit(self, dirs: list[str], next_rid: int | None = None) -> None:
        if len(dirs) > MAX_DIRS:  # keep the number of small files down; large ones stay as they are
            size = {d: self.catalog.files.size(d) for d in dirs}
            small = [d for d in dirs if size[d] < SMALL]
            if len(small) > MAX_DIRS // 2:
                merged = self._read(small).coalesce(1 + sum(size[d] for d in small) // FILE)
                dirs = [*(d for d in dirs if size[d] >= SMALL), self.write(merged)]
        own = [i for i in self.catalog.manifest["indexes"] if i["table"] == self.id]
        stale = {i["id"]: self._index_copy(i["column"], dirs) for i in own if not set(i.get("covers", ())) <= set(dirs)}

        def edit(m):
            m["tables"][str(self.id)].update(dirs=dirs, **({} if next_rid is None else {"next_rid": next_rid}))
            for i in m["indexes"]:
                i.update(stale.get(i["id"], {}))

        self.catalog.change(edit)


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.lease = None
        local = urlparse(path).scheme in ("", "file")
        if local:
            folder = urlparse(path).path
            os.makedirs(folder, exist_ok=True)
            self.lease = open(os.path.join(folder, ".lock"), "w")  # noqa: SIM115  held while open
            try:
                fcntl.flock(self.lease, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                self.lease.close()
                raise DatabaseInUseError(f"{path} is open elsewhere") from e
            path = f"file:{os.path.abspath(folder)}"
        self.files = Files(spark, path)
        try:
            self.manifest = self._load()
        except EngineError:
            self.close()
            raise

    def close(self) -> None:
        if self.lease:
            self.lease.close()

    def _load(self) -> dict:
        if not self.files.exists("catalog.json"):
            return {"format": FORMAT, "next_id": 1, "tables": {}, "indexes": []}
        try:
            m = json.loads(self.files.read("catalog.json"))
            if m["format"] != FORMAT:
                raise CatalogCorruptionError(f"format {m['format']} is unknown")
            names: set[str] = set()
            for key, t in m["tables"].items():
                Schema(tuple(Column(c["name"], DataType(c["type"]), c["nullable"], c["max_length"]) for c in t["columns"]))
                if not NAME.fullmatch(t["name"]) or t["name"].lower() in names or not 0 < int(key) < m["next_id"] or t["next_rid"] < 0:
                    raise CatalogCorruptionError(f"the entry of table {t['name']} is wrong")
                names.add(t["name"].lower())
                for d in t["dirs"]:
                    if not self.files.exists(d):
                        raise CatalogCorruptionError(f"files of {t['name']} are missing: {d}")
            ids = [i["id"] for i in m["indexes"]]
            labels = [i["name"].lower() for i in m["indexes"]]
            if len(set(ids)) < len(ids) or len(set(labels)) < len(labels) or any(str(i["table"]) not in m["tables"] or not 0 <= i["column"] < len(m["tables"][str(i["table"])]["columns"]) or not 0 < i["id"] < m["next_id"] for i in m["indexes"]):
                raise CatalogCorruptionError("the entry of an index is wrong")
            return m
        except CatalogCorruptionError:
            raise
        except (ValueError, KeyError, TypeError, AttributeError, EngineError, Py4JJavaError) as e:
            raise CatalogCorruptionError(f"the manifest can't be read: {e}") from e

    def change(self, edit) -> None:
        """Applies an edit to a copy of the manifest and commits it."""
        m = json.loads(json.dumps(self.manifest))
        edit(m)
        self.files.replace("catalog.json", json.dumps(m, indent=1))
        self.manifest = m

    def entry(self, table_id: int) -> dict:
        try:
            return self.manifest["tables"][str(table_id)]
        except KeyError as e:
            raise TableNotFoundError("the table was dropped") from e

    def names(self) -> list[str]:
        return [t["name"] for _, t in sorted(self.manifest["tables"].items(), key=lambda kv: int(kv[0]))]

    def find(self, name: str) -> ManagedTable | None:
        for key, t in self.manifest["tables"].items():
            if t["name"].lower() == name.lower():
                return ManagedTable(self, int(key))
        return None

    def get(self, name: str) -> ManagedTable:
        table = self.find(name)
        if table is None:
            raise TableNotFoundError(f"there is no table {name}")
        return table

    def create(self, name: str, schema: Schema) -> ManagedTable:
        if not isinstance(name, str) or not NAME.fullmatch(name):
            raise ReservedNameError(f"{name!r} is no table name")
        if name.startswith("_"):
            raise ReservedNameError("names that begin with _ are reserved")
        if self.find(name):
            raise TableAlreadyExistsError(f"{name} exists")
        table_id = self.manifest["next_id"]
        columns = [{"name": c.name, "type": c.type.value, "nullable": c.nullable, "max_length": c.max_length} for c in schema.columns]

        def edit(m):
            m["next_id"] += 1
            m["tables"][str(table_id)] = {"name": name, "columns": columns, "dirs": [], "next_rid": 0}

        self.change(edit)
        return ManagedTable(self, table_id)

    def drop(self, name: str) -> None:
        table = self.get(name)

        def edit(m):
            del m["tables"][str(table.id)]
            m["indexes"] = [i for i in m["indexes"] if i["table"] != table.id]

        self.change(edit)
        self.files.delete(f"tables/{table.id}")

    def create_index(self, index: str, name: str, column: str) -> None:
        """A copy of the rows, sorted by the column."""
        table = self.get(name)
        if not NAME.fullmatch(index) or index.startswith("_"):
            raise ReservedNameError(f"{index!r} is no index name")
        if any(i["name"].lower() == index.lower() for i in self.manifest["indexes"]):
            raise IndexAlreadyExistsError(f"{index} exists")
        ordinal = table.schema.index(column)
        if table.schema.columns[ordinal].type is DataType.FLOAT:
            raise UnsupportedIndexTypeError("a FLOAT column takes no index")

        copy = table._index_copy(ordinal, table.entry["dirs"])

        def edit(m):
            m["indexes"].append({"id": m["next_id"], "name": index, "table": table.id, "column": ordinal, **copy})
            m["next_id"] += 1

        self.change(edit)

    def vacuum(self) -> int:
        """Deletes files that the present manifest doesn't list; the number of folders."""
        gone = 0
        for key in self.files.names("tables"):
            live = {d.rsplit("/", 1)[1] for d in self.manifest["tables"].get(key, {}).get("dirs", ())}
            live |= {i["copy"].rsplit("/", 1)[1] for i in self.manifest["indexes"] if str(i["table"]) == key and i.get("copy")}
            for d in self.files.names(f"tables/{key}"):
                if d not in live:
                    self.files.delete(f"tables/{key}/{d}")
                    gone += 1
        return gone
