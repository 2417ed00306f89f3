"""Five column types, schemas, and the checks of values against them."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

from .errors import (
    ColumnNotFoundError,
    DuplicateColumnError,
    InvalidColumnError,
    InvalidSchemaError,
    InvalidTypeError,
    NullConstraintError,
    TupleArityError,
    TupleSizeError,
    TypeMismatchError,
    ValueOutOfRangeError,
)

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}")
MAX_COLUMNS, MAX_CHARS, MAX_ROW_BYTES = 256, 4080, 4084


class DataType(Enum):
    INTEGER = "INTEGER"
    BIGINT = "BIGINT"
    FLOAT = "FLOAT"
    BOOLEAN = "BOOLEAN"
    VARCHAR = "VARCHAR"

    @property
    def spark(self) -> T.DataType:
        return SPARK[self]

    @property
    def bounds(self) -> tuple[int, int] | None:
        return RANGE.get(self)


SPARK = {DataType.INTEGER: T.IntegerType(), DataType.BIGINT: T.LongType(), DataType.FLOAT: T.DoubleType(), DataType.BOOLEAN: T.BooleanType(), DataType.VARCHAR: T.StringType()}
RANGE = {DataType.INTEGER: (-(2**31), 2**31 - 1), DataType.BIGINT: (-(2**63), 2**63 - 1)}
PYTHON = {DataType.INTEGER: int, DataType.BIGINT: int, DataType.FLOAT: float, DataType.BOOLEAN: bool, DataType.VARCHAR: str}
FIXED_BYTES = {DataType.INTEGER: 4, DataType.BIGINT: 8, DataType.FLOAT: 8, DataType.BOOLEAN: 1}


@dataclass(frozen=True)
class Column:
    name: str
    type: DataType
    nullable: bool = False
    max_length: int | None = None
    bounded: bool = True  # external tables hold strings of any length

    def __post_init__(self):
        if not isinstance(self.name, str) or not NAME.fullmatch(self.name):
            raise InvalidColumnError(f"{self.name!r} is no column name")
        if not isinstance(self.type, DataType):
            raise InvalidTypeError(f"{self.type!r} is no column type")
        if self.type is DataType.VARCHAR and self.bounded:
            if type(self.max_length) is not int or not 1 <= self.max_length <= MAX_CHARS:
                raise InvalidColumnError(f"{self.name} needs a length from 1 to {MAX_CHARS}")
        elif self.max_length is not None:
            raise InvalidColumnError(f"{self.name} takes no length")

    def check(self, value: object) -> None:
        """Raises unless the column may hold the value."""
        if value is None:
            if not self.nullable:
                raise NullConstraintError(f"{self.name} takes no NULL")
            return
        if type(value) is not PYTHON[self.type]:
            raise TypeMismatchError(f"{self.name} is {self.type.value}; {value!r} isn't")
        if (limits := self.type.bounds) and not limits[0] <= value <= limits[1]:
            raise ValueOutOfRangeError(f"{value} is out of range for {self.name}")
        if self.max_length is not None and len(value) > self.max_length:
            raise ValueOutOfRangeError(f"{self.name} holds at most {self.max_length} characters")


@dataclass(frozen=True)
class Schema:
    columns: tuple[Column, ...]

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(self.columns))
        if not 1 <= len(self.columns) <= MAX_COLUMNS:
            raise InvalidSchemaError(f"a table has 1 to {MAX_COLUMNS} columns")
        seen: set[str] = set()
        for c in self.columns:
            if c.name.lower() in seen:
                raise DuplicateColumnError(f"{c.name} stands twice")
            seen.add(c.name.lower())

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns)

    def index(self, name: str) -> int:
        for i, c in enumerate(self.columns):
            if c.name.lower() == name.lower():
                return i
        raise ColumnNotFoundError(f"there is no column {name}")

    def column(self, name: str) -> Column:
        return self.columns[self.index(name)]

    @property
    def fingerprint(self) -> int:
        return zlib.crc32("|".join(f"{i}:{c.name.lower()}:{c.type.value}:{int(c.nullable)}:{c.max_length or 0}" for i, c in enumerate(self.columns)).encode())

    def struct(self) -> T.StructType:
        """Nullable throughout, as files are read; what columns promise stands here."""
        return T.StructType([T.StructField(c.name, c.type.spark, True, {"max_length": c.max_length} if c.max_length else {}) for c in self.columns])

    def fixed_bytes(self) -> int:
        """The row's size but for values: count, fingerprint, bitmap."""
        return 6 + (len(self.columns) + 7) // 8

    def check_row(self, values: tuple) -> tuple:
        if len(values) != len(self.columns):
            raise TupleArityError(f"{len(values)} values for {len(self.columns)} columns")
        size = self.fixed_bytes()
        for c, v in zip(self.columns, values, strict=True):
            c.check(v)
            if v is not None:
                size += FIXED_BYTES[c.type] if c.type in FIXED_BYTES else 2 + len(v.encode())
        if size > MAX_ROW_BYTES:
            raise TupleSizeError(f"the row takes {size} bytes; {MAX_ROW_BYTES} are allowed")
        return tuple(values)

    @classmethod
    def of_spark(cls, struct: T.StructType) -> Schema:
        """The exposable columns of a file's schema; others are left out."""
        back = {type(v): k for k, v in SPARK.items()} | {T.FloatType: DataType.FLOAT, T.TimestampType: DataType.BIGINT, T.TimestampNTZType: DataType.BIGINT}
        return cls(tuple(Column(f.name, back[type(f.dataType)], True, None, bounded=False) for f in struct if type(f.dataType) in back))
