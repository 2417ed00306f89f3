"""Error classes, by the stage that raises them."""


class EngineError(Exception):
    """Base of all errors raised here."""


class SQLError(EngineError):
    """Base of errors of the text front end."""


class SQLLexError(SQLError):
    """Characters that form no token."""


class SQLParseError(SQLError):
    """Tokens that form no statement."""


class SQLBindingError(SQLError):
    """A statement whose clauses don't go together."""


class CatalogError(EngineError):
    """Base of catalog errors."""


class TableNotFoundError(CatalogError):
    pass


class TableAlreadyExistsError(CatalogError):
    pass


class ReservedNameError(CatalogError):
    pass


class IndexAlreadyExistsError(CatalogError):
    pass


class IndexNotFoundError(CatalogError):
    pass


class UnsupportedIndexTypeError(CatalogError):
    pass


class CatalogCorruptionError(CatalogError):
    pass


class SchemaError(EngineError):
    """Base of errors of schemas and values."""


class InvalidColumnError(SchemaError):
    pass


class DuplicateColumnError(SchemaError):
    pass


class InvalidSchemaError(SchemaError):
    pass


class ColumnNotFoundError(SchemaError):
    pass


class AmbiguousColumnError(SchemaError):
    pass


class InvalidTypeError(SchemaError):
    pass


class TupleArityError(SchemaError):
    pass


class TupleSizeError(SchemaError):
    pass


class TypeMismatchError(SchemaError):
    pass


class ValueOutOfRangeError(SchemaError):
    pass


class NullConstraintError(SchemaError):
    pass


class SchemaMismatchError(SchemaError):
    pass


class RowNotFoundError(EngineError):
    """No live row has the given row id."""


class ExecutionError(EngineError):
    """A query failed while it ran."""


class StorageClosedError(EngineError):
    """The engine was closed."""


class DatabaseBusyError(EngineError):
    """Another thread held the engine for too long."""


class DatabaseInUseError(EngineError):
    """Another engine has the directory open."""
