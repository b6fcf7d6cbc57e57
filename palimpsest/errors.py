"""Errors that callers can catch."""


class TableError(Exception):
    """Base of all errors of this package."""


class SchemaError(TableError):
    """A schema or key declaration that a table cannot have, or rows that do not fit the table's."""


class NoSuchField(TableError):
    """A predicate or projection names a column that the table lacks."""


class UnsupportedPredicate(TableError):
    """A predicate that cannot be evaluated on the column's type, or not at all."""


class NullKey(TableError):
    """A row without a value in a key column."""


class WriteConflict(TableError):
    """Another commit wrote a key of this transaction after its snapshot."""


class CommitConflict(TableError):
    """Other commits kept coming first."""


class SnapshotExpired(TableError):
    """The versions that a snapshot needs have been compacted or vacuumed away."""
