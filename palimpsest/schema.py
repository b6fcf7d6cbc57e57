"""Table schemas: key declaration, validation and fingerprints."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import types as T

from palimpsest.errors import SchemaError

#: System columns of every stored row.
COMMIT_TS, TOMBSTONE, SEQUENCE = "_commit_ts", "_tombstone", "_seq"
SYSTEM = (COMMIT_TS, TOMBSTONE, SEQUENCE)

KEY_TYPES = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BinaryType, T.DecimalType, T.DateType, T.TimestampType)


@dataclass(frozen=True)
class TableConfig:
    schema: T.StructType
    key: tuple[str, ...]

    @property
    def values(self) -> list[str]:
        return [f.name for f in self.schema if f.name not in self.key]

    @property
    def stored(self) -> T.StructType:
        """The schema of data files: values are nullable there, as tombstones have none."""
        fields = [T.StructField(f.name, f.dataType, True) for f in self.schema]
        return T.StructType([*fields, T.StructField(COMMIT_TS, T.LongType()), T.StructField(SEQUENCE, T.LongType()), T.StructField(TOMBSTONE, T.BooleanType())])

    @property
    def deletes(self) -> T.StructType:
        """The schema of a delete: the key and its commit timestamp."""
        return T.StructType([*[self.schema[k] for k in self.key], T.StructField(COMMIT_TS, T.LongType(), False)])

    @property
    def fingerprint(self) -> str:
        """Equal for equal definitions: names, types, nullability and key."""
        said = json.dumps({"fields": [[f.name, f.dataType.jsonValue(), f.nullable] for f in self.schema], "key": self.key}, sort_keys=True)
        return hashlib.sha256(said.encode()).hexdigest()

    def to_json(self) -> dict:
        return {"schema": self.schema.jsonValue(), "key": list(self.key), "fingerprint": self.fingerprint}

    @classmethod
    def from_json(cls, said: dict) -> TableConfig:
        return cls(T.StructType.fromJson(said["schema"]), tuple(said["key"]))

    def check(self, schema: T.StructType) -> None:
        """Rows must have the table's columns, in order, with its types."""
        have, want = ([(f.name, f.dataType.simpleString()) for f in s] for s in (schema, self.schema))
        if have != want:
            raise SchemaError(f"rows have {have}; the table has {want}")


def declare(schema: T.StructType, *, key: str | list[str] | None = None, indices: list[int] | None = None, metadata: dict | None = None, field_property: str = "palimpsest.key", schema_property: str = "palimpsest.keys") -> TableConfig:
    """A table's configuration, its key given by name, by column index or by metadata.

    A field's metadata may hold ``field_property``: true or "yes" for a key of one column, or its
    ordinal in a longer one. ``metadata`` is that of the schema: ``schema_property`` there is a name or
    a list of names, also as JSON text. Field metadata come first.
    """
    if indices is not None:
        if any(not 0 <= i < len(schema) for i in indices):
            raise SchemaError(f"no column has one of the indices {indices}")
        key = [schema[i].name for i in indices]
    if key is None:
        key = _marked(schema, field_property) or _listed((metadata or {}).get(schema_property))
    names = [key] if isinstance(key, str) else list(key or [])
    if not names:
        raise SchemaError("no key is declared")
    if len(set(names)) < len(names):
        raise SchemaError(f"a key column is named twice: {names}")
    known = {f.name: f for f in schema}
    if len({f.name.lower() for f in schema}) < len(schema.fields):
        raise SchemaError("two columns have the same name")
    for name in names:
        if name not in known:
            raise SchemaError(f"the key column {name} is not in the schema")
        if not isinstance(known[name].dataType, KEY_TYPES):
            raise SchemaError(f"{known[name].dataType.simpleString()} cannot be a key: {name}")
    if reserved := [f.name for f in schema if f.name.lower() in SYSTEM]:
        raise SchemaError(f"these names are reserved: {reserved}")
    fields = [T.StructField(f.name, f.dataType, f.nullable and f.name not in names, f.metadata) for f in schema]
    return TableConfig(T.StructType(fields), tuple(names))


def _marked(schema: T.StructType, prop: str) -> list[str]:
    marks: dict[str, int | None] = {}
    for f in schema:
        value = (f.metadata or {}).get(prop)
        if value is None or value is False:
            continue
        text = str(value).strip().lower()
        if text in ("true", "yes"):
            marks[f.name] = None
        elif text.isdigit():
            marks[f.name] = int(text)
        else:
            raise SchemaError(f"{prop} of {f.name} is neither true nor an ordinal: {value}")
    if len(marks) > 1 and None in marks.values():
        raise SchemaError("several key columns need ordinals")
    if len(set(marks.values())) < len(marks):
        raise SchemaError("two key columns have the same ordinal")
    return sorted(marks, key=lambda n: marks[n] or 0)


def _listed(value) -> list[str]:
    if value is None:
        return []
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            pass
    return [value] if isinstance(value, str) else [str(v) for v in value]


class SchemaBuilder:
    """Builds a schema column by column."""

    def __init__(self):
        self._fields: list[T.StructField] = []
        self._key: list[str] = []
        self._metadata: dict = {}

    def column(self, name: str, kind: T.DataType | str, nullable: bool = True) -> SchemaBuilder:
        self._fields.append(T.StructField(name, T._parse_datatype_string(kind) if isinstance(kind, str) else kind, nullable))
        return self

    def primary_key(self, name: str) -> SchemaBuilder:
        self._key = [name]
        return self

    def composite_key(self, *names: str) -> SchemaBuilder:
        self._key = list(names)
        return self

    def add_key_part(self, name: str) -> SchemaBuilder:
        self._key.append(name)
        return self

    def with_metadata(self, metadata: dict) -> SchemaBuilder:
        self._metadata |= metadata
        return self

    def build(self) -> TableConfig:
        return declare(T.StructType(self._fields), key=self._key or None, metadata=self._metadata)
