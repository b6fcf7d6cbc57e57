"""Optimistic transactions: snapshot reads, staged writes, first committer wins."""

from __future__ import annotations

from collections.abc import Iterable
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.errors import NullKey, SchemaError, SnapshotExpired, TableError, WriteConflict
from palimpsest.functions.predicates import Expr
from palimpsest.operators.scan import Scan, Staged
from palimpsest.schema import COMMIT_TS, SEQUENCE, TOMBSTONE

if TYPE_CHECKING:
    from palimpsest.operators.table import Snapshot, Table
    from palimpsest.sources.log import Version


class Transaction:
    """Writes are staged until ``commit``; of writes to one key the last counts."""

    durability = "durable"
    is_durable = True

    def __init__(self, table: Table, snapshot: Snapshot):
        self._table, self.snapshot = table, snapshot
        self._staged: list[DataFrame | list[tuple]] = []
        self._done = False

    def _open(self) -> None:
        if self._done:
            raise TableError("the transaction has ended")

    def _rows(self) -> list[tuple]:
        if not self._staged or not isinstance(self._staged[-1], list):
            self._staged.append([])
        return self._staged[-1]

    def upsert(self, row: dict | Iterable[Any]) -> None:
        self._open()
        names = self._table.config.schema.names
        if isinstance(row, dict):
            if extra := set(row) - set(names):
                raise SchemaError(f"no such columns: {sorted(extra)}")
            row = [row.get(n) for n in names]
        row = tuple(row)
        if len(row) != len(names):
            raise SchemaError(f"{len(row)} values for {len(names)} columns")
        if any(row[names.index(k)] is None for k in self._table.config.key):
            raise NullKey(str(row))
        self._rows().append((*row, False))

    def upsert_rows(self, rows: Iterable) -> None:
        for row in rows:
            self.upsert(row)

    def upsert_batch(self, df: DataFrame) -> None:
        self._open()
        self._table.config.check(df.schema)
        self._staged.append(df.select("*", F.lit(False).alias(TOMBSTONE)))

    def delete(self, *key: Any) -> None:
        self._open()
        names, parts = self._table.config.schema.names, self._table.config.key
        if len(key) != len(parts):
            raise SchemaError(f"{len(key)} values for a key of {len(parts)}")
        if None in key:
            raise NullKey(str(key))
        given = dict(zip(parts, key, strict=True))
        self._rows().append((*[given.get(n) for n in names], True))

    def staged(self) -> DataFrame | None:
        """The last write to each key, as log rows of the snapshot's timestamp."""
        config, parts = self._table.config, []
        kind = T.StructType([*[T.StructField(f.name, f.dataType) for f in config.schema], T.StructField(TOMBSTONE, T.BooleanType())])
        for i, part in enumerate(p for p in self._staged if not isinstance(p, list) or p):
            if isinstance(part, list):
                numbered = T.StructType([*kind, T.StructField("_at", T.LongType())])
                df = self._table.spark.createDataFrame([(*r, n) for n, r in enumerate(part)], numbered)
            else:
                df = part.withColumn("_at", F.monotonically_increasing_id())
            parts.append(df.withColumn("_part", F.lit(i)))
        if not parts:
            return None
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        last = Window.partitionBy(*config.key).orderBy(F.col("_part").desc(), F.col("_at").desc())
        rows = every.withColumn("_rn", F.row_number().over(last)).where("_rn = 1")
        return rows.select(*config.schema.names, F.lit(self.snapshot.read_ts).cast("long").alias(COMMIT_TS), F.lit(0).cast("long").alias(SEQUENCE), TOMBSTONE)

    def scan(self) -> Scan:
        """Reads the snapshot with the staged writes over it."""
        self._open()
        rows = self.staged()
        known = sum(map(len, self._staged)) if all(isinstance(p, list) for p in self._staged) else None
        return Scan(self._table, self.snapshot, Staged(rows, known) if rows is not None else None)

    def get(self, *key: Any) -> dict | None:
        rows = self.scan().filter(Expr.and_(*[Expr.eq(k, v) for k, v in zip(self._table.config.key, key, strict=True)])).to_df().collect()
        return rows[0].asDict(recursive=True) if rows else None

    def is_empty(self) -> bool:
        return not any(not isinstance(p, list) or p for p in self._staged)

    def __len__(self) -> int:
        staged = self.staged()
        return staged.count() if staged is not None else 0

    def commit(self) -> int | None:
        """Publish the staged writes in one commit, unless another one wrote a key of them since the snapshot."""
        self._open()
        self._done = True
        staged = self.staged()
        if staged is None:
            return None
        keys = list(self._table.config.key)

        def check(head: Version) -> None:
            """What was committed since, as each commit wrote it: merges may have dropped its deletes."""
            versions = self._table.log.since(self.snapshot.version)
            if versions is None:
                raise SnapshotExpired("the commits since the snapshot have been vacuumed away")
            seen, later = {s.id for s in self.snapshot.segments}, []
            for v in versions:
                later += [s for s in v.segments if v.kind == "commit" and s.id not in seen]
                seen |= {s.id for s in v.segments}
            if later:
                written = self._table.read(tuple(later)).where(F.col(COMMIT_TS) > self.snapshot.read_ts)
                if clash := written.join(staged.select(*keys), keys, "left_semi").select(*keys).first():
                    raise WriteConflict(str(tuple(clash)))

        return self._table.commit(staged.drop(COMMIT_TS), check)

    def abort(self) -> None:
        self._done = True
        self._staged = []
