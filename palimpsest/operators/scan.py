"""Scans: filter, project and limit the visible rows of a snapshot."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, islice, pairwise
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.errors import NoSuchField
from palimpsest.functions.predicates import Expr, key_bounds, to_column
from palimpsest.plans.compaction import Ranges, Segment
from palimpsest.plans.resolve import resolve
from palimpsest.schema import COMMIT_TS, TOMBSTONE

if TYPE_CHECKING:
    from palimpsest.operators.table import Snapshot, Table


#: Up to this many rows and bytes of newer files, their keys are broadcast against the settled ones.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


@dataclass(frozen=True)
class Staged:
    """Rows that a transaction has not committed, and how many they are, if that is known."""

    rows: DataFrame
    count: int | None


class Scan:
    """Built up call by call; nothing is read until a result is asked for."""

    def __init__(self, table: Table, snapshot: Snapshot | None = None, overlay: Staged | None = None):
        self._table, self._snapshot, self._overlay = table, snapshot, overlay
        self._predicate: Expr | None = None
        self._columns: list[str] | None = None
        self._limit: int | None = None

    def filter(self, predicate: Expr) -> Scan:
        """Keep rows for which the predicate is true; a later call replaces an earlier one."""
        self._predicate = predicate
        return self

    def projection(self, columns: list[str] | T.StructType) -> Scan:
        self._columns = list(columns.names if isinstance(columns, T.StructType) else columns)
        return self

    def limit(self, n: int) -> Scan:
        """The first ``n`` rows by key, after filtering."""
        self._limit = n
        return self

    def _checked(self) -> tuple[list[str], object]:
        schema = self._table.config.schema
        columns = schema.names if self._columns is None else self._columns
        for c in columns:
            if c not in schema.names:
                raise NoSuchField(c)
        return columns, to_column(self._predicate, schema, filtering=True) if self._predicate is not None else None

    def segments(self) -> list[Segment]:
        """The segments that can hold a row of the result."""
        snapshot = self._snapshot or self._table.begin_snapshot()
        bounds = key_bounds(self._predicate, self._table.config.key[0])
        return [s for s in snapshot.segments if s.rows and s.min_ts <= snapshot.read_ts and bounds.meets(s.min_key, s.max_key)]

    def to_df(self, *, ordered: bool = False) -> DataFrame:
        """The result as a DataFrame; with ``ordered``, or a limit, in ascending key order."""
        columns, condition = self._checked()
        config = self._table.config
        self._snapshot = snapshot = self._snapshot or self._table.begin_snapshot()
        rows = visible(self._table, self.segments(), snapshot.read_ts, self._overlay)
        if condition is not None:
            rows = rows.where(condition)
        if ordered or self._limit is not None:
            rows = rows.orderBy(*config.key)
        if self._limit is not None:
            rows = rows.limit(self._limit)
        return rows.select(*[F.col(f"`{c}`") for c in columns])

    def collect(self) -> list[Row]:
        return self.to_df(ordered=True).collect()

    def stream(self, batch_rows: int = 1024) -> Iterator[list[Row]]:
        """Lists of up to ``batch_rows`` rows in key order, a partition at a time; stop at will."""
        return _batches(self.to_df(ordered=True).toLocalIterator(prefetchPartitions=True), batch_rows)

    def stream_with_profile(self, batch_rows: int = 1024) -> tuple[Iterator[list[Row]], dict[str, int]]:
        """The stream, and nanoseconds of the steps to its first batch.

        ``snapshot`` reads the version log, ``plan`` builds and optimises the query, ``streams`` makes
        its physical plan, ``merge`` runs it up to the first row, ``package`` fills the first batch.
        """
        marks = [time.perf_counter_ns()]

        def mark() -> None:
            marks.append(time.perf_counter_ns())

        self._snapshot = self._snapshot or self._table.begin_snapshot()
        mark()
        df = self.to_df(ordered=True)
        query = df._jdf.queryExecution()
        query.optimizedPlan()
        mark()
        query.executedPlan()
        mark()
        rows = df.toLocalIterator(prefetchPartitions=True)
        head = list(islice(rows, 1))
        mark()
        batches = _batches(chain(head, rows), batch_rows)
        first = list(islice(batches, 1))
        mark()
        names = ("snapshot_ns", "plan_ns", "streams_ns", "merge_ns", "package_ns")
        return chain(first, batches), {n: b - a for n, (a, b) in zip(names, pairwise(marks), strict=True)}

    def explain(self, mode: str = "formatted") -> None:
        self.to_df().explain(mode)


def _batches(rows: Iterator[Row], size: int) -> Iterator[list[Row]]:
    rows = iter(rows)
    while batch := list(islice(rows, size)):
        yield batch


def visible(table: Table, segments: list[Segment], read_ts: int, staged: Staged | None = None) -> DataFrame:
    """The visible rows of these segments, with ``staged`` rows of a transaction over them.

    The files of the deepest level hold one version of each of their keys and are older, key by key,
    than all others. Those that no other file's key range meets are read as they are. The rest lose
    the keys that are in the other files, which are few after a compaction: their keys are broadcast,
    so that only their own rows are shuffled. Footers tell their number beforehand; where they are many,
    all that meet are resolved together, with one shuffle, and still nothing else.
    """
    key = table.config.key
    bottom = max((s.level for s in segments), default=0)
    settled = [s for s in segments if bottom and s.level == bottom and s.max_ts <= read_ts]
    known = {s.id for s in settled}
    recent = [s for s in segments if s.id not in known]
    if not recent and staged is None:
        return table.read(tuple(settled)).where(~F.col(TOMBSTONE))
    log = table.read(tuple(recent))
    past = read_ts if any(s.max_ts > read_ts for s in recent) else None
    if staged is not None:
        if past is not None:
            log, past = log.where(F.col(COMMIT_TS) <= past), None
        log = log.withColumn("_prio", F.lit(1)).unionByName(staged.rows.withColumn("_prio", F.lit(0)))
    priority = "_prio" if staged is not None else None
    touched = Ranges(recent)
    met = [s for s in settled if staged is not None or touched.meet(s)]
    apart = [s for s in settled if staged is None and not touched.meet(s)]
    few = sum(s.rows for s in recent) <= BROADCAST_ROWS and sum(s.bytes for s in recent) <= BROADCAST_BYTES and (staged is None or (staged.count is not None and staged.count <= BROADCAST_ROWS))
    if met and not few:
        below = table.read(tuple(met))
        below = below.withColumn("_prio", F.lit(1)) if staged is not None else below
        newest = resolve(log.unionByName(below), key, past, priority=priority)
    else:
        newest = resolve(log, key, past, keep_tombstones=True, priority=priority)
        if met:
            names = [f"_newer_{i}" for i in range(len(key))]
            keys = newest.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(key, names, strict=True)])
            below = table.read(tuple(met))
            same = reduce(lambda a, b: a & b, [below[f"`{k}`"] == keys[n] for k, n in zip(key, names, strict=True)])
            below = below.join(F.broadcast(keys), same, "left_anti")
            newest = newest.drop("_prio").unionByName(below)
        newest = newest.where(~F.col(TOMBSTONE))
    newest = newest.drop("_prio")
    return newest.unionByName(table.read(tuple(apart)).where(~F.col(TOMBSTONE))) if apart else newest
