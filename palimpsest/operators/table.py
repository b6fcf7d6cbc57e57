"""Versioned tables: create, open, ingest, snapshots, time travel and maintenance."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.errors import CommitConflict, NullKey, SchemaError, SnapshotExpired
from palimpsest.operators.scan import Scan
from palimpsest.operators.transaction import Transaction
from palimpsest.operators.worker import CompactionWorker
from palimpsest.plans.compaction import FlushPolicy, Leveled, Pending, Plan, Ranges, Segment
from palimpsest.plans.resolve import resolve
from palimpsest.schema import COMMIT_TS, SEQUENCE, TOMBSTONE, TableConfig
from palimpsest.sources.log import Version, VersionLog
from palimpsest.sources.storage import HadoopStore, ObjectStore, Storage, scratch

log = logging.getLogger("palimpsest")

_ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DoubleType)


@dataclass(frozen=True)
class Snapshot:
    """A timestamp and the complete list of segments to read it from."""

    read_ts: int
    version: int
    segments: tuple[Segment, ...]

    def scan(self, table: Table) -> Scan:
        return table.scan(self)


@dataclass(frozen=True)
class Backpressure:
    """How much may wait at level 0 before commits are held up: first a pause, then until a merge has made room."""

    slowdown_files: int = 16
    stall_files: int = 32
    slowdown_bytes: int | None = None
    stall_bytes: int | None = None
    slowdown_s: float = 0.025
    stall_s: float = 0.2

    def asks(self, segments: tuple[Segment, ...]) -> str:
        """``"go"``, ``"slow"`` or ``"stall"``."""
        waiting = [s.bytes for s in segments if s.level == 0]
        for word, files, size in (("stall", self.stall_files, self.stall_bytes), ("slow", self.slowdown_files, self.slowdown_bytes)):
            if len(waiting) >= files or (size is not None and sum(waiting) >= size):
                return word
        return "go"


Root = str | ObjectStore | HadoopStore


class Table:
    """One keyed table below one folder. Handles are light; any number may be open at once."""

    def __init__(self, spark: SparkSession, storage: Storage, config: TableConfig, properties: dict):
        self.spark, self.storage, self.config, self.properties = spark, storage, config, properties
        self.log = VersionLog(storage)
        self.strategy = Leveled()
        self.backpressure: Backpressure | None = None
        self.flush_policy: FlushPolicy | None = None
        self.pending = Pending()
        self.worker: CompactionWorker | None = None
        self.metrics = {"commits": 0, "conflicts": 0, "compactions": 0, "last_compaction": None}

    # Opening.

    @classmethod
    def create(cls, spark: SparkSession, root: Root, config: TableConfig, *, name: str = "default", max_versions: int = 5, max_ttl_s: float = 12 * 3600, properties: dict | None = None) -> Table:
        """A new table at ``root``; ``properties`` are kept with it and have no effect."""
        storage = Storage(spark, root if isinstance(root, str) else root.configure(spark))
        said = {"name": name, "max_versions": max_versions, "max_ttl_s": max_ttl_s, **(properties or {})}
        if not storage.create("_table.json", json.dumps({**config.to_json(), "properties": said})):
            raise SchemaError(f"there is a table at {storage.root}")
        return cls(spark, storage, config, said)

    @classmethod
    def open(cls, spark: SparkSession, root: Root, config: TableConfig | None = None) -> Table:
        """The table at ``root``, which must have ``config`` if that is given."""
        storage = Storage(spark, root if isinstance(root, str) else root.configure(spark))
        if not storage.exists("_table.json"):
            raise SchemaError(f"there is no table at {storage.root}")
        said = json.loads(storage.read("_table.json"))
        if config and config.fingerprint != said["fingerprint"]:
            raise SchemaError("the table has another definition")
        return cls(spark, storage, TableConfig.from_json(said), said["properties"])

    @classmethod
    def open_or_create(cls, spark: SparkSession, root: Root, config: TableConfig, **more) -> Table:
        """The table at ``root``, which must have ``config``; a new one if there is none."""
        storage = Storage(spark, root if isinstance(root, str) else root.configure(spark))
        if not storage.exists("_table.json"):
            try:
                return cls.create(spark, root, config, **more)
            except SchemaError:
                if not storage.exists("_table.json"):  # otherwise another writer has just made it
                    raise
        return cls.open(spark, root, config)

    @classmethod
    def in_memory(cls, spark: SparkSession, config: TableConfig, label: str = "memory", **more) -> Table:
        """A table in a new scratch folder, to be dropped with ``drop``."""
        return cls.create(spark, scratch(spark, label), config, **more)

    def drop(self) -> None:
        self.stop_worker()
        self.storage.delete()

    def start_worker(self, period_s: float = 1.0, **more) -> CompactionWorker:
        """Merge in a thread of this process from now on, every ``period_s`` seconds and after each commit."""
        self.stop_worker()
        self.worker = CompactionWorker(self, period_s, **more)
        self.worker.start()
        return self.worker

    def stop_worker(self) -> None:
        if self.worker:
            self.worker.stop()
            self.worker = None

    # Writing.

    def ingest(self, df: DataFrame) -> int:
        """Upsert all rows in one commit and return its timestamp. Of rows with one key the last wins."""
        return self.ingest_with_tombstones(df, F.lit(False))

    def ingest_with_tombstones(self, df: DataFrame, tombstone: Column | str) -> int:
        """One commit of upserts and, where ``tombstone`` holds, deletes, which win over upserts of their key."""
        self.config.check(T.StructType([f for f in df.schema if f.name != tombstone] if isinstance(tombstone, str) else df.schema))
        self._hold_up()
        gone = F.coalesce(F.col(tombstone) if isinstance(tombstone, str) else tombstone, F.lit(False))
        rows = df.select("*", gone.alias(TOMBSTONE), F.monotonically_increasing_id().alias(SEQUENCE))
        return self.commit(rows)

    def delete(self, keys: DataFrame) -> int:
        """Delete the keys in one commit."""
        return self.ingest_with_tombstones(self._full(keys), F.lit(True))

    def _full(self, keys: DataFrame) -> DataFrame:
        return keys.select(*[F.col(f.name) if f.name in self.config.key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.config.schema])

    def _hold_up(self) -> None:
        """Let merges catch up if too much waits at level 0; without a worker, merge right here."""
        limit, began = self.backpressure, time.time()
        if not limit:
            return
        while (word := limit.asks(self.log.head().segments)) == "stall":
            if not (self.worker and self.worker.is_alive()):
                if not self.compact():
                    return  # nothing can be merged: waiting would not end
                continue
            self.worker.kick()
            time.sleep(limit.stall_s)
        if word == "slow":
            time.sleep(limit.slowdown_s)
        if word != "go" or time.time() - began > limit.stall_s:
            log.info("commit held up for %.3f s", time.time() - began)

    def commit(self, rows: DataFrame, check: Callable[[Version], None] | None = None, attempts: int = 10) -> int:
        """Write ``rows`` (with tombstone and sequence) as segments and publish them; ``check`` sees each head before."""
        values = [F.when(F.col(TOMBSTONE), F.lit(None)).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name not in self.config.key else F.col(f.name) for f in self.config.schema]
        head, number = self.log.tip()
        if check:
            check(head)
        ts = head.max_commit_ts + 1
        made = self._write(rows.select(*values, F.lit(ts).cast("long").alias(COMMIT_TS), SEQUENCE, TOMBSTONE), 0)
        for attempt in range(attempts):
            if self.log.append(Version(number, ts, time.time(), (*head.segments, *made))):
                self.metrics["commits"] += 1
                size, n = sum(s.bytes for s in made), sum(s.rows for s in made)
                self.pending = Pending(self.pending.bytes + size, self.pending.rows + n, self.pending.batches + 1, self.pending.since)
                log.info("commit ts=%d rows=%d bytes=%d", ts, n, size)
                if self.worker:
                    self.worker.kick()
                elif self.flush_policy and self.flush_policy.due(self.pending):
                    self.pending = Pending()
                    self.compact()
                return ts
            self.metrics["conflicts"] += 1
            time.sleep(min(1.0, 0.01 * 2**attempt))
            head, number = self.log.tip()
            if check:
                try:
                    check(head)
                except Exception:
                    self._remove(made)
                    raise
            if head.max_commit_ts >= ts:  # the rows carry their timestamp, and another commit has it now
                old, ts = made, head.max_commit_ts + 1
                made = self._write(self.read(old).withColumn(COMMIT_TS, F.lit(ts).cast("long")), 0)
                self._remove(old)
        self._remove(made)
        raise CommitConflict(f"{attempts} commits came first")

    def _write(self, rows: DataFrame, level: int, partitions: int | None = None) -> tuple[Segment, ...]:
        """Write a folder of files, each a segment; with ``partitions``, that many disjoint key ranges."""
        key, first = list(self.config.key), self.config.key[0]
        folder = f"data/L{level}/{uuid.uuid4().hex}"
        if partitions:
            rows = rows.repartitionByRange(partitions, *key)
        writer = rows.sortWithinPartitions(*key, F.col(COMMIT_TS).desc()).write.option("compression", "zstd")
        for k in key:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.storage.root}/{folder}")
        asked = {k: None for k in key} | {COMMIT_TS: T.LongType(), TOMBSTONE: T.BooleanType()}
        if isinstance(self.config.schema[first].dataType, _ORDERED):
            asked[first] = self.config.schema[first].dataType

        def describe(file: tuple[str, int]) -> tuple[Segment, int]:
            n, seen = self.storage.footer(file[0], asked)
            (low, high, _), (t0, t1, _), deletes = seen[first], seen[COMMIT_TS], seen[TOMBSTONE][1]
            return Segment(file[0], level, n, deletes is not False, file[1], low, high, t0 or 0, t1 or 0), sum(seen[k][2] or 0 for k in key)

        files = sorted(self.storage.sizes(folder, ".parquet").items())
        with ThreadPoolExecutor(min(16, len(files) or 1)) as pool:
            found = list(pool.map(describe, files))
        if bad := sum(nulls for _, nulls in found):
            self.storage.delete(folder)
            raise NullKey(f"{bad} values are missing in the key columns {key}")
        return tuple(s for s, _ in found if s.rows)

    def _remove(self, segments: tuple[Segment, ...]) -> None:
        """Delete the folders of segments that were never published."""
        for folder in {s.folder for s in segments}:
            self.storage.delete(folder)

    # Reading.

    def read(self, segments: tuple[Segment, ...]) -> DataFrame:
        """All logged rows of these segments, with their system columns."""
        reader = self.spark.read.schema(self.config.stored)
        return reader.parquet(*[f"{self.storage.root}/{s.id}" for s in segments]) if segments else self.spark.createDataFrame([], self.config.stored)

    def begin_snapshot(self) -> Snapshot:
        head = self.log.head()
        return Snapshot(head.max_commit_ts, head.number, head.segments)

    def snapshot_at(self, ts: int) -> Snapshot:
        """The state after the last commit whose timestamp is not above ``ts``; before the first one, no rows."""
        version = None
        for version in self.log.newest_first():
            if version.max_commit_ts <= ts:
                return Snapshot(ts, version.number, version.segments)
        if version and version.max_commit_ts > 1:
            raise SnapshotExpired(f"the versions before {version.max_commit_ts} are gone")
        return Snapshot(ts, 0, ())

    def list_versions(self, limit: int = 0) -> DataFrame:
        """timestamp, version, segment_count, segment_bytes and level_count, newest first; 0: all."""
        rows = [(v.max_commit_ts, v.number, len(v.segments), sum(s.bytes for s in v.segments), len({s.level for s in v.segments})) for v in islice(self.log.newest_first(), limit or None)]
        return self.spark.createDataFrame(rows, "timestamp long, version long, segment_count long, segment_bytes long, level_count long")

    def scan(self, snapshot: Snapshot | None = None) -> Scan:
        return Scan(self, snapshot)

    def get(self, *key) -> dict | None:
        """The visible row of one key."""
        from palimpsest.functions.predicates import Expr

        rows = self.scan().filter(Expr.and_(*[Expr.eq(k, v) for k, v in zip(self.config.key, key, strict=True)])).to_df().collect()
        return rows[0].asDict(recursive=True) if rows else None

    def begin_transaction(self) -> Transaction:
        return Transaction(self, self.begin_snapshot())

    # Maintenance.

    def compact(self, *, force: bool = False, attempts: int = 2) -> dict | None:
        """Run one planned merge; with ``force``, of all segments into one level. None if nothing is due.

        Only the inputs and the files of the next level whose key ranges they meet are rewritten. A
        delete goes once no deeper file can hold a version of its key.
        """
        began = time.time()
        for attempt in range(attempts):
            head = self.log.head()
            if force:
                plan = Plan(list(head.segments), max([1, *(s.level for s in head.segments)])) if len(head.segments) > 1 else None
            else:
                plan = self.strategy.plan(list(head.segments))
            if not plan:
                return None
            touched, gone = Ranges(plan.inputs), {s.id for s in plan.inputs}
            last = not any(s.level > plan.level and touched.meet(s) for s in head.segments)
            merged = resolve(self.read(tuple(plan.inputs)), self.config.key, keep_tombstones=not last)
            size = sum(s.bytes for s in plan.inputs)
            made = self._write(merged, plan.level, max(1, -(-size // self.strategy.target_file_bytes(plan.level))))
            if self._publish(head, gone, made):
                self.metrics["compactions"] += 1
                done = {"inputs": len(gone), "level": plan.level, "rows_in": sum(s.rows for s in plan.inputs), "rows_out": sum(s.rows for s in made), "bytes_in": size, "bytes_out": sum(s.bytes for s in made), "files_out": len(made), "seconds": time.time() - began}
                self.metrics["last_compaction"] = done
                log.info("compaction %s", done)
                return done
            self._remove(made)
            time.sleep(min(1.0, 0.05 * 2**attempt))
        raise CommitConflict("other compactions came first")

    def _publish(self, planned: Version, gone: set[str], made: tuple[Segment, ...], attempts: int = 20) -> bool:
        """Replace segments in the newest version; later commits stay beside them.

        False if some are gone, or if another merge has put files at this level that ``made`` meets:
        the files of a level below 0 must share no key.
        """
        known, touched = {s.id for s in planned.segments}, Ranges(list(made))
        for attempt in range(attempts):
            head, number = self.log.tip()
            kept = tuple(s for s in head.segments if s.id not in gone)
            if len(head.segments) - len(kept) < len(gone):
                return False
            if made and any(s.level == made[0].level and s.id not in known and touched.meet(s) for s in kept):
                return False
            if self.log.append(Version(number, head.max_commit_ts, time.time(), (*kept, *made), "compaction")):
                return True
            time.sleep(min(1.0, 0.01 * 2**attempt))
        return False

    def compact_all(self) -> list[dict]:
        """Planned merges until none is due."""
        out = []
        while done := self.compact():
            out.append(done)
        return out

    def vacuum(self, retain_versions: int | None = None, *, ttl_s: float | None = None, orphan_s: float = 24 * 3600) -> dict:
        """Delete old versions and all files that no kept version names. Open snapshots of those end.

        Kept are the newest ``retain_versions`` (the table's max_versions) of those that were the head
        within the last ``ttl_s`` seconds (its max_ttl_s), and always the head. Files that no version
        ever named, left by writers that died, go when they are older than ``orphan_s``, which must be
        more than a write can take.
        """
        keep = max(1, retain_versions or self.properties.get("max_versions", 5))
        since = time.time() - (self.properties.get("max_ttl_s", 12 * 3600) if ttl_s is None else ttl_s)
        versions = list(self.log.newest_first())
        kept = [v for i, v in enumerate(versions[:keep]) if i == 0 or versions[i - 1].committed_at >= since]
        live, named = {s.id for v in kept for s in v.segments}, {s.id: s for v in versions for s in v.segments}
        old = [n for n in self.log.numbers() if kept and n < kept[0].number and n not in {v.number for v in kept}]
        for n in old:
            self.log.drop(n)
        dead = [s for s in named.values() if s.id not in live]
        folders = {i.rsplit("/", 1)[0] for i in live}
        for s in dead:
            self.storage.delete(s.folder if s.folder not in folders else s.id)
        left = [(name, size) for name, size, at in [*self.storage.files("data"), *self.storage.files("_drafts")] if at < time.time() - orphan_s and name not in live and (name.rsplit("/", 1)[0] not in folders or name.endswith(".parquet"))]
        for name, _ in left:
            self.storage.delete(name)
        return {"versions": len(old), "segments": len(dead), "bytes": sum(s.bytes for s in dead), "orphans": len(left)}
