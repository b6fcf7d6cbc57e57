"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._kernel import release

#: Bits of a bit set over hashes: eight for each counted row, within these bounds. Above, it tells less, never wrong.
LEAST_BITS, MOST_BITS = 1 << 26, 1 << 30


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; where unset, one in the shared warehouse."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not sc.master.startswith("local") and warehouse.startswith(("file:", "/")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = warehouse + "/_checkpoints"
    sc.setCheckpointDir(named)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release_driver(spark: SparkSession) -> bool:
    """Give memory of the driver that is free back to the system, as many short jobs leave much of it.

    Python's objects go first, which hold some of the JVM's: plans, checkpoints and broadcasts that are
    no longer needed. What the JVM frees outside of its heap goes back where it can be asked for that
    (Linux, Java 17.0.9 and later); returns if it could.
    """
    gc.collect()
    release()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()

    def array(kind, *items):
        out = spark.sparkContext._gateway.new_array(kind, len(items))
        for i, item in enumerate(items):
            out[i] = item
        return out

    try:
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # The server's class is not public, so that its method is called as that of the interface.
        kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        call = jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(jvm.Class, *map(jvm.Class.forName, kinds)))
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        call.invoke(beans, array(jvm.Object, name, "systemTrimNativeHeap", array(jvm.Object), array(jvm.String)))
    except Py4JError:
        return False
    return True


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that clash with none of ``taken`` (case-insensitively)."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def bit_set(df: DataFrame, column: str) -> np.ndarray:
    """A power of two of bits, of which those that the hashes in ``column`` fall on are set.

    Executors put them together in pieces of 8 kB, which are all that the driver gathers: 128 MB at
    most, however many rows there are. ``df`` should be settled: it is read twice, the first time to be counted.
    """
    n = min(max(LEAST_BITS, 1 << (8 * df.count()).bit_length()), MOST_BITS)
    bit = F.pmod(F.col(column), F.lit(n))
    words = df.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))

    def piece(key: tuple, rows: pa.Table) -> pa.Table:
        out = np.zeros(1024, np.int64)
        out[rows["at"].to_numpy() & 1023] = rows["bits"].to_numpy()
        return pa.table({"piece": [key[0].as_py()], "data": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros(n // 64, np.int64)
    for row in words.withColumn("piece", F.shiftright("at", 10)).groupBy("piece").applyInArrow(piece, "piece long, data binary").toLocalIterator():
        out[row.piece * 1024 : row.piece * 1024 + 1024] = np.frombuffer(row.data, np.int64)
    return out.view(np.uint64)


def in_bit_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each unsigned hash whether its bit is set; true for all that were put in, and some others."""
    at = hashes & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


#: Ids that are broadcast at most; a longer list is joined by a shuffle.
BROADCAST_IDS = 200_000


def among(df: DataFrame, ids: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Semi or anti join with a settled list of ids, which is counted before it is broadcast."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


#: Shares of all rows: a key that holds more than one of them is hot. Of N rows fewer than this many keys can have N / SHARES each.
SHARES = 1000
#: Tasks over which the rows of a hot key are dealt.
PIECES = 64


def hot_keys(counted: DataFrame, on: list[str], count: str) -> DataFrame:
    """Of keys with the ``count`` of their rows, those that hold more than one in SHARES of all: fewer than SHARES."""
    total = counted.agg(F.sum(count)).first()[0] or 0
    return counted.where(F.col(count) > max(total // SHARES, 1)).select(*on)


def dealt_join(many: DataFrame, once: DataFrame, on: list[str], hot: DataFrame, spread: Column) -> DataFrame:
    """Inner join in which the rows of ``hot`` keys, a list of bounded length, are dealt over PIECES tasks by ``spread``.

    ``once`` has one row for each key, or a few; those of hot keys are copied to all pieces.
    """
    piece, mark = fresh([*many.columns, *once.columns], "_piece", "_hot")
    known = F.broadcast(hot.select(*on, F.lit(True).alias(mark)))
    left = many.join(known, on, "left").withColumn(piece, F.when(F.col(mark), F.pmod(spread, F.lit(PIECES))).otherwise(0).cast("int")).drop(mark)
    copies = F.when(F.col(mark), F.sequence(F.lit(0), F.lit(PIECES - 1))).otherwise(F.array(F.lit(0)))
    right = once.join(known, on, "left").withColumn(piece, F.explode(copies)).drop(mark)
    return left.join(right, [*on, piece]).drop(piece)


def salted_join(many: DataFrame, once: DataFrame, on: list[str], count: str, spread: Column) -> DataFrame:
    """``dealt_join`` with a table that tells the ``count`` of each key's rows in ``many``; the count is left out of the result."""
    once = settle(once)
    return dealt_join(many, once.drop(count), on, hot_keys(once, on, count), spread)
