"""The one plan that turns logged versions into visible rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.schema import COMMIT_TS, SEQUENCE, TOMBSTONE


def resolve(log: DataFrame, key: list[str] | tuple[str, ...], read_ts: int | None = None, *, keep_tombstones: bool = False, priority: str | None = None) -> DataFrame:
    """The newest version of each key that is visible at ``read_ts``; keys whose newest is a delete go.

    Among versions of one timestamp the lower ``priority`` wins, then a delete, then the last row.
    A predicate on key columns is pushed below the window by Catalyst, one on values stays above it,
    so that a stale version never comes back. The row-number filter limits each group before the
    shuffle, which keeps many versions of one key from meeting in one task.
    """
    if read_ts is not None:
        log = log.where(F.col(COMMIT_TS) <= F.lit(read_ts))
    order = [F.col(COMMIT_TS).desc(), *([F.col(priority).asc()] if priority else []), F.col(TOMBSTONE).desc(), F.col(SEQUENCE).desc()]
    newest = log.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")
    return newest if keep_tombstones else newest.where(~F.col(TOMBSTONE))
