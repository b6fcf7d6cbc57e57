"""Ingest a stream, one commit for each micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.table import Table


def ingest_stream(stream: DataFrame, table: Table, *, checkpoint: str, tombstone: Column | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start writing ``stream`` to ``table``. A batch that is replayed upserts the same keys again."""

    def write(batch: DataFrame, _: int) -> None:
        table.ingest_with_tombstones(batch, F.lit(False) if tombstone is None else tombstone)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
