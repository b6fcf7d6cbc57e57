"""Connected components of a graph given as rows of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._util import salted_join, settle


#: Edges up to which one task does all the work: shuffles would cost more, and the driver has every plan to keep.
TOGETHER = 200_000


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _both(df: DataFrame, *pairs: tuple) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(a.alias("u"), b.alias("v")) for a, b in pairs])).alias("e")).select("e.*")


def _star(edges: DataFrame, *, large: bool) -> DataFrame:
    """Hang neighbours on the least of them: larger ones for a large star, all not larger for a small one."""
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    sides = _both(edges, (u, v), (v, u)) if large else edges
    least = sides.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n")).select("u", F.least("least", "u").alias("m"), "n")
    hung = salted_join(sides, least, ["u"], "n", F.xxhash64("v"))
    out = _both(hung.where("v > u"), (v, m)) if large else _both(hung, (v, m), (u, m))
    return out.where("u <> v").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (u, v) of a graph."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    nodes, at = np.unique(np.concatenate([b.column(i).to_numpy() for i in (0, 1) for b in held]), return_inverse=True)
    u, v = at.reshape(2, -1)
    root, before = np.arange(len(nodes)), None
    while before is None or (root != before).any():
        before = root.copy()
        # Of the two roots of an edge the greater is hung on the less; then every node goes up to its root.
        np.minimum.at(root, np.maximum(before[u], before[v]), np.minimum(before[u], before[v]))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of an edge can reach, by alternating stars.

    ``edges`` has two long columns, in any direction, with repeats and loops allowed. A node's
    neighbours are reduced to their least before a shuffle and are never gathered in one row; the
    rows of a node with very many are spread over several tasks. A graph of up to TOGETHER edges,
    which are counted, at first or after a round, is finished in one task.
    """
    a, b = edges.columns[:2]
    edges = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    before = _digest(edges)
    while before[0]:
        if before[0] <= TOGETHER:
            return edges.coalesce(1).mapInArrow(_joined, "node long, component long")
        edges = settle(_star(_star(edges, large=True), large=False))
        after = _digest(edges)
        if after == before:
            break
        before = after
        rounds -= 1
        if not rounds:
            raise RuntimeError("components did not settle")
    # At the end every edge leads from a node to the least one of its component.
    u, v = F.col("u"), F.col("v")
    return _both(edges, (u, v), (v, v)).distinct().toDF("node", "component")
