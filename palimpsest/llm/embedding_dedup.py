"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors of cosine t lie within eps = sqrt(2 - 2t). Projection on principal axes never lengthens
a distance, so a grid with cells of width eps on the leading axes tells which vectors are provably
apart. Vectors are sorted by their cells (the epsilon grid order) and cut into sequence intervals,
the blocks; two blocks are joined unless their boxes on the leading axes lie more than eps apart,
and in a join both are halved again and again, with the same test, before cosines are taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm._graph import components
from palimpsest.llm._util import settle

#: Leading axes of the grid, those by which blocks meet, vectors of a block, and vectors below which a block is not halved further.
AXES, MEETING, BLOCK, LEAF = 8, 3, 8192, 256
#: Bytes of a block's vectors, at most: long ones make up smaller blocks.
BLOCK_BYTES = 4 << 20
#: Up to this many dimensions axes come from all products of components; beyond, from repeated sketches.
EXACT_DIMENSIONS, SKETCHES = 256, 3


def _usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v, kind = F.col("vec"), df.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vec"))
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & sound, F.lit(False))
    return rows.select("vec_id", "label", "vec", ok.alias("ok"), F.xxhash64("vec").alias("a"), F.xxhash64(F.lit("second"), "vec").alias("b"))


def _moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each number of dimensions the leading axes of all unit vectors, from their summed products.

    Beyond EXACT_DIMENSIONS the matrix of products C is not summed up itself, but C Q for a few
    columns Q, again and again (subspace iteration), so that what is gathered grows with the
    dimensions alone.
    """
    width = 2 * AXES

    def summed(basis: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        shared = rows.sparkSession.sparkContext.broadcast(basis)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for d, _, u in _by_dimension(batch.column(0)):
                    if d <= EXACT_DIMENSIONS and not shared.value:
                        total[d] = total.get(d, 0) + u.T @ u
                    elif d > EXACT_DIMENSIONS:
                        q = shared.value.get(d)
                        total[d] = total.get(d, 0) + u.T @ (u @ (np.random.RandomState(d).randn(d, width) if q is None else q))
            for d, m in total.items():
                i, j = np.triu_indices(d) if d <= EXACT_DIMENSIONS else (x.ravel() for x in np.indices((d, width)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), pa.array(m[i, j])], ["d", "i", "j", "x"])

        found = rows.select("vec").mapInArrow(sums, "d long, i long, j long, x double").groupBy("d", "i", "j").agg(F.sum("x").alias("x")).toPandas()
        out = {}
        for d, part in found.groupby("d"):
            m = np.zeros((d, d) if d <= EXACT_DIMENSIONS else (d, width))
            m[part["i"], part["j"]] = part["x"]
            if d <= EXACT_DIMENSIONS:
                m[part["j"], part["i"]] = part["x"]
            out[int(d)] = m
        return out

    products = summed({})
    axes = {d: np.linalg.eigh(m)[1][:, ::-1][:, :AXES].copy() for d, m in products.items() if d <= EXACT_DIMENSIONS}
    basis = {d: np.linalg.qr(m)[0] for d, m in products.items() if d > EXACT_DIMENSIONS}
    for _ in range(SKETCHES if basis else 0):
        products = summed(basis)
        # Within the space of Q, the eigenvectors of Q'CQ come first.
        for d, q in basis.items():
            if d in products:
                turn = np.linalg.eigh((q.T @ products[d] + products[d].T @ q) / 2)[1][:, ::-1]
                axes[d], basis[d] = (q @ turn)[:, :AXES].copy(), np.linalg.qr(products[d] @ turn)[0]
    return axes


def _by_dimension(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, rows, unit vectors in double precision) of a list column, for each length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = column.offsets.to_numpy()[:-1]
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, _unit(flat[starts[rows][:, None] + np.arange(d)])


def _unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, as squares of large or small components leave the range."""
    v = v / np.abs(v).max(1)[:, None]
    return v / np.sqrt((v * v).sum(1))[:, None]


def _project(u: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    p = u @ axes[u.shape[1]]
    return np.pad(p, ((0, 0), (0, AXES - p.shape[1])))


def _blocks(reps: DataFrame, axes: dict[int, np.ndarray], eps: float, parts: int) -> DataFrame:
    """Sequence intervals of the grid order, each with the box of its vectors on the leading axes."""
    sc = reps.sparkSession.sparkContext
    element = reps.schema["vec"].dataType.simpleString()
    shared = sc.broadcast(axes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.zeros((batch.num_rows, AXES), np.int32)
            at = np.zeros((batch.num_rows, AXES))
            for _, rows, u in _by_dimension(batch.column(2)):
                at[rows] = _project(u, shared.value)
                cells[rows] = np.floor(at[rows] / eps)
            extra = [pa.array(np.diff(batch.column(2).offsets.to_numpy())), pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), AXES).cast(pa.list_(pa.int32())), pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), AXES).cast(pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], ["vec_id", "label", "vec", "copies", "d", "cells", "at"])

    placed = reps.select("vec_id", "label", "vec", "copies").mapInArrow(place, f"vec_id long, label string, vec {element}, copies long, d int, cells array<int>, at array<double>")
    order = ["label", "d", *[F.col("cells")[i] for i in range(AXES)], "vec_id"]
    ordered = settle(placed).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, n, held, key, size = TaskContext.get().partitionId(), 0, [], None, 0

        def made() -> pa.RecordBatch:
            nonlocal n, held, size
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            at = whole.column(6).flatten().to_numpy().reshape(-1, AXES)
            block = (worker << 32) + n
            n, held, size = n + 1, [], 0
            vectors = whole.column(2).flatten().to_numpy().tobytes()
            columns = [[key[0]], [key[1]], [block], [at.min(0)], [at.max(0)], [whole.column(0).to_numpy()], [whole.column(3).to_numpy()], [vectors]]
            types = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["label", "d", "block", "lo", "hi", "ids", "copies", "vectors"])

        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True))
            i = 0
            while i < len(keys):
                if held and keys[i] != key:
                    yield made()
                key = keys[i]
                most = max(1, min(BLOCK, BLOCK_BYTES // (4 * key[1]))) - size
                j = i + 1
                while j < len(keys) and j - i < most and keys[j] == key:
                    j += 1
                held.append(batch.slice(i, j - i))
                size += j - i
                if j - i == most:
                    yield made()
                i = j
        if held:
            yield made()

    return ordered.mapInArrow(cut, "label string, d int, block long, lo array<double>, hi array<double>, ids array<long>, copies array<long>, vectors binary")


def _apart(a_lo, a_hi, b_lo, b_hi) -> float:
    """The square of the distance of two boxes."""
    gap = np.maximum(0, np.maximum(a_lo - b_hi, b_lo - a_hi))
    return float((gap * gap).sum())


def _links(xp: np.ndarray, xu: np.ndarray, yp: np.ndarray, yu: np.ndarray, cosine: float, eps: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, links) of the leaves of two blocks that hold a link, halving both as long as they may meet."""
    todo = [(0, len(xu), 0, len(yu))]
    while todo:
        a, b, c, d = todo.pop()
        if _apart(xp[a:b].min(0), xp[a:b].max(0), yp[c:d].min(0), yp[c:d].max(0)) > eps * eps:
            continue
        if max(b - a, d - c) > LEAF:
            rows = [(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > LEAF else [(a, b)]
            todo += [(p, q, r, s) for p, q in rows for r, s in ([(c, (c + d) // 2), ((c + d) // 2, d)] if d - c > LEAF else [(c, d)])]
            continue
        linked = xu[a:b] @ yu[c:d].T >= cosine
        if linked.any():
            yield a, c, linked


def _joined(pairs: DataFrame, axes: dict[int, np.ndarray], cosine: float, eps: float, kind: str) -> DataFrame:
    """(vec_id, links, root): for each pair of blocks its vectors' links there and the least vector they reach."""
    shared = pairs.sparkSession.sparkContext.broadcast(axes)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                sides, same = [], row["block_x"] == row["block_y"]
                for s in "x" if same else "xy":
                    u = _unit(np.frombuffer(row[f"vectors_{s}"], kind).reshape(-1, row["d"]).astype(np.float64))
                    sides.append((np.array(row[f"ids_{s}"]), np.array(row[f"copies_{s}"]), u, _project(u, shared.value)))
                (xi, xc, xu, xp), (yi, yc, yu, yp) = sides[0], sides[-1]
                leaves = []
                for a, c, linked in _links(xp, xu, yp, yu, cosine, eps):
                    if same:  # a pair is asked from both sides, and no vector about itself
                        linked = linked & ((np.arange(a, a + linked.shape[0])[:, None] != np.arange(c, c + linked.shape[1])[None, :]))
                    if linked.any():
                        leaves.append((slice(a, a + linked.shape[0]), slice(c, c + linked.shape[1]), linked))
                if not leaves:
                    continue
                far = np.iinfo(np.int64).max
                nx, ny = np.zeros(len(xi), np.int64), np.zeros(len(yi), np.int64)
                rx = xi.copy()
                ry = rx if same else yi.copy()
                for p, q, linked in leaves:
                    nx[p] += linked @ yc[q]
                    ny[q] += linked.T @ xc[p]
                while True:
                    before = rx.copy(), ry.copy()
                    for p, q, linked in leaves:
                        rx[p] = np.minimum(rx[p], np.where(linked, ry[q][None, :], far).min(1))
                        ry[q] = np.minimum(ry[q], np.where(linked, rx[p][:, None], far).min(0))
                    if (before[0] == rx).all() and (before[1] == ry).all():
                        break
                # Leaves of a block with itself come in mirrored pairs, so that rows alone count all links.
                keep = nx > 0
                ids, n, root = xi[keep], nx[keep], rx[keep]
                if not same:
                    keep = ny > 0
                    ids, n, root = np.concatenate((ids, yi[keep])), np.concatenate((n, ny[keep])), np.concatenate((root, ry[keep]))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(root)], ["vec_id", "links", "root"])

    return pairs.mapInArrow(join, "vec_id long, links long, root long")


def near_vectors(df: DataFrame, *, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors link whose labels are equal and not null and whose cosine, in double precision, is
    ``cosine`` or more. n_links counts the other vectors that one links with, component_id is the
    least vec_id that links reach, and kept tells that this is the vector's own.

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing,
    nor do vectors of different lengths. Components are read as they are, single or double; others
    are cast to double. A row with a null id has no links, a null component and is
    not kept. Rows of equal id, label and vector are one vector; each gives a row. Equal vectors are
    compared as one and counted as many. No rows give no rows. Columns other than the three named are
    never read.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    rows = _usable(df, id_col, vector_col, label_col)
    sound = rows.where("ok").select("vec_id", "label", "a", "b").distinct()
    equal = sound.groupBy("label", "a", "b").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = settle(
        rows.where("ok")
        .join(equal, ["label", "a", "b"])
        .where("vec_id = rep")
        .dropDuplicates(["vec_id", "label", "a", "b"])
        .select("vec_id", "label", "vec", "copies")
    )
    # As many tasks as there are blocks, half-filled, at least: small ones cost more to start than they do.
    parts = 1 + reps.count() * 2 // BLOCK
    axes = _moments(reps.coalesce(4 * parts))
    blocks = settle(_blocks(reps.coalesce(4 * parts), axes, eps, parts))
    # Blocks meet by label and by the cells of the first axes that they reach: one side's own, and the other's with what eps adds.
    edge = blocks.select("label", "d", "block", "lo", "hi")
    cell = lambda x: F.floor(x / eps).cast("int")
    names = [f"cell_{i}" for i in range(MEETING)]

    def cells(more: float, block: str, *box: str) -> DataFrame:
        out = edge
        for i, name in enumerate(names):
            out = out.withColumn(name, F.explode(F.sequence(cell(F.col("lo")[i] - more), cell(F.col("hi")[i] + more))))
        return out.select("label", "d", F.col("block").alias(block), F.col("lo").alias(box[0]), F.col("hi").alias(box[1]), *names)

    left, right = cells(0.0, "x", "lo_x", "hi_x"), cells(eps, "y", "lo_y", "hi_y")

    def gap(p: str, q: str):
        return F.zip_with(p, q, lambda u, v: F.greatest(u - v, F.lit(0.0)))

    between = F.aggregate(F.zip_with(gap("lo_x", "hi_y"), gap("lo_y", "hi_x"), lambda u, v: u + v), F.lit(0.0), lambda s, g: s + g * g)
    met = left.join(right, ["label", "d", *names]).where(between <= eps * eps)
    # Either of two blocks may be the one that reaches the other's cell.
    near = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    side = lambda s: blocks.select(*([F.col("d")] if s == "x" else []), F.col("block").alias(f"block_{s}"), F.col("ids").alias(f"ids_{s}"), F.col("copies").alias(f"copies_{s}"), F.col("vectors").alias(f"vectors_{s}"))
    pairs = near.join(side("x"), near["x"] == F.col("block_x")).join(side("y"), F.col("y") == F.col("block_y")).drop("x", "y")
    found = settle(_joined(pairs, axes, cosine, eps, "<f4" if "float" in rows.schema["vec"].dataType.simpleString() else "<f8"))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    classes = components(found.select("vec_id", "root"))
    owner = (
        equal.join(links.withColumnRenamed("vec_id", "rep"), "rep", "left")
        .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "a", "b", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    every = rows.select("vec_id", "ok", "a", "b", F.when(F.col("ok"), F.col("label")).alias("label"))
    joined = every.join(owner, ["label", "a", "b"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
