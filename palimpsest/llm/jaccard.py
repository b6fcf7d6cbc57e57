"""Exact near-duplicate classes by a metric-space join on the Jaccard distance of shingle sets.

The pivots are the shingles themselves, each as a set of one: the distance of a document X to a
pivot is 1 - 1/|X| if X has it and 1 otherwise. All pivots within a document are equally near; the
Voronoi cell that it belongs to is that of the first of them in a fixed global order, common shingles
last. Two documents within distance 1 - t share t of the larger one's shingles at least, so by the
triangle inequality a document may stray into the cells of its first |X| - ceil(t |X|) + 1 pivots
and no further: it is replicated to those. Any two linked documents meet in a region, then, and with
m - 1 pivots more they meet in m regions; a document in fewer shared ones has no link.

Regions are joined recursively. One document is the pivot of the next level: each document's distance
to the least one in its first few regions is taken, which links most of a group of copies. A region
whose documents now lie in one class is done. In the others, what is still apart is compared by
fixed-length signatures: two documents whose signatures differ in more bits than shingles may differ
cannot be linked (the triangle inequality for the symmetric difference). Pairs that are left are held
to the same bound with bucket counts, which grow with the sets, and then verified on the full sets.
Rounds go on in regions with more candidates than one round takes; the last takes all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._graph import components
from palimpsest.llm._kernel import U64, distinct_by_row, list_array, mix, release, row_slices, shingles, space_separators, words
from palimpsest.llm._util import BROADCAST_IDS, among, bit_set, fresh, in_bit_set, release_driver, settle

#: Entries of the list of common shingles, at most, and how often one must occur among CHUNK to be put forward.
COMMON, LEAST_COMMON, CHUNK = 1 << 17, 3, 1 << 22
#: Regions in which linked documents meet: this share of their shingles, or this number if that is more.
MEETINGS_SHARE, MEETINGS = 16, 4
#: 64-bit words of a signature; documents of a region taken at once.
SIGNATURE, TOGETHER = 16, 2048
#: Regions of a document, at most, from which its pivot is taken.
HOMES = 4
#: Candidates for each document of a region in the rounds after the first; None: all.
CANDIDATES = (4, 64, None)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _sets(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct_by_row(*shingles(words(part.column(1), space_separators()), k))


def common_shingles(rows: DataFrame, k: int) -> np.ndarray:
    """Hashes of the most common shingles of all documents, rarest first; at most COMMON of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def said() -> pa.RecordBatch:
            # Sorted in place: few hashes occur often, so that no table of all of them is needed.
            values = np.concatenate(held)
            held.clear()
            values.sort()
            often = np.unique(values[LEAST_COMMON - 1 :][values[LEAST_COMMON - 1 :] == values[: 1 - LEAST_COMMON]])
            times = np.searchsorted(values, often, "right") - np.searchsorted(values, often, "left")
            return pa.RecordBatch.from_arrays([pa.array(often.view(np.int64)), pa.array(times)], ["s", "n"])

        for batch in batches:
            for part in row_slices(batch, 1):
                values, _ = _sets(part, k)
                held.append(values)
                n += len(values)
                if n >= CHUNK:
                    yield said()
                    n = 0
        if n:
            yield said()
        release()

    counted = rows.mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "s").limit(COMMON).toPandas()
    return top["s"].to_numpy(np.int64).view(U64)[::-1].copy()


class Order:
    """The global order of shingles: uncommon ones by hash, then common ones from the rarest on."""

    def __init__(self, common: np.ndarray):
        by_hash = np.argsort(common)
        self.sorted, self.rank = common[by_hash], by_hash

    def first(self, values: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` of one document's distinct shingles, given ascending."""
        if not len(self.sorted):
            return values[:n]
        at = np.minimum(np.searchsorted(self.sorted, values), len(self.sorted) - 1)
        known = self.sorted[at] == values
        rare = values[~known]
        if len(rare) >= n:
            return rare[:n]
        late = values[known][np.argsort(self.rank[at[known]])]
        return np.concatenate((rare, late[: n - len(rare)]))


def _part(size, num: int, den: int):
    """The least number of shingles of a set of ``size`` that a linked one must have too."""
    return (size * num + den - 1) // den


def _meetings(size, num: int, den: int):
    return np.minimum(_part(size, num, den), np.maximum(MEETINGS, size // MEETINGS_SHARE))


def _described(rows: DataFrame, k: int) -> DataFrame:
    """doc_id, n and a 128-bit hash a, b of the set of each document."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 1):
                values, offsets = _sets(part, k)
                a, b = _digests(values, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(a), pa.array(b)], ["doc_id", "n", "a", "b"])

    return rows.mapInArrow(describe, "doc_id long, n long, a long, b long")


def _digests(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    out = []
    for hashed in (mix(values ^ U64(0x5851F42D4C957F2D)), mix(values + U64(0x14057B7EF767814F))):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(hashed, dtype=U64)))
        out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out


def _cells(rows: DataFrame, order, k: int, num: int, den: int, recurring=None) -> DataFrame:
    """(cell, doc_id, n, a, home): each document at its pivots, under the lower half of their hashes.

    With ``recurring``, at those in that bit set and under whole hashes: documents in fewer regions than
    any linked one meets its partners in are left out, and the first HOMES of a document are its homes.
    """

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = order.value
        for batch in batches:
            for part in row_slices(batch, 1):
                values, offsets = _sets(part, k)
                size = np.diff(offsets)
                many = size - _part(size, num, den) + _meetings(size, num, den)
                heads = [ranked.first(values[offsets[i] : offsets[i + 1]], m) for i, m in enumerate(many.tolist())]
                flat = np.concatenate(heads) if heads else np.zeros(0, U64)
                row = np.repeat(np.arange(len(many)), many)
                if recurring:
                    keep = in_bit_set(recurring.value, flat)
                    # The smallest partner of a document bounds the number of regions that they meet in.
                    least = _meetings(_part(size, num, den), num, den)
                    keep &= (np.bincount(row[keep], minlength=len(size)) >= least)[row]
                    flat, row = flat[keep], row[keep]
                first = np.searchsorted(row, row)
                cell = flat.view(np.int64) if recurring else flat.astype(np.uint32).view(np.int32)
                a, _ = _digests(values, offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), part.column(0).take(pa.array(row)), pa.array(size[row]), pa.array(a[row]), pa.array(np.arange(len(row)) - first < HOMES)],
                    ["cell", "doc_id", "n", "a", "home"],
                )

    return rows.where("doc_id is not null").mapInArrow(replicate, f"cell {'long' if recurring else 'int'}, doc_id long, n long, a long, home boolean")


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the documents in a settled list, found before any text is split."""
    if ids.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), "doc_id", "left_semi")
    bits = rows.sparkSession.sparkContext.broadcast(bit_set(ids.select(F.xxhash64("doc_id").alias("hash")), "hash"))

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = in_bit_set(bits.value, batch.column(2).to_numpy().view(U64))
            yield batch.filter(pa.array(keep)).select(["doc_id", "text"])

    some = rows.where("doc_id is not null").withColumn("hash", F.xxhash64("doc_id")).mapInArrow(there, "doc_id long, text string")
    return some.join(ids, "doc_id", "left_semi")


def _counts(values: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of a power of two of buckets, about two in each; b"" if a count is over 255."""
    buckets = 1 << max(4, (len(values) // 2).bit_length())
    n = np.bincount((mix(values ^ U64(0x9FB21C651E98DF25)) & U64(buckets - 1)).astype(np.int64), minlength=buckets)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b""


def _apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of shingles that are in one of two sets only."""
    if not x or not y:
        return 0
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    buckets = min(len(a), len(b))
    return int(np.abs(a.reshape(-1, buckets).sum(0) - b.reshape(-1, buckets).sum(0)).sum())


def _marks(rows: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """doc_id, n, signature and bucket counts of the texts of the documents in ``ids``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 1):
                values, offsets = _sets(part, k)
                size = np.diff(offsets)
                which = (mix(values ^ U64(0x2545F4914F6CDD1D)) % U64(64 * SIGNATURE)).astype(np.int64)
                odd = np.zeros((len(size), 64 * SIGNATURE), np.uint8)
                np.bitwise_xor.at(odd, (np.repeat(np.arange(len(size)), size), which), 1)
                packed = np.packbits(odd, axis=1)
                counts = [_counts(values[offsets[i] : offsets[i + 1]]) for i in range(len(size))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "n", "signature", "counts"])

    return _only(rows, ids).mapInArrow(read, "doc_id long, n long, signature binary, counts binary").where("n > 0")


def _full_sets(rows: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """doc_id, n and the full set of the texts of the documents in ``ids``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 1):
                values, offsets = _sets(part, k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), list_array(values.view(np.int64), offsets, pa.int64())], ["doc_id", "n", "items"])

    return _only(rows, ids).mapInArrow(read, "doc_id long, n long, items array<long>")


def _sides(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Settled pairs (x, y) with the columns of both sides."""
    # Two longs for each of BROADCAST_IDS pairs at most are broadcast; beyond that both sides are shuffled.
    to = F.broadcast(pairs) if pairs.count() <= BROADCAST_IDS else pairs
    return right.join(to, "y").join(left, "x")


def _verified(pairs: DataFrame, rows: DataFrame, marks: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (x, y) whose sets have a Jaccard similarity of num/den or more.

    Bucket counts rule out most others first, so that full sets are read for few pairs besides links.
    """

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            needed = -((-num * both) // (num + den))
            apart = np.fromiter((_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)), np.int64, batch.num_rows)
            yield batch.filter(pa.array(apart <= both - 2 * needed)).select(["x", "y"])

    sides = _sides(settle(pairs), *(marks.select(F.col("doc_id").alias(s), F.col("n").alias(f"n{s}"), F.col("counts").alias(f"c{s}")) for s in ("x", "y")))
    left = settle(sides.select("x", "y", "nx", "ny", "cx", "cy").mapInArrow(plausible, "x long, y long").distinct())
    sides = (_full_sets(rows, settle(left.select(F.col(s).alias("doc_id")).distinct()), k).select(F.col("doc_id").alias(s), F.col("n").alias(f"n{s}"), F.col("items").alias(f"i{s}")) for s in ("x", "y"))
    same = F.size(F.array_intersect("ix", "iy")).cast("long")
    return _sides(left, *sides).where(same * den >= (F.col("nx") + F.col("ny") - same) * num).select("x", "y").distinct()


def _compared(members: DataFrame, signatures: DataFrame, num: int, den: int, most: int | None) -> DataFrame:
    """(region, x, y, more): pairs of different classes that their signatures do not rule out, and if their region has more.

    A region of more than TOGETHER documents is cut into lots by size, and each two lots whose sizes
    can be similar are a group of their own.
    """
    size = members.groupBy("region").agg(F.count(F.lit(1)).alias("c"))
    lots = F.ceil(F.col("c") / TOGETHER).cast("int")
    keyed = members.join(size, "region").join(signatures, ["doc_id", "n"]).withColumn("lots", lots).withColumn("lot", F.when(F.col("lots") > 1, F.pmod(F.xxhash64("doc_id", "region"), F.col("lots"))).otherwise(F.lit(0)).cast("int"))
    dealt = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).select(
        "region", F.least("lot", "other").alias("i"), F.greatest("lot", "other").alias("j"), "lot", "doc_id", "n", "class", "signature"
    )

    def compare(table: pa.Table) -> pa.Table:
        ids, n, group, lot = (table[c].to_numpy() for c in ("doc_id", "n", "class", "lot"))
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        bits = np.frombuffer(b"".join(table["signature"].to_pylist()), U64).reshape(len(ids), SIGNATURE)
        xs, ys, more = [], [], False
        rows = np.flatnonzero(lot == i)
        cols = np.flatnonzero(lot == j)
        for a in range(0, len(rows), 64):
            r = rows[a : a + 64]
            apart = np.bitwise_count(bits[r][:, None, :] ^ bits[cols][None, :, :]).sum(2, dtype=np.int64)
            both = n[r][:, None] + n[cols][None, :]
            needed = -((-num * both) // (num + den))
            small = np.minimum(n[r][:, None], n[cols][None, :])
            ok = (apart <= both - 2 * needed) & (small >= needed) & (group[r][:, None] != group[cols][None, :])
            if i == j:
                ok &= ids[r][:, None] < ids[cols][None, :]
            if most is not None and ok.sum(1).max(initial=0) > most:
                more = True
                near = np.argpartition(np.where(ok, apart, 1 << 30), most, axis=1)[:, :most]
                some = np.zeros_like(ok)
                np.put_along_axis(some, near, True, axis=1)
                ok &= some
            p, q = np.nonzero(ok)
            xs.append(ids[r][p])
            ys.append(ids[cols][q])
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
        return pa.table({"region": np.full(len(x), table["region"][0].as_py()), "x": np.minimum(x, y), "y": np.maximum(x, y), "more": np.full(len(x), more)})

    return dealt.groupBy("region", "i", "j").applyInArrow(compare, "region long, x long, y long, more boolean")


def jaccard_classes(df: DataFrame, *, k: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased; a document's set is that of
    its distinct shingles of ``k`` words, or its whole sequence if that is shorter. Documents link
    whose sets have a Jaccard similarity of threshold[0]/threshold[1] or more, in whole numbers;
    component_id is the least doc_id that links reach.

    A null or empty text has no shingles and links with nothing. A row with a null id gets a null
    component_id. Rows that share an id are one document, linked by any of its texts, and each gives
    a row. Ties, as in documents equally near, never decide: every link counts. No rows give no rows.
    Columns other than the two named are never read.
    """
    num, den = threshold
    rows = _texts(df, id_col, text_col)
    spark = df.sparkSession
    sc = spark.sparkContext
    release_driver(spark)
    order = sc.broadcast(Order(common_shingles(rows, k)))
    described = settle(_described(rows, k))

    # Equal sets are one document from here on: the one with the least id.
    equal = described.where("doc_id is not null and n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"))
    copies = settle(described.join(equal, ["n", "a", "b"]).where("doc_id <> rep").select("doc_id", "n", "a").distinct())

    few = copies.count() <= BROADCAST_IDS

    def single(cells: DataFrame) -> DataFrame:
        return cells.join(F.broadcast(copies) if few else copies, ["doc_id", "n", "a"], "left_anti")

    every = _cells(rows, order, k, num, den)
    # Copies that are too many to broadcast are taken out once only few cells are left. Half a hash is
    # all that the bit set reads; cells that it takes for recurring ones make regions of one document.
    recurring = (single(every) if few else every).groupBy("cell").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("cell")
    recurring = settle(recurring)
    cells = settle(single(_cells(rows, order, k, num, den, sc.broadcast(bit_set(recurring, "cell")))).select("cell", "doc_id", "n", "home"))
    marks = settle(_marks(rows, settle(cells.where("home").select("doc_id").distinct()), k))
    release_driver(spark)

    # Each document is held against one pivot, the least in its homes.
    homes = cells.where("home")
    pivots = homes.groupBy("cell").agg(F.min(F.struct("doc_id", "n")).alias("p")).select("cell", F.col("p.doc_id").alias("x"), F.col("p.n").alias("pn"))
    near = (F.least("n", "pn") * den >= F.greatest("n", "pn") * num) & (F.col("doc_id") != F.col("x"))
    pairs = homes.join(pivots, "cell").where(near).groupBy(F.col("doc_id").alias("y")).agg(F.min("x").alias("x")).select("x", "y")
    links = settle(_verified(pairs, rows, marks, k, num, den))
    classes = settle(components(links))
    release_driver(spark)

    def placed(members: DataFrame) -> DataFrame:
        known = classes.select(F.col("node").alias("doc_id"), "component")
        known = F.broadcast(known) if known.count() <= BROADCAST_IDS else known
        return members.join(known, "doc_id", "left").withColumn("class", F.coalesce("component", "doc_id")).drop("component")

    # Regions with documents of several classes are open; those with the same documents are one region.
    regions = placed(cells.drop("home")).groupBy("cell").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("p"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.bit_xor(F.xxhash64("doc_id", "n")).alias("f"))
    regions = settle(regions.where("lo <> hi").groupBy("c", "p", "f").agg(F.min("cell").alias("cell")).select("cell"))
    members = settle(among(cells.select("cell", "doc_id", "n"), regions, ["cell"]).withColumnRenamed("cell", "region"))
    for most in CANDIDATES:
        open_members = placed(members)
        split = open_members.groupBy("region").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("region")
        compared = settle(_compared(settle(open_members.join(split, "region", "left_semi")), marks.select("doc_id", "n", "signature"), num, den, most))
        pairs = compared.select("x", "y").distinct()
        if pairs.isEmpty():
            break
        links = settle(links.unionByName(_verified(pairs, rows, marks, k, num, den)))
        classes = settle(components(links))
        release_driver(spark)
        more = settle(compared.where("more").select("region").distinct())
        if more.isEmpty():
            break
        members = among(members, more, ["region"])

    owner = equal.join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left").select("n", "a", "b", F.coalesce("component", "rep").alias("owner"))
    out = described.select("doc_id", "n", "a", "b").join(owner, ["n", "a", "b"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("owner", "doc_id")).alias("component_id"))


def one_of_each(df: DataFrame, *, k: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is the least of its class, with all their columns unchanged.

    Of rows with equal id and text one stays; rows with one id and different texts share their fate.
    Rows with a null id, and those with a null text, one of blanks or none, are in no class and stay.
    No rows give no rows.
    """
    key, text = fresh(df.columns, "other", "said")
    classes = jaccard_classes(df, k=k, threshold=threshold, id_col=id_col, text_col=text_col)
    others = classes.where("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
    kept = df.join(others, df[id_col].cast("long") == others[key], "left_anti").withColumn(text, F.xxhash64(df[text_col].cast("string")))
    # Repeated rows are few or none: they alone are shuffled, by a list of their ids.
    again = settle(kept.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(id_col, text).agg(F.count(F.lit(1)).alias(key)).where(F.col(key) > 1).select(id_col).distinct())
    if not again.count():
        return kept.drop(text)
    return among(kept, again, [id_col], "left_anti").unionByName(among(kept, again, [id_col]).dropDuplicates([id_col, text])).drop(text).select(*df.columns)
