"""Fuzzy repeated passages by collinear chaining of shared k-mers of words.

Seeds are k-mers of words, thinned to the least hash of every ``window`` successive ones, so that two
texts which share window + k - 1 words in a row share a seed. A seed that a text repeats is numbered there,
so that texts of one repeated line match in order; a later one also counts as the first of its text, so
that a second copy of a passage is found as well. Each seed is joined with its first occurrence in
the corpus, and so is each run of successive seeds: where the seeds of a passage scatter over the
sources of its sentences, a run over their seams leads to the text that has them together. The matches of a document with one earlier document are chained in order,
with a cost for gaps, by dynamic programming over a Fenwick tree of prefix maxima; chains are then
aligned word by word, extended at both ends, and kept if long and alike enough. Of a chain that is
not, the parts that are stay.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm._kernel import U64, list_array, mix, row_slices, shingles, space_separators, words
from palimpsest.llm._util import BROADCAST_IDS, bit_set, dealt_join, hot_keys, in_bit_set, salted_join, settle

#: Words read beyond both ends of a chain for its extension, unless said otherwise.
MARGIN = 64
#: Numbers of successive seeds that are joined as one.
RUNS = (2, 4)


def minimizers(values: np.ndarray, window: int) -> np.ndarray:
    """Places of the least of every ``window`` successive values; of one's equals the first."""
    n = len(values)
    if n <= window:
        return np.array([int(values.argmin())]) if n else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(values, window)
    return np.unique(np.arange(len(view)) + view.argmin(1))


class Fenwick:
    """Prefix maxima over places 0..n-1; each entry is a score and the index of a match."""

    def __init__(self, n: int):
        self._score, self._match = [float("-inf")] * (n + 1), [-1] * (n + 1)

    def put(self, place: int, score: float, match: int) -> None:
        place += 1
        while place < len(self._score):
            if score > self._score[place]:
                self._score[place], self._match[place] = score, match
            place += place & -place

    def most(self, before: int) -> tuple[float, int]:
        """The best score at a place below ``before``, and its match."""
        best, match = float("-inf"), -1
        while before > 0:
            if self._score[before] > best:
                best, match = self._score[before], self._match[before]
            before -= before & -before
        return best, match


def chain(matches: list[tuple[int, int]], k: int, gap_cost: float) -> list[list[tuple[int, int]]]:
    """Chains of two matches or more that ascend on both sides, best first.

    A match is worth k and a gap costs ``gap_cost`` for each word on either side. Chains are read off
    one table of scores, from the best end on; each stops where an earlier one covers the document,
    that is within k words of a match of it, so that what stands in its gaps can still be matched.
    """
    matches = sorted(set(matches))
    places = {j: r for r, j in enumerate(sorted({j for _, j in matches}))}
    tree, score, back = Fenwick(len(places)), [0.0] * len(matches), [-1] * len(matches)
    waiting: list[int] = []
    last = None
    for m, (i, j) in enumerate(matches):
        if i != last:
            for w in waiting:
                tree.put(places[matches[w][1]], score[w] + gap_cost * sum(matches[w]), w)
            waiting, last = [], i
        before, from_ = tree.most(places[j])
        gain = before - gap_cost * (i + j)
        score[m], back[m] = (k + gain, from_) if gain > 0 else (float(k), -1)
        waiting.append(m)
    out, covered = [], [False] * len(matches)
    lowest = [i for i, _ in matches]
    for end in sorted(range(len(matches)), key=lambda m: -score[m]):
        path = []
        while end >= 0 and not covered[end]:
            path.append(end)
            end = back[end]
        if len(path) >= 2:
            for p in path:
                for m in range(bisect_left(lowest, lowest[p] - k + 1), bisect_left(lowest, lowest[p] + k)):
                    covered[m] = True
            out.append([matches[m] for m in reversed(path)])
        elif path:
            covered[path[0]] = True
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit vectors: one step for each word of ``b``."""
    if not len(a) or not len(b):
        return 0
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    full = row = (1 << len(a)) - 1
    for y in b.tolist():
        if at := row & where.get(y, 0):
            row = ((row + at) | (row - at)) & full
    return len(a) - row.bit_count()


def _extend(a: np.ndarray, b: np.ndarray, drop: int = 6) -> tuple[int, int]:
    """(words, matches) of the best run from the start of both, with up to ``drop`` more misses than it gains."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    score = np.cumsum(np.where(a[:n] == b[:n], 1, -2))
    stop = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > 2 * drop)
    score = score[: int(stop[0])] if len(stop) else score
    if not len(score) or score.max() <= 0:
        return 0, 0
    best = int(score.argmax()) + 1
    return best, int((a[:best] == b[:best]).sum())


def align(x: np.ndarray, y: np.ndarray, path: list[tuple[int, int]], k: int) -> tuple[int, int, int, int, int]:
    """(start, end in x, start, end in y, words matched) of a chain, whose places are those in x and y."""
    i0, j0 = path[0]
    ahead, first = _extend(x[:i0][::-1], y[:j0][::-1])
    matched, i, j = first, i0, j0
    for p, q in path:
        step = min(p - i, q - j) if p - i == q - j else None
        if step is not None and step >= 0:
            matched += int((x[i:p] == y[j:q]).sum())
        elif p >= i and q >= j:
            matched += _common(x[i:p], y[j:q])
        done = max(i - p, j - q, 0)
        matched += max(0, k - done)
        i, j = max(i, p + k), max(j, q + k)
    behind, last = _extend(x[i:], y[j:])
    return i0 - ahead, i + behind, j0 - ahead, j + behind, matched + last


def _between(x: np.ndarray, y: np.ndarray, i: int, j: int, p: int, q: int, k: int) -> int:
    """Words matched from the end (i, j) of one match to that of the next one at (p, q)."""
    inside = 0
    if p >= i and q >= j:
        inside = int((x[i:p] == y[j:q]).sum()) if p - i == q - j else _common(x[i:p], y[j:q])
    return inside + max(0, k - max(i - p, j - q, 0))


def alike_parts(x: np.ndarray, y: np.ndarray, path: list[tuple[int, int]], k: int, identity: float, margin: int = MARGIN) -> list[tuple[int, int, int, int, int]]:
    """What ``align`` gives for the chain if it is alike enough, else for its longest parts that are.

    Of all runs of matches whose words, without extension, are alike enough, those that no other
    contains, without the ones that add no match to their neighbours. An extension that makes a part
    less alike than is asked is left out.
    """

    def fits(found: tuple[int, int, int, int, int]) -> bool:
        s, e, t, f, n = found
        return n >= identity * max(e - s, f - t, 1)

    whole = align(x, y, path, k)
    if fits(whole):
        return [whole]
    p, q = np.array(path, np.int64).T
    gained = [k, *(_between(x, y, a + k, b + k, c, d, k) for (a, b), (c, d) in zip(path, path[1:], strict=False))]
    matched = np.cumsum(gained)
    longest: list[tuple[int, int]] = []
    for a in range(len(path)):
        good = matched[a:] - matched[a] + k >= identity * (np.maximum(p[a:] - p[a], q[a:] - q[a]) + k)
        last = a + int(np.flatnonzero(good)[-1])
        if not longest or last > longest[-1][1]:
            while len(longest) >= 2 and a <= longest[-2][1] + 1:
                longest.pop()
            longest.append((a, last))
    out = []
    for a, last in longest:
        i, j = max(path[a][0] - margin, 0), max(path[a][1] - margin, 0)
        s, e, t, f, n = align(x[i : path[last][0] + k + margin], y[j : path[last][1] + k + margin], [(c - i, d - j) for c, d in path[a : last + 1]], k)
        found = s + i, e + i, t + j, f + j, n
        out.append(found if fits(found) else (path[a][0], path[last][0] + k, path[a][1], path[last][1] + k, int(matched[last] - matched[a]) + k))
    return out


def _nth(row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How often each value has stood in its row before."""
    order = np.lexsort((values, row))
    r, v = row[order], values[order]
    new = np.ones(len(v), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    head = np.flatnonzero(new)
    out = np.empty(len(v), U64)
    out[order] = np.arange(len(v)) - np.repeat(head, np.diff(np.concatenate((head, [len(v)]))))
    return out


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")


def _runs(values: np.ndarray, row: np.ndarray, at: np.ndarray, among: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
    """(hash, row, first and last place) of all runs of RUNS successive values in a row, of those in ``among`` alone."""
    out = []
    for many in RUNS:
        n = len(values) - many + 1
        if n <= 0:
            continue
        total, whole = np.full(n, many, U64), row[:n] == row[many - 1 :]
        for t in range(many):
            total = mix(total * U64(0x9E3779B97F4A7C15) + values[t : t + n])
            if among is not None:
                whole &= among[t : t + n]
        out.append((total[whole], row[:n][whole], at[:n][whole], at[many - 1 :][whole]))
    return out


def _seeds(rows: DataFrame, k: int, window: int, least: int, recurring=None, runs_of=None) -> DataFrame:
    """(s, doc_id, i, l): seeds with their first place, twice; with ``runs_of`` the runs of those in that
    bit set instead, and with ``recurring`` all seeds and runs in that one."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 1):
                w = words(part.column(1), space_separators())
                values, offsets = shingles(w, k)
                size = np.diff(w.first)
                places = [minimizers(values[a:b], window) if n >= max(least, k) else np.zeros(0, np.int64) for a, b, n in zip(offsets[:-1], offsets[1:], size, strict=True)]
                many = np.array([len(p) for p in places])
                at = np.concatenate(places) if places else np.zeros(0, np.int64)
                plain = values[at + np.repeat(offsets[:-1], many)] if len(at) else np.zeros(0, U64)
                row = np.repeat(np.arange(len(many)), many)
                if runs_of:
                    found = _runs(plain, row, at, in_bit_set(runs_of.value, mix(plain.copy())))
                else:
                    nth = _nth(row, plain)
                    found = [(mix(plain + nth * U64(0x9E3779B97F4A7C15)), row, at, at)]
                    if recurring:
                        again = nth > 0
                        found += [(mix(plain[again]), row[again], at[again], at[again]), *_runs(plain, row, at)]
                if not found:
                    continue
                flat, row, at, last = (np.concatenate(c) for c in zip(*found, strict=True))
                if recurring:
                    keep = in_bit_set(recurring.value, flat)
                    flat, row, at, last = flat[keep], row[keep], at[keep], last[keep]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), part.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(last.astype(np.int32))], ["s", "doc_id", "i", "l"])

    return rows.mapInArrow(seeds, "s long, doc_id long, i int, l int")


def _firsts(seeds: DataFrame) -> DataFrame:
    """Where each seed stands first, of those that a later document has too, and how often it stands."""
    f = F.min(F.struct("doc_id", "i", "l")).alias("f")
    return settle(seeds.groupBy("s").agg(f, F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("last > f.doc_id").select("s", F.col("f.doc_id").alias("y"), F.col("f.i").alias("j"), F.col("f.l").alias("m"), "n"))


def _sizes(rows: DataFrame) -> DataFrame:
    """doc_id, source and the number of words of each text."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 2):
                n = np.diff(words(part.column(2), space_separators(), hashes=False).first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n)], ["doc_id", "source", "n"])

    return rows.select("doc_id", "source", "text").mapInArrow(sizes, "doc_id long, source long, n long")


def _without_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first document of each text, and (doc_id, source, n) of the others, told apart by 128 bits of hash."""
    marked = rows.withColumn("a", F.xxhash64("text")).withColumn("b", F.xxhash64(F.lit("second"), "text"))
    ids = marked.select("doc_id", "a", "b")
    first = ids.groupBy("a", "b").agg(F.min("doc_id").alias("source"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = settle(salted_join(ids, first, ["a", "b"], "copies", F.xxhash64("doc_id")).where("doc_id <> source").distinct())
    if copies.count() <= BROADCAST_IDS:
        to = F.broadcast(copies)
        return marked.join(to, ["doc_id", "a", "b"], "left_anti").select("doc_id", "text"), settle(_sizes(marked.join(to, ["doc_id", "a", "b"])).distinct())
    # Texts move once: what is left is read from a settled table from then on.
    return settle(marked.join(copies, ["doc_id", "a", "b"], "left_anti").select("doc_id", "text")), settle(_sizes(marked.join(copies, ["doc_id", "a", "b"])).distinct())


def _pieces(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (doc_id, pair, lo, hi): the words' 32-bit hashes from lo to hi."""
    counted = settle(wanted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    bits = rows.sparkSession.sparkContext.broadcast(bit_set(counted.select(F.xxhash64("doc_id").alias("hash")), "hash"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = in_bit_set(bits.value, batch.column(2).to_numpy().view(U64))
            for part in row_slices(batch.filter(pa.array(there)), 1):
                w = words(part.column(1), space_separators())
                low = mix(w.hash).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([low[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)], pa.binary())], ["doc_id", "w"])

    read_ = rows.withColumn("hash", F.xxhash64("doc_id")).mapInArrow(read, "doc_id long, w binary")
    hot = settle(hot_keys(counted, ["doc_id"], "n"))
    return dealt_join(wanted, read_, ["doc_id"], hot, F.xxhash64("x", "y", "c")).select("x", "y", "c", F.expr("substring(w, lo * 4 + 1, (hi - lo) * 4)").alias("w"), "lo")


def _long_enough(passages: DataFrame, min_words: int) -> DataFrame:
    """Passages that cover ``min_words`` words of their document together with those that they meet."""
    before = Window.partitionBy("doc_id").orderBy("start_word", "end_word", "source_doc_id", "source_start_word")
    reach = F.max("end_word").over(before.rowsBetween(Window.unboundedPreceding, -1))
    islands = passages.withColumn("new", F.when(F.col("start_word") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("doc_id", "island")
    return islands.withColumn("span", F.max("end_word").over(whole) - F.min("start_word").over(whole)).where(F.col("span") >= min_words).drop("new", "island", "span")


def repeated_passages(
    df: DataFrame, *, k: int = 6, window: int = 10, min_words: int = 50, identity: float = 0.8, gap_cost: float = 0.1, margin: int = MARGIN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Passages of ``min_words`` words or more that occur, exactly or nearly, in an earlier document.

    A passage may be pieced together from several sources whose parts meet, whatever their lengths.
    One row per part of a passage and its source: doc_id, start_word, end_word, source_doc_id,
    source_start_word, source_end_word, matched_words, identity (matched words by the longer side's
    length) and exact (the whole text is a copy of the source's). Documents are ordered by id. A
    text's copies refer to the first of them and are not chained again. A chain's ends are extended
    by up to ``margin`` words; farther on, other seeds would have to be shared.

    A null text or id and a text of fewer than ``min_words`` words give no rows, nor do passages that
    repeat within one document. Rows of equal id and text are one document, and rows that only share
    an id are each read as that document. Of equally good chains the first is taken. No rows give no
    rows. Columns other than the two named are never read.
    """
    rows, copies = _without_copies(_texts(df, id_col, text_col))

    spread = rows.sparkSession.sparkContext.broadcast
    firsts = _firsts(_seeds(rows, k, window, min_words))
    # Most seeds that occur once are left out before the shuffle, by a bit set of those that recur.
    firsts = firsts.unionByName(_firsts(_seeds(rows, k, window, min_words, runs_of=spread(bit_set(firsts, "s")))))
    hot = settle(hot_keys(firsts, ["s"], "n"))
    every = _seeds(rows, k, window, min_words, spread(bit_set(firsts, "s")))
    shared = dealt_join(every, firsts.drop("n"), ["s"], hot, F.xxhash64("doc_id", "i")).where("doc_id > y").select(F.col("doc_id").alias("x"), "y", "i", "j", "l", "m")
    # A document has a few matches at most for each of its own seeds, so that a group is no longer than the document.
    grouped = shared.groupBy("x", "y").agg(F.collect_list(F.struct("i", "j", "l", "m")).alias("m")).where((F.size("m") >= 2) | (F.col("m")[0]["l"] > F.col("m")[0]["i"]))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            at, flat = batch.column(2).offsets.to_pylist(), batch.column(2).flatten()
            low = at[0] if at else 0
            i, j, l, m = (flat.field(n).to_pylist() for n in range(4))
            for x, y, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), at, at[1:], strict=False):
                a, b = a - low, b - low
                for c, path in enumerate(chain([*zip(i[a:b], j[a:b], strict=True), *zip(l[a:b], m[a:b], strict=True)], k, gap_cost)):
                    out.append((x, y, c, [p for p, _ in path], [q for _, q in path]))
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], ["x", "y", "c", "i", "j"])

    chains = settle(grouped.mapInArrow(chained, "x long, y long, c int, i array<int>, j array<int>"))

    def wanted(doc: str, places: str) -> DataFrame:
        low = F.greatest(F.col(places)[0] - margin, F.lit(0))
        return chains.select(F.col(doc).alias("doc_id"), "x", "y", "c", low.alias("lo"), (F.element_at(places, -1) + k + margin).alias("hi"))

    left, right = (_pieces(rows, wanted(*side)).withColumnRenamed("w", f"w_{side[0]}").withColumnRenamed("lo", f"lo_{side[0]}") for side in (("x", "i"), ("y", "j")))
    both = chains.join(left, ["x", "y", "c"]).join(right, ["x", "y", "c"]).select("x", "y", "i", "j", "w_x", "lo_x", "w_y", "lo_y")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y, i, j, wx, lx, wy, ly in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "i", "j", "w_x", "lo_x", "w_y", "lo_y")), strict=True):
                a, b = np.frombuffer(wx, np.uint32), np.frombuffer(wy, np.uint32)
                for s, e, t, f, n in alike_parts(a, b, [(p - lx, q - ly) for p, q in zip(i, j, strict=True)], k, identity, margin):
                    e, f = min(e, len(a)), min(f, len(b))
                    if e - s >= k:
                        out.append((x, s + lx, e + lx, y, t + ly, f + ly, n, min(n / max(e - s, f - t, 1), 1.0), False))
            if out:
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

    fuzzy = _long_enough(both.mapInArrow(aligned, SCHEMA).distinct(), min_words)
    n = F.col("n").cast("int")
    whole = copies.where(F.col("n") >= min_words).select(
        "doc_id", F.lit(0).alias("start_word"), n.alias("end_word"), F.col("source").alias("source_doc_id"), F.lit(0).alias("source_start_word"), n.alias("source_end_word"), n.alias("matched_words"), F.lit(1.0).alias("identity"), F.lit(True).alias("exact")
    )
    return whole.unionByName(fuzzy)


SCHEMA = "doc_id long, start_word int, end_word int, source_doc_id long, source_start_word int, source_end_word int, matched_words int, identity double, exact boolean"
