"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are word sequences (runs of letters and digits, A-Z lower-cased). Running
Karp-Rabin hashes of every ``min_match`` words are the seeds; a seed that a document shares with an
item starts a common run. Tiling then marks the longest common run whose words are all unmarked on
both sides, again and again, until none of ``min_match`` words is left. As the tiles may lie in any
order, a passage whose sentences were moved about is covered all the same.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._kernel import punctuation_separators, row_slices, shingles, words
from palimpsest.llm._util import settle

#: Seeds of the benchmark that a worker holds at once; a larger benchmark is taken in several blocks.
BLOCK_SEEDS = 1_000_000

SCHEMA = "doc_id long, item_id long, coverage double, matched_words int, item_words int, tiles int"


def tiles(runs: list[tuple[int, int, int]], n_doc: int, n_item: int, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from maximal common runs (start in document, start in item, length)."""
    doc, item = np.zeros(n_doc, bool), np.zeros(n_item, bool)
    heap = [(-length, i, j) for i, j, length in runs if length >= min_match]
    heapq.heapify(heap)
    out, left = [], n_item
    while heap and left >= min_match:
        minus, i, j = heapq.heappop(heap)
        length = -minus
        used = doc[i : i + length] | item[j : j + length]
        if not used.any():
            doc[i : i + length] = item[j : j + length] = True
            out.append((i, j, length))
            left -= length
            continue
        free = np.flatnonzero(np.diff(np.concatenate(([True], used, [True])).astype(np.int8)))
        for a, b in zip(free[0::2], free[1::2], strict=True):
            if b - a >= min_match:
                heapq.heappush(heap, (-int(b - a), i + int(a), j + int(a)))
    return out


def _joined(at: np.ndarray, there: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (start in document, start in item, number of seeds), joined where one goes on with another on its diagonal."""
    order = np.lexsort((at, at - there))
    at, there, seeds = at[order], there[order], seeds[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + seeds[:-1]) | (np.diff(at - there) != 0)
    head = np.flatnonzero(new)
    return at[head], there[head], np.add.reduceat(seeds, head) if len(head) else seeds


#: Seed pairs that are looked at in one piece.
_PIECE = 1 << 20


class Items:
    """Seeds of some benchmark items, sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str], min_match: int):
        self.k = min_match
        w = words(pa.array(texts, pa.string()), punctuation_separators())
        self.ids, self.size = ids, np.diff(w.first)
        seeds, offsets = shingles(w, min_match)
        enough = np.repeat(self.size >= min_match, np.diff(offsets))
        row = np.repeat(np.arange(len(ids)), np.diff(offsets))
        place = np.arange(len(seeds)) - np.repeat(offsets[:-1], np.diff(offsets))
        # By hash, then by item: what a document's seed meets of one item lies together.
        order = np.lexsort((place[enough], row[enough], seeds[enough]))
        self.seed, self.row, self.place = seeds[enough][order], row[enough][order].astype(np.int32), place[enough][order].astype(np.int32)

    def covered(self, texts: pa.Array, threshold: float) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(row, item, coverage, matched words, item words, tiles) of the pairs with that coverage.

        A pair is tiled only if the item's words that lie in any shared seed reach the threshold, as
        tiles cannot cover others. Its runs are made from pieces of _PIECE seed pairs and joined, so
        that a word that both sides repeat endlessly takes time but no more room.
        """
        w = words(texts, punctuation_separators())
        seeds, offsets = shingles(w, self.k)
        if not len(self.seed):
            return
        size = np.diff(w.first)
        low = np.searchsorted(self.seed, seeds)
        row = np.repeat(np.arange(len(size)), np.diff(offsets))
        hit = np.flatnonzero((self.seed[np.minimum(low, len(self.seed) - 1)] == seeds) & (size[row] >= self.k))
        low, row = low[hit], row[hit]
        many = np.searchsorted(self.seed, seeds[hit], "right") - low
        place = hit - offsets[row]
        for a, b in zip(*(lambda cut: (cut[:-1], cut[1:]))(np.flatnonzero(np.concatenate(([True], np.diff(row) != 0, [True])))) if len(row) else ((), ()), strict=True):
            r = int(row[a])
            for item in self._likely(seeds[hit[a:b]], low[a:b], many[a:b], threshold):
                length = int(self.size[item])
                found = tiles(self._runs(item, place[a:b], low[a:b], many[a:b]), int(size[r]), length, self.k)
                matched = sum(t[2] for t in found)
                if matched >= threshold * length:
                    yield r, item, matched / length, matched, length, len(found)

    def _likely(self, seeds: np.ndarray, low: np.ndarray, many: np.ndarray, threshold: float) -> list[int]:
        """Items of which shared seeds hold enough words; each distinct seed of the text is looked at once."""
        _, first = np.unique(seeds, return_index=True)
        low, many = low[first], many[first]
        at = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        item, place = self.row[at], self.place[at]
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        step = np.full(len(item), self.k, np.int64)
        same = item[1:] == item[:-1]
        step[1:][same] = np.minimum(self.k, np.diff(place)[same])
        held = np.bincount(item, step, minlength=len(self.ids))
        return np.flatnonzero((held >= threshold * self.size) & (held > 0)).tolist()

    def _runs(self, item: int, place: np.ndarray, low: np.ndarray, many: np.ndarray) -> list[tuple[int, int, int]]:
        """Maximal common runs of one document and one item."""
        base = np.concatenate(([0], np.cumsum(many)))
        parts, i = [], 0
        while i < len(place):
            j = max(i + 1, int(np.searchsorted(base, base[i] + _PIECE, "right")) - 1)
            n = many[i:j]
            at = np.repeat(low[i:j] - (base[i:j] - base[i]), n) + np.arange(int(n.sum()))
            mine = self.row[at] == item
            doc, there = np.repeat(place[i:j], n)[mine], self.place[at[mine]].astype(np.int64)
            parts.append(_joined(doc, there, np.ones(len(doc), np.int64)))
            i = j
        at, there, seeds = _joined(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else ([], [], [])
        return [(int(x), int(y), int(n) + self.k - 1) for x, y, n in zip(at, there, seeds, strict=True)]


def _blocks(benchmark: DataFrame, min_match: int, item_col: str, text_col: str) -> Iterator[tuple[bytes, bool]]:
    """The benchmark in blocks of about BLOCK_SEEDS seeds, each packed by an executor, and whether it is the last.

    The driver holds one of them at a time. Items of fewer than ``min_match`` words have no seeds.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(n_bytes) // (6 * BLOCK_SEEDS)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("item_id", "ascending"), ("text", "ascending")])
        block = Items(table["item_id"].to_pylist(), table["text"].to_pylist(), min_match)
        return pa.table({"block": pa.array([pickle.dumps(block)], pa.binary())})

    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else items
        packed = part.groupBy(F.lit(0).alias("all")).applyInArrow(pack, "block binary").collect()
        yield bytes(packed[0].block) if packed else pickle.dumps(Items([], [], min_match)), b == n - 1


def find_contamination(
    df: DataFrame, benchmark: DataFrame, *, threshold: float = 0.6, min_match: int = 4, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Pairs of a document and a benchmark item of which tiles cover ``threshold`` of the words or more.

    The whole of every text is compared with all items. Executors pack the items in blocks of bounded
    size; one at a time is held, with one pass over the documents each. A null or empty text, and an
    item of fewer than ``min_match`` words, match nothing; rows with null ids of documents are
    reported with a null doc_id, items with null ids are passed over; repeated rows each give their
    pairs; of equally long runs the one that comes first is marked first. Empty tables give no rows.
    Columns other than those named are never read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for packed, last in _blocks(benchmark, min_match, item_col, item_text_col):
        shared = df.sparkSession.sparkContext.broadcast(packed)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = pickle.loads(shared.value)
            for batch in batches:
                for part in row_slices(batch, 1):
                    ids = part.column(0).to_pylist()
                    found = [(ids[r], items.ids[i], *rest) for r, i, *rest in items.covered(part.column(1), threshold)]
                    if found:
                        types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        part = rows.mapInArrow(scan, SCHEMA)
        if not last:
            part = settle(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(df: DataFrame, benchmark: DataFrame, *, threshold: float = 0.6, min_match: int = 4, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that cover no benchmark item to ``threshold``, with all their columns unchanged.

    A null or empty text covers nothing; the text may be of any type that casts to a string; repeated
    rows share their fate; an empty benchmark keeps all rows, and no rows give no rows.
    """
    at = df.columns.index(text_col)
    for packed, last in _blocks(benchmark, min_match, item_col, item_text_col):
        shared = df.sparkSession.sparkContext.broadcast(packed)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = pickle.loads(shared.value)
            for batch in batches:
                texts = pc.cast(batch.column(at), pa.string())
                for part in row_slices(pa.RecordBatch.from_arrays([texts, pa.array(range(batch.num_rows), pa.int64())], ["text", "row"]), 0):
                    bad = {r for r, *_ in items.covered(part.column(0), threshold)}
                    first = part.column(1)[0].as_py()
                    yield batch.slice(first, part.num_rows).filter(pa.array([r not in bad for r in range(part.num_rows)]))

        df = df.mapInArrow(keep, df.schema)
        if not last:
            df = settle(df)
            shared.destroy()
    return df
