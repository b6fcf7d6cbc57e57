"""Toxicity by compression distance.

Zstandard dictionaries are trained on the whole texts of labelled rows: two on toxic ones and three on
ordinary ones, each on texts of its own, so that what one holds by chance the others lack. Every
window of a text is compressed with each (followed by a fixed carrier line that all dictionaries
hold): its toxic length is the longer of the two, its ordinary length the shortest of the three. A
window that all toxic dictionaries shorten and no ordinary one does is evidence. Windows are single
words, which place the evidence exactly, and runs of eight words, which also see phrases of ordinary
words and are compressed with one dictionary of each side alone.

Pairs of lengths have log-likelihood ratios, measured on labelled texts that no dictionary was
trained on. A text's score is a logistic function, fitted on the same texts, of the sums of these.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._kernel import KEPT, release, row_slices

#: Labelled rows of each class that a model is fitted on, at most; those with the lowest hashes.
MAX_TOXIC, MAX_ORDINARY = 2000, 4000
#: Characters of the sampled texts of a class, at most.
MAX_CHARS = 24_000_000
#: Dictionaries of each side, and the bytes of each: at most this, and a SHAREth of what it is trained on.
N_TOXIC, N_ORDINARY, DICTIONARY, SHARE = 2, 3, 65_536, 4

_WORD = re.compile(r"[^\W\d_]+")
#: Latin-1 with a space for every byte that is no letter.
_SPACED = bytes(b if _WORD.match(chr(b)) else 32 for b in range(256))
_CARRIER = "the quick brown fox jumps over the lazy dog while many windows are measured; "
#: Cells of single words (toxic and ordinary length) and of runs of words (difference of lengths).
_T_BINS, _O_BINS, _RUN_LOW, _RUN_BINS = 24, 30, -16, 48
_RUN, _STRIDE = 8, 8
_CELLS = _T_BINS * _O_BINS + _RUN_BINS
#: Words whose cells are kept: two halves, of which the older goes when the newer is full.
_MEMO = 400_000
#: Texts are counted together up to this many characters, or one longer text, and windows compressed together.
_CHARS, _WINDOWS = 1 << 20, 4096


def words(text: str) -> list[str]:
    """The words of a text, its longest runs of letters, lower-cased, in order."""
    text = text.lower()
    try:
        return text.encode("latin-1").translate(_SPACED).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text)


def runs(w: list[str]) -> list[str]:
    """Windows of _RUN words, every _STRIDE words; the last may be shorter."""
    return [" ".join(w[i : i + _RUN]) for i in range(0, max(1, len(w) - _RUN + _STRIDE), _STRIDE)] if w else []


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=16, search_log=4, min_match=5, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_dict_id=0)


class Distance:
    """Maps windows to cells of their compressed lengths beyond the carrier's."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes]):
        self._memo, self._older = {}, {}
        self._toxic, self._ordinary = ([self._length(c) for c in side] for side in (toxic, ordinary))

    @staticmethod
    def _length(content: bytes):
        d = zstandard.ZstdCompressionDict(content + _CARRIER.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=_parameters())
        compress = zstandard.ZstdCompressor(compression_params=_parameters(), dict_data=d).compress
        carrier = len(compress(_CARRIER.encode()))
        return lambda data: np.fromiter(map(len, map(compress, data)), np.int64, len(data)) - carrier

    @staticmethod
    def _lengths(by: list, windows: list[str]) -> np.ndarray:
        """A row for each dictionary. They take turns of many windows, so that the tables of one stay in the processor's cache."""
        out = np.empty((len(by), len(windows)), np.int64)
        for i in range(0, len(windows), _WINDOWS):
            data = [f" {x} {_CARRIER}".encode() for x in windows[i : i + _WINDOWS]]
            for row, length in zip(out, by, strict=True):
                row[i : i + len(data)] = length(data)
        return out

    def _word_cells(self, w: list[str]) -> np.ndarray:
        """By the longest length of a toxic dictionary and the shortest of an ordinary one."""
        cells = np.fromiter(map(self._memo.get, w, repeat(-1)), np.int64, len(w))
        absent = np.flatnonzero(cells < 0)
        rest = [w[i] for i in absent.tolist()]
        found = {x: self._older.get(x) for x in dict.fromkeys(rest)}
        unseen = [x for x, at in found.items() if at is None]
        t, o = self._lengths(self._toxic, unseen).max(0), self._lengths(self._ordinary, unseen).min(0)
        found.update(zip(unseen, (np.clip(t, 0, _T_BINS - 1) * _O_BINS + np.clip(o, 0, _O_BINS - 1)).tolist(), strict=True))
        for x, at in found.items():
            if len(self._memo) >= _MEMO // 2:
                self._memo, self._older = {}, self._memo
            self._memo[x] = at
        cells[absent] = [found[x] for x in rest]
        return cells

    def _run_cells(self, r: list[str]) -> np.ndarray:
        """By one dictionary of each side: what several tell apart in single words evens out in a run."""
        place = {x: i for i, x in enumerate(dict.fromkeys(r))}
        t, o = self._lengths([self._toxic[0], self._ordinary[0]], [*place])
        cells = _T_BINS * _O_BINS + np.clip(o - t - _RUN_LOW, 0, _RUN_BINS - 1)
        return cells[np.fromiter(map(place.__getitem__, r), np.int64, len(r))]

    def counts(self, text: str) -> np.ndarray:
        """How many windows of ``text`` fall into each cell; none without dictionaries."""
        return self.counts_of([text])[0]

    def counts_of(self, texts: list[str]) -> np.ndarray:
        """The counts of each text, a row for each."""
        out = np.zeros((len(texts), _CELLS), np.int64)
        if not self._toxic:
            return out
        i = 0
        while i < len(texts):
            j, chars = i + 1, len(texts[i])
            while j < len(texts) and chars + len(texts[j]) <= _CHARS:
                chars += len(texts[j])
                j += 1
            split = [words(x) for x in texts[i:j]]
            at = np.arange(0, (j - i) * _CELLS, _CELLS)
            cells = []
            for windows, find in ((split, self._word_cells), ([runs(w) for w in split], self._run_cells)):
                cells.append(find([*chain.from_iterable(windows)]) + np.repeat(at, [*map(len, windows)]))
            out[i:j] = np.bincount(np.concatenate(cells), minlength=(j - i) * _CELLS).reshape(j - i, _CELLS)
            i = j
        return out


def _distance(model: Model) -> Distance:
    """The model's distance; a worker keeps that of the last model, with the words it has seen, for its next task."""
    key = hash((*model.toxic, b"", *model.ordinary))
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = Distance(model.toxic, model.ordinary)
    return KEPT[key]


@dataclass
class Model:
    toxic: list[bytes]
    ordinary: list[bytes]
    ratio: np.ndarray
    evidence: np.ndarray
    weights: np.ndarray

    def features(self, counts: np.ndarray) -> np.ndarray:
        counts = np.atleast_2d(counts)
        single = np.arange(_CELLS) < _T_BINS * _O_BINS
        n, total = counts @ single, counts @ (self.evidence * single)
        weighed = np.clip(counts @ (np.clip(self.ratio, -0.5, 6) * single), -40, 40)
        phrases = np.clip(counts @ (np.clip(self.ratio, -1, 3) * ~single), -40, 40)
        return np.stack([np.ones(len(counts)), np.minimum(total, 40) / 10, np.log1p(total), (total > 0).astype(float), np.log1p(n) / 10, np.minimum(total / np.sqrt(n + 1), 5), weighed / 10, phrases / 10], 1)

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(counts) @ self.weights, -30, 30)))

    @classmethod
    def fit(cls, toxic: list[str], ordinary: list[str]) -> Model:
        """Train on two of three texts of each class and calibrate on the third, near copies left out.

        With fewer than 8 texts of a class no dictionary can be trained and calibrated: every text
        then scores the share of toxic ones.
        """
        toxic, ordinary = _unlike(toxic), _unlike(ordinary)
        none = np.zeros(_CELLS)
        if min(len(toxic), len(ordinary)) < 8:
            return cls([], [], none, none, np.array([math.log((len(toxic) + 0.5) / (len(ordinary) + 1)), *[0.0] * 7]))
        sides = [[_trained(_trained_on(side)[i::n]) for i in range(n)] for side, n in ((toxic, N_TOXIC), (ordinary, N_ORDINARY))]
        model = cls(*sides, none, none, np.zeros(8))
        model._calibrate(toxic[2::3], ordinary[2::3])
        return model

    def _calibrate(self, toxic: list[str], ordinary: list[str]) -> None:
        distance = Distance(self.toxic, self.ordinary)
        t, o = (distance.counts_of(side) for side in (toxic, ordinary))
        self.ratio = np.zeros(_CELLS)
        for part in (slice(_T_BINS * _O_BINS), slice(_T_BINS * _O_BINS, _CELLS)):
            a, b = t[:, part].sum(0), o[:, part].sum(0)
            self.ratio[part] = np.log((a + 0.5) / (a.sum() + 1)) - np.log((b + 0.5) / (b.sum() + 1))
        self.ratio[(t > 0).sum(0) + (o > 0).sum(0) < 3] = 0
        self.evidence = np.where((self.ratio >= 1.5) & ((t > 0).sum(0) >= 3), self.ratio, 0)
        self.weights = _logistic(self.features(np.concatenate([t, o])), np.repeat([1.0, 0.0], [len(t), len(o)]))


def _trained_on(texts: list[str]) -> list[str]:
    return [x for i, x in enumerate(texts) if i % 3 < 2]


def _sample(text: str) -> bytes:
    """The words of a whole text; what it repeats, as a row of equal words or a whole run, stands once.

    The trainer gives up in the middle of a long passage from which there is nothing more to learn.
    """
    w = [x for x, _ in groupby(words(text))]
    return " ".join(dict.fromkeys(" ".join(w[i : i + _RUN]) for i in range(0, len(w), _RUN))).encode()


def _trained(texts: list[str]) -> bytes:
    """The content of a dictionary trained on whole texts, each of them a sample."""
    data = [_sample(x) for x in texts]
    size = min(DICTIONARY, max(1024, sum(map(len, data)) // SHARE))
    # zstandard wants five samples of eight bytes; a handful of texts is given by halves, or with spaces.
    while len(data) < 8:
        data = [h.ljust(8) for x in data for h in (x[: len(x) // 2], x[len(x) // 2 :])]
    try:
        content = zstandard.train_dictionary(size, data, k=16, d=6).as_bytes()
    except zstandard.ZstdError:  # too little text for any choice: all of it is the dictionary
        return b" ".join(data)
    return content


def _unlike(texts: list[str]) -> list[str]:
    """Leave out texts that share a lowest hash of their word triples with an earlier one."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        w = words(text)
        triples = np.array([zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))], np.uint64)
        keys = [(m, int(((triples * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min())) for m in (2654435761, 2246822519, 3266489917, 668265263)]
        if not seen.intersection(keys):
            seen.update(keys)
            out.append(text)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 5e-1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _held_out(doc: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, max_chars: int = MAX_CHARS) -> Model:
    """Fit on labelled rows whose crc32(id as text) mod 5 is not 0.

    Of each class at most ``max_toxic`` or ``max_ordinary`` ids are used, those with the lowest
    hashes; the sample of a class ends before the text with which it would exceed ``max_chars``
    characters. An id labelled both ways is left out, as are null ids, labels and texts; of rows with
    one id the least text counts. Without labels of both classes every text scores their prior.
    Extra columns of both tables are never read.
    """
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .where("toxic = most")
    )
    picked = [marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", "toxic") for y, n in ((1, max_toxic), (0, max_ordinary))]
    sample = picked[0].unionByName(picked[1])
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The sample has at most max_toxic + max_ordinary rows of two integers.
    rows = texts.join(F.broadcast(sample), "doc_id").where("text is not null").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sides: list[list[str]] = [[], []]
    chars = [0, 0]
    for row in rows.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        chars[row.toxic] += len(row.text)
        if chars[row.toxic] <= max_chars:
            sides[row.toxic].append(row.text)
    return Model.fit(sides[1], sides[0])


def score_toxicity(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) of every row, by its whole text.

    A null or empty text has no windows and so the score of no evidence; a null id is passed on and
    not held out; repeated rows each give a row. No rows give no rows. Columns other than the two
    named are never read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = _distance(model)
        for batch in batches:
            for part in row_slices(batch, 1):
                p = model.score(distance.counts_of([x or "" for x in part.column(1).to_pylist()]))
                ids = part.column(0)
                held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 0 for d in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(df: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score below ``threshold``, with all their columns unchanged.

    A null or empty text has the score of no evidence; the text may be of any type that casts to a
    string; repeated rows share their fate; no rows give no rows.
    """
    at = df.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = _distance(model)
        for batch in batches:
            if batch.num_rows:
                texts = pc.cast(batch.column(at), pa.string()).to_pylist()
                p = model.score(distance.counts_of([x or "" for x in texts]))
                yield batch.filter(pa.array(p < threshold))
        # In a pipeline other operators come next, in the same workers.
        KEPT.clear()
        release()

    return df.mapInArrow(keep, df.schema)
