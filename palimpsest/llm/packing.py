"""Harmonic packing of tokenised documents into fixed-length sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of more than C/(k+1) and at most
C/k tokens, and each of its bins takes exactly k of them. Every worker fills its own bins, so the
whole packing is one pass over the input without a shuffle.

A document is first cut into whole sequences of C tokens. What remains is put into a class as it is
where that wastes at most ``slack`` tokens; otherwise a piece of exactly C/(k+1) tokens is cut off,
which fills its share of a bin of the next class, and the rest goes on. Bins that a worker could not
fill are emptied at its end: their pieces are laid end to end and cut into full sequences, and the
last tokens into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._kernel import row_slices

#: The pre-tokeniser pattern of byte-level BPE (a fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with characters beyond these blocks take the slower library: their classes differ between Unicode versions.
_RARE = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class int"


class Encoder:
    """Ids of the tokenizer file at ``path``, without special tokens added.

    Where the file is a plain byte-level BPE whose ids follow its merges, a second library runs the
    same vocabulary faster; a text with a special token's string or rare characters, and any other
    kind of file, goes through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(path)
        self._fast, self._special = None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens") or []]
        if special:
            self._special = re.compile("|".join(map(re.escape, special)))
        ranks = self._ranks(spec, set(special))
        if ranks:
            import tiktoken

            self._fast = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def _ranks(spec: dict, special: set[str]) -> dict[bytes, int] | None:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get(a + b) for a, b in merges]
        if None in made or any(x >= y for x, y in zip(made, made[1:], strict=False)):
            return None
        return {bytes(letter[c] for c in token): i for token, i in model["vocab"].items() if token not in special}

    def __call__(self, text: str) -> list[int]:
        if self._fast and not _RARE.search(text) and not (self._special and self._special.search(text)):
            return self._fast(text)
        return self._exact.encode(text, add_special_tokens=False).ids


def cuts(length: int, capacity: int, slack: int) -> list[tuple[int, int]]:
    """(length, class) of the pieces that a remainder of fewer than ``capacity`` tokens is cut into."""
    out = []
    while length:
        k = capacity // length
        if capacity // k - length <= slack:
            out.append((length, k))
            break
        out.append((capacity // (k + 1), k + 1))
        length -= capacity // (k + 1)
    return out


class _Bins:
    """One worker's sequences. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, worker: int, capacity: int, slack: int):
        self.next, self.capacity, self.slack = worker << 36, capacity, slack
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def _close(self, pieces: list, k: int) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at, k))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self._close([(doc, start, ids[start : start + self.capacity], total)], 1)
            start += self.capacity
        for length, k in cuts(total - start, self.capacity, self.slack):
            waiting = self.open.setdefault(k, [])
            waiting.append((doc, start, ids[start : start + length], total))
            start += length
            if len(waiting) == k:
                self._close(self.open.pop(k), k)

    def finish(self) -> None:
        line, room = [], self.capacity
        rest = sum(len(p[2]) for pieces in self.open.values() for p in pieces)
        for pieces in self.open.values():
            for doc, start, ids, total in pieces:
                while len(ids):
                    if not line:
                        room = self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1)
                    part, ids = ids[:room], ids[room:]
                    line.append((doc, start, part, total))
                    start, room, rest = start + len(part), room - len(part), rest - len(part)
                    if not room:
                        self._close(line, 0)
                        line = []
        self.open = {}


def harmonic_pack(
    df: DataFrame, tokenizer_path: str, *, capacity: int = 2048, eos_id: int = 1, slack: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack every document's ids and ``eos_id`` into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, start (its document's ids before it), length, ids_crc32 (of its ids as
    little-endian unsigned 32-bit values), doc_tokens, sequence_id, offset (its place there, from 0
    without gaps) and class (pieces per bin; 0 for the sequences of a worker's last pieces).

    A null or empty text is the one id ``eos_id``. A null id is passed on; rows that share an id are
    packed one by one. Ties cannot arise: pieces take their places in input order. No rows give no
    rows. Columns other than the two named are never read. A worker keeps at most C ids of each of
    its open classes besides one document.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = Encoder(tokenizer_path), _Bins(TaskContext.get().partitionId(), capacity, slack)
        types = [pa.int64()] * 7 + [pa.int32()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def taken() -> pa.RecordBatch:
            rows, bins.rows = bins.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for part in row_slices(batch, 1):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    bins.add(doc, np.array([*encode(text or ""), eos_id], "<u4"))
                if len(bins.rows) >= 4096:
                    yield taken()
        bins.finish()
        if bins.rows:
            yield taken()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pack, SCHEMA)
