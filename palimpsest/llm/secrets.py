"""Secret scan by assignment-aware lexing.

Source and configuration text is lexed into name-literal pairs: ``name = "literal"``, ``name: value``,
``"name": "value"``, ``name => 'value'`` and ``export NAME=value``. Literals joined by ``+`` and names
of constants assigned earlier in the same text are resolved, so that a literal is charged to every
name that it reaches. A literal counts as a secret if the most sensitive of its target names, weighed
by how little the literal looks like a word or a placeholder, reaches a threshold.

A value is kept as what weighing needs, its length, the counts of its characters and its beginning,
together with references to its literals. Constants can so be passed on at any length, and a text is
lexed in time linear in its own: an operator within a value that another name has already taken gets
the part up to the next such name, and so no character is read more than twice.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._kernel import row_slices

#: Kinds of the base spans, in their order; spans that the lexer adds come last.
KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

_OPERATOR = re.compile(r"(?::=|=>|:|=)(?!=)[ \t]*")
_IN_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_TERM = re.compile(r"""(?:[bruf]{0,2}"((?:[^"\\\n]|\\.)*)"|[bru]?'((?:[^'\\\n]|\\.)*)'|\$\{?([A-Za-z_]\w*)\}?|([^\s,;"'(){}<>\[\]]+))[ \t]*(\+[ \t]*)?""")
#: What an operator within another name's value assigns: a word, without what joins it to the next pair.
_INNER = re.compile(r"""["']?([^\s,;"'(){}<>\[\]&?|]*)""")
_LOWER, _UPPER, _DIGITS = (frozenset(x) for x in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
_PLAIN, _HEX_DIGITS = _LOWER | _UPPER | _DIGITS, frozenset("0123456789abcdef")
_SPLIT_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")

#: How strongly a part of a target name tells that its value is secret (fixed values).
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "secrets": 1.0, "credential": 0.9, "credentials": 0.9,
    "token": 0.9, "bearer": 0.9, "apikey": 1.0, "accesskey": 0.9, "private": 0.8, "key": 0.6, "auth": 0.7, "authorization": 0.7, "signature": 0.6,
    "salt": 0.5, "cookie": 0.5, "session": 0.5, "access": 0.4, "api": 0.4, "client": 0.2, "encryption": 0.5, "signing": 0.5, "webhook": 0.5, "dsn": 0.5,
}
#: Values that stand for a secret without being one (fixed values).
PLACEHOLDERS = {"changeme", "example", "password", "passwd", "secret", "none", "null", "true", "false", "undefined", "todo", "test", "redacted", "your", "xxx", "placeholder"}


def name_weight(name: str) -> float:
    """0 to 1: the chance that some part of the name marks a secret."""
    parts = [p.lower() for p in _SPLIT_NAME.findall(name)]
    miss = 1.0
    for part in dict.fromkeys([*parts, *(a + b for a, b in zip(parts, parts[1:], strict=False))]):
        miss *= 1 - SENSITIVE.get(part, 0)
    return 1 - miss


class Value:
    """A literal, or several joined: length, character counts, the first characters, and a tree of spans."""

    __slots__ = ("length", "counts", "head", "spans")

    HEAD = 64

    def __init__(self, length: int, counts: dict[str, int], head: str, spans: list):
        self.length, self.counts, self.head, self.spans = length, counts, head, spans

    @classmethod
    def literal(cls, text: str, span: tuple[int, int] | None = None) -> Value:
        return cls(len(text), Counter(text), text[: cls.HEAD], [span] if span else [])

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        counts: Counter = Counter()
        for p in parts:
            counts.update(p.counts)
        length = sum(p.length for p in parts)
        while length >> 62:  # a constant that was doubled again and again: shares are all that counts
            counts = {c: n + 1 >> 1 for c, n in counts.items()}
            length = sum(counts.values())
        head = ""
        for p in parts:  # the beginning of a part tells all of it, or enough
            head = (head + p.head)[: cls.HEAD]
            if len(head) == cls.HEAD:
                break
        return cls(length, counts, head, [p.spans for p in parts])

    def weight(self) -> float:
        """0 to 1: how much the value looks like random material of some length."""
        n, seen = self.length, self.counts
        if n < 8 or len(seen) < 4 or any(c.isspace() for c in seen):
            return 0.0
        if n <= self.HEAD and self.head.lower().strip("<>{}[]$%_-. ") in PLACEHOLDERS:
            return 0.0
        if self.head.startswith(("http://", "https://", "/", "./")) and "@" not in seen:
            return 0.2
        bits = -sum(c / n * math.log2(c / n) for c in seen.values())
        kinds = sum(any(test(c) for c in seen) for test in (_LOWER.__contains__, _UPPER.__contains__, _DIGITS.__contains__, lambda c: c not in _PLAIN))
        plain = kinds == 1 and not all(c.isdigit() for c in seen) and not (n >= 16 and seen.keys() <= _HEX_DIGITS)
        return min(1.0, bits / 3.0) * min(1.0, n / 10) * (0.5 if plain else 1.0)


def value_weight(value: str) -> float:
    return Value.literal(value).weight()


def _name_before(text: str, end: int) -> tuple[int, str]:
    """Start and text of the name that ends before an operator at ``end``, a quote and any blanks between; empty if none."""
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "\"'":
        end -= 1
    start = end
    while start and text[start - 1] in _IN_NAME:
        start -= 1
    name = text[start:end]
    return start, name if name and (name[0].isalpha() or name[0] == "_") and not (start and text[start - 1] == "$") else ""


def assignments(text: str) -> Iterator[tuple[str, Value]]:
    """(name, value) of each assignment, with constants propagated, in order."""
    known: dict[str, Value] = {}
    named = [(start, op.end(), name) for op in _OPERATOR.finditer(text) for start, name in (_name_before(text, op.start()),) if name]
    reached = 0
    for i, (_, at, name) in enumerate(named):
        if at < reached:
            begin, until = _INNER.match(text, at, max(at, named[i + 1][0] if i + 1 < len(named) else len(text))).span(1)
            value = Value.literal(text[begin:until], (begin, until)) if until > begin else None
        else:
            parts = []
            while term := _TERM.match(text, at):
                plain = term[1] if term[1] is not None else term[2]
                word = term[3] or term[4]
                if plain is not None:
                    parts.append(Value.literal(plain, term.span(1 if term[1] is not None else 2)))
                elif word in known and _IDENTIFIER.fullmatch(word):
                    parts.append(known[word])
                elif term[4]:
                    parts.append(Value.literal(word, term.span(4)))
                at = term.end()
                if not term[5]:
                    break
            reached = max(reached, at)
            value = Value.joined(parts) if parts else None
        if value and value.length:
            known[name] = value
            if "." in name:
                known[name.rpartition(".")[2]] = value
            yield name, value


def find_secrets(text: str, threshold: float = 0.5) -> tuple[list[tuple[int, int, int]], float]:
    """(start, kind, end) of all spans, sorted, and the highest score of a literal."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    best: set[tuple[int, int]] = set()
    seen: dict[int, list] = {}
    top = 0.0
    if "=" in text or ":" in text:
        for name, value in assignments(text):
            if weight := name_weight(name):
                score = weight * value.weight()
                top = max(top, score)
                if score >= threshold:
                    todo = [value.spans]
                    while todo:
                        node = todo.pop()
                        if isinstance(node, tuple):
                            if node[1] > node[0]:
                                best.add(node)
                        elif id(node) not in seen:
                            seen[id(node)] = node
                            todo += node
    found += [(s, 3, e) for s, e in best]
    return sorted(found), top


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long, top_score double"


def scan_secrets(df: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every text: one row per input row, with offsets in code points, ends exclusive.

    ``spans`` lists kind:start:end by start, then kind, comma-joined: all spans of the kinds assign,
    access and hex (the patterns above) and of kind literal (literals whose target names give them
    a score of ``threshold`` or more). ``base_sha256`` is over the first three kinds alone.

    A null or empty text has no spans; a null id is passed on; repeated rows each give a row; equal
    spans of one kind are listed once. No rows give no rows. Columns other than the two named are
    never read. Texts are handled one at a time, in whole.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 1):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    spans, top = find_secrets(text or "", threshold)
                    said = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in spans]
                    base = ",".join(x for k, x in said if k < 3)
                    n = Counter(k for k, _ in said)
                    rows.append((doc, n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in said), n[3], top))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, SCHEMA)
