"""A closed set of predicates: columns against literals, under three-valued logic.

A predicate becomes one Column. Literals are fitted to the column's own type beforehand, so that the
comparison is exact and Catalyst never casts the column, which would keep it from being pushed down.
"""

from __future__ import annotations

import datetime as dt
import math
import struct
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.errors import NoSuchField, UnsupportedPredicate

_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_NESTED = (T.StructType, T.ArrayType, T.MapType)


class Expr:
    """Base of all predicates, with a constructor for each."""

    @staticmethod
    def true() -> Expr:
        return Constant(True)

    @staticmethod
    def false() -> Expr:
        return Constant(False)

    @staticmethod
    def eq(column: str, value: Any) -> Expr:
        return Cmp("=", column, value)

    @staticmethod
    def not_eq(column: str, value: Any) -> Expr:
        return Cmp("<>", column, value)

    @staticmethod
    def lt(column: str, value: Any) -> Expr:
        return Cmp("<", column, value)

    @staticmethod
    def lt_eq(column: str, value: Any) -> Expr:
        return Cmp("<=", column, value)

    @staticmethod
    def gt(column: str, value: Any) -> Expr:
        return Cmp(">", column, value)

    @staticmethod
    def gt_eq(column: str, value: Any) -> Expr:
        return Cmp(">=", column, value)

    @staticmethod
    def between(column: str, low: Any, high: Any, inclusive: bool = True) -> Expr:
        return Between(column, low, high, inclusive)

    @staticmethod
    def in_list(column: str, values: list) -> Expr:
        return InList(column, tuple(values))

    @staticmethod
    def starts_with(column: str, prefix: str) -> Expr:
        return StartsWith(column, prefix)

    @staticmethod
    def is_null(column: str) -> Expr:
        return IsNull(column)

    @staticmethod
    def is_not_null(column: str) -> Expr:
        return IsNull(column, negated=True)

    @staticmethod
    def and_(*parts: Expr) -> Expr:
        return And(tuple(parts))

    @staticmethod
    def or_(*parts: Expr) -> Expr:
        return Or(tuple(parts))

    @staticmethod
    def not_(part: Expr) -> Expr:
        return Not(part)

    def __and__(self, other: Expr) -> Expr:
        return And((self, other))

    def __or__(self, other: Expr) -> Expr:
        return Or((self, other))

    def __invert__(self) -> Expr:
        return Not(self)

    def columns(self) -> set[str]:
        parts = getattr(self, "parts", None) or ([self.part] if isinstance(self, Not) else [])
        own = {self.column} if hasattr(self, "column") else set()
        return own.union(*[p.columns() for p in parts])


@dataclass(frozen=True)
class Constant(Expr):
    value: bool


@dataclass(frozen=True)
class Cmp(Expr):
    op: str
    column: str
    value: Any


@dataclass(frozen=True)
class Between(Expr):
    column: str
    low: Any
    high: Any
    inclusive: bool = True


@dataclass(frozen=True)
class InList(Expr):
    column: str
    values: tuple


@dataclass(frozen=True)
class StartsWith(Expr):
    column: str
    prefix: str


@dataclass(frozen=True)
class IsNull(Expr):
    column: str
    negated: bool = False


@dataclass(frozen=True)
class And(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Or(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Not(Expr):
    part: Expr


@dataclass(frozen=True)
class BloomFilterEq(Expr):
    column: str
    value: Any


@dataclass(frozen=True)
class BloomFilterInList(Expr):
    column: str
    values: tuple



def _unless_null(col: Column, value: bool) -> Column:
    return F.when(col.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(value))


def _neighbours(value: Fraction | float, kind: T.DataType) -> tuple[Any, Any]:
    """The greatest value of the type that is not above ``value``, and the least not below; None for none."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        single = isinstance(kind, T.FloatType)
        try:
            near = float(value)
            near = struct.unpack("f", struct.pack("f", near))[0] if single else near
        except OverflowError:
            near = math.inf if value > 0 else -math.inf
        if math.isinf(near):
            top = 3.4028234663852886e38 if single else 1.7976931348623157e308
            if isinstance(value, float) and math.isinf(value):
                return near, near
            return (top, math.inf) if near > 0 else (-math.inf, -top)
        if Fraction(near) == value:
            return near, near
        up = Fraction(near) < value
        if single:
            (bits,) = struct.unpack("i", struct.pack("f", near))
            step = (1 if up else -1) * (1 if near > 0 or (near == 0 and up) else -1)
            other = struct.unpack("f", struct.pack("i", bits + step))[0] if near else math.copysign(1.401298464324817e-45, 1 if up else -1)
        else:
            other = math.nextafter(near, math.inf if up else -math.inf)
        return (near, other) if up else (other, near)
    if isinstance(value, float):  # infinite
        low, high = _range(kind)
        return (high, None) if value > 0 else (None, low)
    low, high = _range(kind)
    unit = Fraction(1, 10**kind.scale) if isinstance(kind, T.DecimalType) else Fraction(1)
    floor, ceil = (value // unit) * unit, -((-value) // unit) * unit
    fit = (lambda x: Decimal(x.numerator) / Decimal(x.denominator)) if isinstance(kind, T.DecimalType) else int
    return (None if floor < low else fit(min(floor, Fraction(high)))), (None if ceil > high else fit(max(ceil, Fraction(low))))


def _range(kind: T.DataType) -> tuple[Any, Any]:
    if isinstance(kind, T.DecimalType):
        most = Fraction(10**kind.precision - 1, 10**kind.scale)
        return -most, most
    half = 1 << (_BITS[type(kind)] - 1)
    return -half, half - 1


def _is_number(kind: T.DataType) -> bool:
    return type(kind) in _BITS or isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType))


def compare(col: Column, kind: T.DataType, op: str, value: Any, *, filtering: bool = False) -> Column:
    """``col op value``: unknown for a null on either side, a NaN literal on whole numbers, and types that do not compare.

    A whole number on a column of floats is unknown for a NaN, too. With ``filtering``, false may
    stand for unknown, and the comparison itself remains a conjunct that can be pushed down.
    """
    apply = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    unknown = F.lit(None).cast("boolean")
    if isinstance(kind, _NESTED):
        raise UnsupportedPredicate(f"{kind.simpleString()} cannot be compared with a literal")
    if value is None:
        return unknown
    if hasattr(value, "item") and not isinstance(value, (bytes, str)):
        value = value.item()
    if _is_number(kind):
        if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)):
            return unknown
        floating = isinstance(kind, (T.FloatType, T.DoubleType))
        if isinstance(value, float) and math.isnan(value):
            return apply(col, F.lit(value).cast(kind)) if floating else unknown
        exact = value if isinstance(value, float) and math.isinf(value) else Fraction(value)
        low, high = _neighbours(exact, kind)
        if low is not None and low == high:
            out = apply(col, F.lit(low).cast(kind))
        elif op in ("=", "<>"):
            out = _unless_null(col, op == "<>")
        elif op in ("<", "<="):
            out = _unless_null(col, False) if low is None else col <= F.lit(low).cast(kind)
        else:
            out = _unless_null(col, False) if high is None else col >= F.lit(high).cast(kind)
        if not floating or isinstance(value, float):
            return out
        if filtering:  # NaN is above all numbers for Spark, and equals none
            return out if op in ("=", "<", "<=") else out & ~F.isnan(col)
        return F.when(F.isnan(col), unknown).otherwise(out)
    fits = {
        T.StringType: str, T.BooleanType: bool, T.DateType: dt.date, T.TimestampType: dt.datetime, T.TimestampNTZType: dt.datetime,
    }.get(type(kind))
    if isinstance(kind, T.BinaryType):
        return apply(col, F.lit(bytearray(value))) if isinstance(value, (bytes, bytearray)) else unknown
    if fits is None or not isinstance(value, fits) or (fits is dt.date and isinstance(value, dt.datetime)):
        return unknown
    return apply(col, F.lit(value))


def to_column(expr: Expr, schema: T.StructType, *, filtering: bool = False) -> Column:
    """The predicate over columns of ``schema``; names and types are checked before any plan is built.

    With ``filtering``, the column is only good for ``where``: it may be false instead of unknown.
    """
    types = {f.name: f.dataType for f in schema}

    def field(name: str) -> tuple[Column, T.DataType]:
        if name not in types:
            raise NoSuchField(name)
        return F.col(f"`{name.replace('`', '``')}`"), types[name]

    def build(e: Expr, loose: bool) -> Column:
        match e:
            case Constant(value):
                return F.lit(value)
            case Cmp(op, column, value):
                return compare(*field(column), op, value, filtering=loose)
            case Between(column, low, high, inclusive):
                col, kind = field(column)
                return compare(col, kind, ">=" if inclusive else ">", low, filtering=loose) & compare(col, kind, "<=" if inclusive else "<", high, filtering=loose)
            case InList(column, values):
                return member(*field(column), values, filtering=loose)
            case StartsWith(column, prefix):
                col, kind = field(column)
                if not isinstance(kind, T.StringType) or not isinstance(prefix, str):
                    raise UnsupportedPredicate(f"{column} has no prefixes: it is {kind.simpleString()}")
                return col.startswith(F.lit(prefix))
            case IsNull(column, negated):
                col, _ = field(column)
                return col.isNotNull() if negated else col.isNull()
            case And(parts):
                return reduce(lambda a, b: a & b, [build(p, loose) for p in parts], F.lit(True)) if parts else F.lit(True)
            case Or(parts):
                return reduce(lambda a, b: a | b, [build(p, loose) for p in parts], F.lit(False)) if parts else F.lit(False)
            case Not(part):
                return ~build(part, False)
        raise UnsupportedPredicate(type(e).__name__)

    return build(expr, filtering)


def member(col: Column, kind: T.DataType, values: tuple, *, filtering: bool = False) -> Column:
    """Unknown for a null, even in no values; else true if one is equal, unknown if some are unknown."""
    if isinstance(kind, _NESTED):
        raise UnsupportedPredicate(f"{kind.simpleString()} cannot be compared with a literal")
    plain, unknown = [], False
    for v in values:
        if _is_number(kind) and isinstance(v, (int, Decimal)) and not isinstance(v, bool) and not isinstance(kind, (T.FloatType, T.DoubleType)):
            low, high = _neighbours(Fraction(v), kind)
            if low is not None and low == high:
                plain.append(low)
        elif isinstance(kind, T.StringType) and isinstance(v, str):
            plain.append(v)
        else:
            plain, unknown = None, True
            break
    if plain is None:
        parts = [compare(col, kind, "=", v, filtering=filtering) for v in values]
        return reduce(lambda a, b: a | b, parts)
    if not plain or unknown:
        return _unless_null(col, False)
    return col.isin(plain)


@dataclass(frozen=True)
class Bounds:
    """A closed range that holds all values for which a predicate can be true; None: no bound."""

    low: Any = None
    high: Any = None
    empty: bool = False

    def meets(self, least: Any, most: Any) -> bool:
        """False only if no value from ``least`` to ``most`` can satisfy the predicate."""
        if self.empty:
            return False
        try:
            return not (self.low is not None and most is not None and most < self.low) and not (self.high is not None and least is not None and least > self.high)
        except TypeError:
            return True


def key_bounds(expr: Expr | None, column: str) -> Bounds:
    """Bounds of ``column``: conjunctions intersect, disjunctions span, negations bound nothing."""
    match expr:
        case Constant(False):
            return Bounds(empty=True)
        case Cmp(op, c, v) if c == column and v is not None and v == v:
            return {"=": Bounds(v, v), "<": Bounds(high=v), "<=": Bounds(high=v), ">": Bounds(low=v), ">=": Bounds(low=v)}.get(op, Bounds())
        case Between(c, low, high, _) if c == column and low is not None and high is not None:
            return _checked(Bounds(low, high))
        case InList(c, values) if c == column:
            try:
                some = [v for v in values if v is not None]
                return Bounds(min(some), max(some)) if some else Bounds(empty=True)
            except TypeError:
                return Bounds()
        case StartsWith(c, prefix) if c == column and prefix:
            return Bounds(prefix, prefix + "\U0010ffff" * 4 if prefix else None)
        case And(parts):
            out = Bounds()
            for b in (key_bounds(p, column) for p in parts):
                try:
                    low = b.low if out.low is None else out.low if b.low is None else max(out.low, b.low)
                    high = b.high if out.high is None else out.high if b.high is None else min(out.high, b.high)
                except TypeError:
                    continue
                out = _checked(Bounds(low, high, out.empty or b.empty))
            return out
        case Or(parts):
            some = [b for b in (key_bounds(p, column) for p in parts) if not b.empty]
            if not some:
                return Bounds(empty=True)
            try:
                return Bounds(None if any(b.low is None for b in some) else min(b.low for b in some), None if any(b.high is None for b in some) else max(b.high for b in some))
            except TypeError:
                return Bounds()
    return Bounds()


def _checked(b: Bounds) -> Bounds:
    try:
        return Bounds(b.low, b.high, True) if b.low is not None and b.high is not None and b.low > b.high else b
    except TypeError:
        return Bounds()
