"""Three-valued logic, exact comparison of numbers, and key bounds."""

import math

import pytest
from pyspark.sql import types as T

from palimpsest.errors import NoSuchField, UnsupportedPredicate
from palimpsest.functions.predicates import BloomFilterEq, Bounds, Expr, key_bounds, to_column

SCHEMA = T.StructType([T.StructField("i", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("f", T.FloatType()), T.StructField("a", T.ArrayType(T.StringType()))])


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(9007199254740993, 1, 1.5, "apple", 0.1, []), (9007199254740992, -7, float("nan"), "apricot", 2.0, []), (None, None, None, None, None, None)], SCHEMA)


CASES = [
    (Expr.gt("i", 9007199254740992.0), [True, False, None]),
    (Expr.eq("i", 9007199254740992.0), [False, True, None]),
    (Expr.gt("i", 5.5), [True, True, None]),
    (Expr.eq("i", 5.5), [False, False, None]),
    (Expr.not_eq("i", 5.5), [True, True, None]),
    (Expr.lt("i", math.inf), [True, True, None]),
    (Expr.lt("i", math.nan), [None, None, None]),
    (Expr.lt("n", 10**12), [True, True, None]),
    (Expr.gt_eq("n", 10**12), [False, False, None]),
    (Expr.gt("n", -(10**12)), [True, True, None]),
    (Expr.lt("d", 9007199254740993), [True, None, None]),
    (Expr.eq("f", 0.1), [False, False, None]),
    (Expr.gt("f", 0.1), [True, True, None]),
    (Expr.eq("s", 5), [None, None, None]),
    (Expr.eq("i", "5"), [None, None, None]),
    (Expr.eq("s", None), [None, None, None]),
    (Expr.in_list("s", []), [False, False, None]),
    (~Expr.in_list("s", []), [True, True, None]),
    (Expr.in_list("s", ["apple", None]), [True, None, None]),
    (Expr.in_list("n", [1, 10**12]), [True, False, None]),
    (Expr.starts_with("s", "app"), [True, False, None]),
    (Expr.is_null("s"), [False, False, True]),
    (Expr.is_not_null("s"), [True, True, False]),
    (Expr.and_(), [True, True, True]),
    (Expr.or_(), [False, False, False]),
    (Expr.and_(Expr.false(), Expr.eq("s", None)), [False, False, False]),
    (Expr.or_(Expr.true(), Expr.eq("s", None)), [True, True, True]),
    (~Expr.eq("s", None), [None, None, None]),
    (Expr.between("n", -7, 1), [True, True, None]),
    (Expr.between("n", -7, 1, inclusive=False), [False, False, None]),
]


def test_outcomes(rows):
    got = rows.select(*[to_column(e, SCHEMA).alias(f"c{i}") for i, (e, _) in enumerate(CASES)]).collect()
    for i, (expr, want) in enumerate(CASES):
        assert [r[i] for r in got] == want, expr


def test_errors():
    with pytest.raises(NoSuchField):
        to_column(Expr.eq("x", 1), SCHEMA)
    for bad in (Expr.starts_with("i", "a"), Expr.eq("a", 1), BloomFilterEq("i", 1)):
        with pytest.raises(UnsupportedPredicate):
            to_column(bad, SCHEMA)


def test_bounds():
    assert key_bounds(Expr.gt("i", 3) & Expr.lt("i", 9), "i") == Bounds(3, 9)
    assert key_bounds(Expr.eq("i", 3) | Expr.eq("i", 9), "i") == Bounds(3, 9)
    assert key_bounds(Expr.eq("i", 3) | Expr.eq("s", "x"), "i") == Bounds()
    assert key_bounds(~Expr.eq("i", 3), "i") == Bounds()
    assert key_bounds(Expr.gt("i", 9) & Expr.lt("i", 3), "i").empty
    assert not key_bounds(Expr.starts_with("s", "k1"), "s").meets("k2", "k3")
    assert key_bounds(Expr.starts_with("s", "k1"), "s").meets("k0", "k1zz")


def test_whole_numbers_on_floats_are_pushed(spark, tmp_path):
    spark.createDataFrame([(1.5,), (2.0,), (float("nan"),), (None,), (9007199254740994.0,)], "x double").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    for expr, want in ((Expr.gt("x", 1), [1.5, 2.0, 9007199254740994.0]), (Expr.lt_eq("x", 2), [1.5, 2.0]), (Expr.gt_eq("x", 9007199254740993), [9007199254740994.0]), (Expr.not_eq("x", 2), [1.5, 9007199254740994.0]), (~Expr.lt("x", 2), [2.0, 9007199254740994.0])):
        found = rows.where(to_column(expr, rows.schema, filtering=True))
        assert sorted(r.x for r in found.collect()) == want == sorted(r.x for r in rows.where(to_column(expr, rows.schema)).collect())
    plan = rows.where(to_column(Expr.gt("x", 1), rows.schema, filtering=True))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,1.0)" in plan
