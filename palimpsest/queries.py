"""The registered queries of the table engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.predicates import Expr, to_column
from palimpsest.operators.table import Table
from palimpsest.plans.compaction import Leveled
from palimpsest.plans.resolve import resolve
from palimpsest.schema import COMMIT_TS, SEQUENCE, TOMBSTONE, declare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return put


# Version resolution over a log that a table stands for.

_EVENTS = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events{where}) AS v WHERE rn = 1 AND event_type <> 'error'{and_}"


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as upserts and, for errors, deletes of ``user_id``."""
    return _table(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type", "value", F.col("event_id").alias(COMMIT_TS), (F.col("event_type") == "error").alias(TOMBSTONE), F.lit(0).alias(SEQUENCE)
    )


def _events(spark: SparkSession, sf_dir: str, read_ts: int | None = None) -> DataFrame:
    return resolve(_event_log(spark, sf_dir), ["user_id"], read_ts).select("user_id", "event_id", "event_type", "value")


@_register("mvcc_latest", _EVENTS.format(where="", and_=""))
def mvcc_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir)


@_register("mvcc_snapshot_at", _EVENTS.format(where=" WHERE event_id <= 500", and_=""))
def mvcc_snapshot_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, 500)


@_register("mvcc_value_filter_after_resolve", _EVENTS.format(where="", and_=" AND value > 50"))
def mvcc_value_filter_after_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return rows.where(to_column(Expr.gt("value", 50), rows.schema, filtering=True))


@_register("mvcc_key_range_filter", _EVENTS.format(where="", and_=" AND user_id BETWEEN 20 AND 90"))
def mvcc_key_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return rows.where(to_column(Expr.between("user_id", 20, 90), rows.schema))


@_register(
    "mvcc_composite_key",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS rn FROM lineitem) AS v WHERE rn = 1",
)
def mvcc_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    ties = F.struct("l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    log = _table(spark, sf_dir, "lineitem").withColumns({COMMIT_TS: F.col("l_partkey"), TOMBSTONE: F.lit(False), SEQUENCE: ties})
    return resolve(log, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


# Predicates.


def _filtered(name: str, table: str, columns: list[str], expr: Expr, where: str) -> None:
    @_register(name, f"SELECT {', '.join(columns)} FROM {table} WHERE {where}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, table)
        return rows.where(to_column(expr, rows.schema, filtering=True)).select(*columns)


_ORDER = ["o_orderkey", "o_custkey", "o_totalprice"]
_filtered("filter_true", "region", ["r_regionkey"], Expr.true(), "TRUE")
_filtered("filter_false", "region", ["r_regionkey"], Expr.false(), "FALSE")
_filtered("filter_eq", "orders", _ORDER, Expr.eq("o_orderstatus", "F"), "o_orderstatus = 'F'")
_filtered("filter_ne", "orders", _ORDER, Expr.not_eq("o_orderstatus", "F"), "o_orderstatus <> 'F'")
_filtered("filter_lt", "orders", _ORDER, Expr.lt("o_totalprice", 50000.0), "o_totalprice < 50000.0")
_filtered("filter_le", "orders", _ORDER, Expr.lt_eq("o_orderkey", 300), "o_orderkey <= 300")
_filtered("filter_gt", "orders", _ORDER, Expr.gt("o_totalprice", 250000.0), "o_totalprice > 250000.0")
_filtered("filter_ge", "orders", _ORDER, Expr.gt_eq("o_orderkey", 1000), "o_orderkey >= 1000")
_filtered("filter_between_inclusive", "orders", _ORDER, Expr.between("o_orderkey", 100, 200), "o_orderkey BETWEEN 100 AND 200")
_filtered("filter_between_exclusive", "orders", _ORDER, Expr.between("o_orderkey", 100, 200, inclusive=False), "o_orderkey > 100 AND o_orderkey < 200")
_SEGMENT = ["c_custkey", "c_mktsegment"]
_filtered("filter_in", "customer", _SEGMENT, Expr.in_list("c_mktsegment", ["BUILDING", "MACHINERY"]), "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_filtered("filter_in_null", "customer", _SEGMENT, ~Expr.in_list("c_mktsegment", ["BUILDING", None]), "NOT (c_mktsegment IN ('BUILDING', NULL))")
_filtered("filter_in_empty", "customer", _SEGMENT, ~Expr.in_list("c_mktsegment", []), "c_mktsegment IS NOT NULL")
_filtered("filter_starts_with", "part", ["p_partkey", "p_type"], Expr.starts_with("p_type", "S"), "starts_with(p_type, 'S')")
_filtered("filter_not_null", "documents", ["doc_id"], Expr.is_not_null("text"), "text IS NOT NULL")
_filtered("filter_and_or_not", "orders", _ORDER, (Expr.gt("o_totalprice", 100000.0) & ~Expr.eq("o_orderstatus", "O")) | Expr.lt("o_orderkey", 50), "(o_totalprice > 100000.0 AND NOT o_orderstatus = 'O') OR o_orderkey < 50")
_filtered("filter_kleene_not", "orders", _ORDER, Expr.or_(~Expr.eq("o_orderstatus", None), Expr.lt("o_orderkey", 40)), "NOT (o_orderstatus = NULL) OR o_orderkey < 40")
_filtered("filter_int_vs_float_literal", "orders", _ORDER, Expr.gt("o_orderkey", 5.5) & Expr.lt_eq("o_orderkey", 900.0), "o_orderkey > 5.5 AND o_orderkey <= 900.0")
_filtered("filter_type_mismatch", "orders", _ORDER, Expr.or_(Expr.eq("o_orderstatus", 5), Expr.eq("o_orderkey", 7)), "o_orderkey = 7")
_filtered("project_drops_filter_column", "orders", ["o_custkey"], Expr.gt("o_totalprice", 200000.0), "o_totalprice > 200000.0")


@_register("filter_is_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL")
def filter_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id").join(_table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.where(to_column(Expr.is_null("toxic"), rows.schema)).select("doc_id")


# Stored tables.


def _customers(spark: SparkSession, sf_dir: str) -> tuple[Table, DataFrame]:
    rows = _table(spark, sf_dir, "customer")
    table = Table.in_memory(spark, declare(rows.schema, key="c_custkey"), "customer")
    table.ingest(rows)
    return table, rows


_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, {balance} AS c_acctbal, c_mktsegment FROM customer{where}"
_RAISED = "CASE WHEN c_acctbal < 0 THEN c_acctbal + 1000 ELSE c_acctbal END"


def _raised(rows: DataFrame) -> DataFrame:
    return rows.where("c_acctbal < 0").withColumn("c_acctbal", F.col("c_acctbal") + 1000)


@_register("limit_pk_order", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10")
def limit_pk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir)[0].scan().projection(["c_custkey", "c_name"]).limit(10).to_df()


@_register("limit_after_filter", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 ORDER BY c_custkey LIMIT 7")
def limit_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir)[0].scan().filter(Expr.gt("c_acctbal", 5000)).projection(["c_custkey", "c_acctbal"]).limit(7).to_df()


@_register("limit_zero", "SELECT c_custkey FROM customer LIMIT 0")
def limit_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir)[0].scan().projection(["c_custkey"]).limit(0).to_df()


@_register("ingest_upsert_overwrite", _CUSTOMER.format(balance=_RAISED, where=""))
def ingest_upsert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, rows = _customers(spark, sf_dir)
    table.ingest(_raised(rows))
    return table.scan().to_df()


@_register("ingest_tombstones", _CUSTOMER.format(balance=_RAISED, where=" WHERE NOT (c_acctbal < 0 AND c_mktsegment = 'BUILDING')"))
def ingest_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, rows = _customers(spark, sf_dir)
    table.ingest_with_tombstones(_raised(rows), F.col("c_mktsegment") == "BUILDING")
    return table.scan().to_df()


@_register("time_travel", _CUSTOMER.format(balance="c_acctbal", where=""))
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, rows = _customers(spark, sf_dir)
    table.ingest(_raised(rows))
    return table.scan(table.snapshot_at(1)).to_df()


@_register("txn_read_your_writes", _CUSTOMER.format(balance="CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_acctbal END", where=" WHERE c_custkey <> 1"))
def txn_read_your_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, rows = _customers(spark, sf_dir)
    txn = table.begin_transaction()
    txn.upsert_batch(rows.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0)))
    txn.delete(1)
    return txn.scan().to_df()


@_register("txn_commit", _CUSTOMER.format(balance="c_acctbal", where=" WHERE c_custkey NOT IN (1, 2)"))
def txn_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = _customers(spark, sf_dir)
    txn = table.begin_transaction()
    txn.delete(1)
    txn.delete(2)
    txn.commit()
    return table.scan().to_df()


def _compacted(spark: SparkSession, sf_dir: str) -> tuple[Table, DataFrame]:
    """Customers, changed and partly deleted, in small files at level 1."""
    table, rows = _customers(spark, sf_dir)
    table.ingest(_raised(rows))
    table.delete(rows.where("c_custkey % 7 = 0").select("c_custkey"))
    table.strategy = Leveled(base_file_bytes=1 << 13, max_file_bytes=1 << 13)
    table.compact(force=True)
    return table, rows


@_register("compaction_preserves_visible", _CUSTOMER.format(balance=_RAISED, where=" WHERE c_custkey % 7 <> 0"))
def compaction_preserves_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, rows = _customers(spark, sf_dir)
    table.ingest(_raised(rows))
    table.delete(rows.where("c_custkey % 7 = 0").select("c_custkey"))
    table.compact(force=True)
    return table.scan().to_df()


@_register("scan_after_partial_compaction", _CUSTOMER.format(balance="CASE WHEN c_custkey % 11 = 0 THEN 1 WHEN c_acctbal < 0 THEN c_acctbal + 1000 ELSE c_acctbal END", where=" WHERE c_custkey % 11 = 0 OR c_custkey % 7 <> 0"))
def scan_after_partial_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, rows = _compacted(spark, sf_dir)
    table.ingest(rows.where("c_custkey % 11 = 0").withColumn("c_acctbal", F.lit(1.0)))
    return table.scan().to_df()


@_register("key_range_after_compaction", _CUSTOMER.format(balance=_RAISED, where=" WHERE c_custkey % 7 <> 0 AND c_custkey BETWEEN 20 AND 90"))
def key_range_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compacted(spark, sf_dir)[0].scan().filter(Expr.between("c_custkey", 20, 90)).to_df()


@_register("versions_list", "SELECT * FROM (VALUES (1, 1, 1), (2, 2, 2), (2, 3, 1)) AS v(timestamp, version, segment_count)")
def versions_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, rows = _customers(spark, sf_dir)
    table.ingest(_raised(rows))
    table.compact(force=True)
    return table.list_versions().select("timestamp", "version", "segment_count")
