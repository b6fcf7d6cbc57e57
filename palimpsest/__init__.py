"""Versioned, primary-keyed tables on Spark.

Callers upsert and delete rows in batches or transactions and read them back as DataFrames, at the
latest state or any retained point in time.
"""

from palimpsest.functions.predicates import Expr
from palimpsest.operators.table import Snapshot, Table
from palimpsest.operators.transaction import Transaction
from palimpsest.plans.resolve import resolve
from palimpsest.schema import SchemaBuilder, TableConfig, declare

__all__ = ["Expr", "SchemaBuilder", "Snapshot", "Table", "TableConfig", "Transaction", "declare", "resolve"]
