"""Write-discipline and delivery audits."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..schemas import TX
from . import chunked
from .routing import touched_rows, touched_tables


@dataclass(frozen=True)
class ForeignKey:
    """``child`` rows belong to the ``root`` row whose key is ``root_pk`` (a SQL expression on the change)."""

    child: str
    root: str
    root_pk: str


def reconcile_tables(seen: DataFrame, expected: DataFrame) -> DataFrame:
    """(schema_name, table_name, side): tables only expected (missing) or only seen (extra)."""
    names = ["schema_name", "table_name"]
    have, want = seen.select(*names).distinct(), expected.select(*names).distinct()
    missing = want.join(have, names, "left_anti").withColumn("side", F.lit("missing"))
    extra = have.join(want, names, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def _children(changes: DataFrame, keys: list[ForeignKey]) -> DataFrame:
    root, root_pk = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in keys:
        mine = F.col("table_name") == k.child
        root, root_pk = F.when(mine, k.root).otherwise(root), F.when(mine, F.expr(k.root_pk)).otherwise(root_pk)
    return (changes.withColumn("root_table", root).withColumn("root_pk", root_pk)
            .filter(F.col("root_table").isNotNull()))


def _roots(changes: DataFrame, keys: list[ForeignKey]) -> DataFrame:
    rows = touched_rows(changes.filter(F.col("table_name").isin(*{k.root for k in keys})))
    return rows.select(*TX, "schema_name", F.col("table_name").alias("root_table"), F.col("pk").alias("root_pk"))


def audit_unanchored(changes: DataFrame, keys: list[ForeignKey]) -> DataFrame:
    """Child changes whose own root is not touched in the same transaction."""
    return _children(changes, keys).join(_roots(changes, keys), [*TX, "schema_name", "root_table", "root_pk"], "left_anti")


def audit_foreign_child(changes: DataFrame, keys: list[ForeignKey]) -> DataFrame:
    """Child changes delivered to another root's subscribers.

    Only a transaction with a single root of the table is delivered, so each child meets
    at most one root: no pairs within a transaction.
    """
    only = (_roots(changes, keys).groupBy(*TX, "schema_name", "root_table")
            .agg(F.count("*").alias("_n"), F.min("root_pk").alias("delivered_to")).filter("_n = 1").drop("_n"))
    return (_children(changes, keys).join(only, [*TX, "schema_name", "root_table"])
            .filter(F.col("root_pk") != F.col("delivered_to")))


def audit_multi_root(changes: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """Transactions touching more than one row of a table, whoever listens."""
    rows = changes if roots is None else changes.filter(F.col("table_name").isin(*roots))
    return touched_tables(touched_rows(rows)).filter("n_roots > 1").drop("multi_root")


def audit_order(received: DataFrame, span: int = chunked.DEFAULT_SPAN) -> DataFrame:
    """Per subscription: events, repeated transactions and steps back in commit order.

    ``received`` has sub_id, a numeric ``arrival``, the transaction key.
    """
    stepped = chunked.previous(received, ["sub_id"], ["arrival"], ["commit_lsn"], "before", span)
    per_tx = stepped.groupBy("sub_id", *TX).agg(
        F.count("*").alias("_n"), F.count(F.when(F.col("before.commit_lsn") > F.col("commit_lsn"), 1)).alias("_back"))
    return per_tx.groupBy("sub_id").agg(
        F.sum("_n").alias("n_events"), F.sum(F.col("_n") - 1).alias("n_duplicates"),
        F.sum("_back").alias("n_order_breaks"))
