"""A change feed derived from the star-schema test tables.

Orders are root rows and order lines their children; suppliers and customers are the
subscribers; the events table gives call logs, sessions, samples and a user feed. All
frames are plain DataFrames over the parquet files and grow with them.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .functions import rfc3339_utc
from .functions.jsontext import json_quote
from .functions.pgtypes import (BOOL, BYTEA, DATE, FLOAT8, INT4, INT8, INTERVAL, JSONB, NUMERIC,
                                TEXT, TIMESTAMP)
from .schemas import MESSAGES

# fixed values of this workload
LSN_PER_TX = 256
SEQ_PER_ORDER = 100_000
ORDERS_PER_SESSION = 5_000
# message positions are sparse: one piece of the stream covers this many orders
SPAN = 2_000 * SEQ_PER_ORDER
MAX_CHANGES = 10
ORDERS_OID, LINES_OID, AUDIT_LINES_OID, MISSING_OID = 1001, 1002, 1003, 9999
ORDER_COLUMNS = [("id", INT8), ("user_id", INT8), ("total", NUMERIC), ("status", TEXT),
                 ("placed_at", TIMESTAMP), ("priority", TEXT), ("note", TEXT)]
LATE_ORDER_COLUMN = ("channel", TEXT)
LINE_COLUMNS = [("id", TEXT), ("orders_id", INT8), ("sku", TEXT), ("qty", INT4), ("price", NUMERIC),
                ("discount", FLOAT8), ("shipped", BOOL), ("ship_date", DATE), ("tags", 1009),
                ("wait", INTERVAL), ("meta", JSONB), ("blob", BYTEA)]
POLICY_TABLES = {
    # policy -> (first grants, grants after the refresh)
    1: ({"orders": [c for c, _ in ORDER_COLUMNS], "lineitem": [c for c, _ in LINE_COLUMNS]},
        {"orders": ["status"], "lineitem": ["qty"]}),
    2: ({"orders": ["id", "status", "total"]}, {"orders": ["id"]}),
    3: ({"orders": ["id"], "lineitem": ["sku", "qty"]}, {"lineitem": ["qty"]}),
    4: ({"lineitem": ["qty", "price", "discount"]}, {"lineitem": ["id"]}),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tx_id(order: Column) -> Column:
    return F.when(order % 40 == 1, order - 1).otherwise(order)


def _commit_lsn(tx: Column) -> Column:
    return (tx + 1) * LSN_PER_TX


def _commit_ts(tx: Column) -> Column:
    return F.timestamp_micros(F.lit(1704067200000000) + tx * 250000)


def _session(tx: Column) -> Column:
    return F.concat(F.lit("s"), F.floor(tx / ORDERS_PER_SESSION).cast("string"))


def _money(value: Column) -> Column:
    return value.cast("decimal(18,2)").cast("string")


def _order_rows(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("okey"), _tx_id(key).alias("tx_id"), F.lit("public").alias("schema_name"),
        F.lit("orders").alias("table_name"), F.lit(ORDERS_OID).cast("bigint").alias("oid"),
        F.when(F.col("o_orderstatus") == "O", "insert").when(F.col("o_orderstatus") == "P", "update")
        .otherwise("delete").alias("op"),
        key.cast("string").alias("pk"), F.lit("id").alias("pk_col"), F.lit(0).cast("bigint").alias("n"),
        "o_custkey", "o_totalprice", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"),
        "o_orderpriority")


def _line_rows(spark, sf_dir, ranged: bool = False) -> DataFrame:
    """``ranged``: files written from these rows hold stretches of orders, so that readers of a stretch skip the others."""
    line = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    if ranged:
        line = line.repartitionByRange(key)
    within = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    n = F.row_number().over(within).cast("bigint")
    audit = (F.col("l_linestatus") == "F") & (F.col("n") % 5 == 0)
    return line.withColumn("n", n).select(
        key.alias("okey"), _tx_id(key).alias("tx_id"),
        F.when(audit, "audit").otherwise("public").alias("schema_name"), F.lit("lineitem").alias("table_name"),
        F.when(audit, AUDIT_LINES_OID).otherwise(LINES_OID).cast("bigint").alias("oid"),
        F.when(F.col("l_returnflag") == "N", "insert").when(F.col("l_returnflag") == "A", "update")
        .otherwise("delete").alias("op"),
        F.concat_ws("-", key, "n").alias("pk"), F.lit("id").alias("pk_col"), "n",
        "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_shipdate")


def _late(tx: Column) -> Column:
    return tx % ORDERS_PER_SESSION >= ORDERS_PER_SESSION // 2


def _seq() -> Column:
    return F.col("okey") * SEQ_PER_ORDER + 11 + F.col("n")


def _order_text() -> dict[str, Column]:
    return {
        "id": F.col("okey").cast("string"), "user_id": F.col("o_custkey").cast("string"),
        "total": _money(F.col("o_totalprice")), "status": F.col("o_orderstatus"),
        "placed_at": F.col("o_orderdate").cast("string"), "priority": F.col("o_orderpriority"),
        "note": F.when(F.col("okey") % 4 != 0, F.concat(F.lit('say "hi" <'), F.col("o_custkey").cast("string"),
                                                       F.lit("> & co"))),
    }


def _line_text() -> dict[str, Column]:
    return {
        "id": F.col("pk"), "orders_id": F.col("okey").cast("string"),
        "sku": F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")),
        "qty": F.col("l_quantity").cast("bigint").cast("string"), "price": _money(F.col("l_extendedprice")),
        "discount": F.col("l_discount").cast("string"),
        "shipped": F.when(F.col("l_shipdate") < "1998-09-02", "t").otherwise("f"),
        "ship_date": F.date_format("l_shipdate", "yyyy-MM-dd"),
        "tags": F.concat(F.lit("{"), F.col("l_returnflag"), F.lit(',"'), F.col("l_linestatus"),
                         F.lit(', x",NULL}')),
        "wait": F.concat(F.col("n").cast("string"), F.lit(" days 01:30:00")),
        "meta": F.concat(F.lit('{"tax": '), F.col("l_tax").cast("string"), F.lit(', "k": [1, 2]}')),
        "blob": F.concat(F.lit("\\x"), F.lower(F.hex(F.col("l_returnflag")))),
    }


def _quoted(text: Column) -> Column:
    """JSON string of text that is known to need no escapes."""
    return F.concat(F.lit('"'), text, F.lit('"'))


def _order_literals() -> dict[str, Column]:
    t = _order_text()
    out = {k: _quoted(t[k]) for k in ("id", "user_id", "total", "status", "priority")}
    out["placed_at"] = _quoted(rfc3339_utc(F.col("o_orderdate")))
    note = F.concat(F.lit(r'"say \"hi\" \u003c'), F.col("o_custkey").cast("string"), F.lit(r'\u003e \u0026 co"'))
    out["note"] = F.when(t["note"].isNull(), "null").otherwise(note)
    return {k: out[k] for k, _ in ORDER_COLUMNS}


def _line_literals() -> dict[str, Column]:
    t = _line_text()
    out = {k: _quoted(t[k]) for k in ("id", "orders_id", "sku", "price", "ship_date")}
    out["qty"] = t["qty"]
    out["discount"] = F.when(F.col("l_discount") == 0, "0").otherwise(t["discount"])
    out["shipped"] = F.when(t["shipped"] == "t", "true").otherwise("false")
    out["tags"] = F.concat(F.lit('["'), F.col("l_returnflag"), F.lit('","'), F.col("l_linestatus"),
                           F.lit(', x",null]'))
    out["wait"] = F.concat(F.lit('"P'), F.col("n").cast("string"), F.lit('DT1H30M"'))
    out["meta"] = F.concat(F.lit('{"tax":'), F.col("l_tax").cast("string"), F.lit(',"k":[1,2]}'))
    out["blob"] = _quoted(F.base64(F.col("l_returnflag").cast("binary")))
    return {k: out[k] for k, _ in LINE_COLUMNS}


def _untouched() -> Column:
    """Updates of every third order leave the priority out of the log."""
    return (F.col("op") == "update") & (F.col("okey") % 3 == 0)


def _map(values: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed changes, one row per row change; the payload is null for deletes."""
    head = ["okey", "tx_id", "schema_name", "table_name", "op", "pk", "pk_col", "n"]
    orders = _order_rows(spark, sf_dir)
    values = _order_literals() | {"channel": F.lit('"web"')}
    absent = {"priority": _untouched(), "channel": ~_late(F.col("tx_id"))}
    entries = [F.struct(F.when(~absent[k], F.lit(k)).otherwise(None).alias("key") if k in absent
                        else F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()]
    data = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["key"].isNotNull()))
    orders = orders.withColumn("data", F.when(F.col("op") != "delete", data)).select(*head, "data")
    lines = _line_rows(spark, sf_dir)
    lines = lines.withColumn("data", F.when(F.col("op") != "delete", _map(_line_literals()))).select(*head, "data")
    tx = F.col("tx_id")
    return orders.unionByName(lines).select(
        _session(tx).alias("session_id"), "tx_id", _commit_lsn(tx).alias("commit_lsn"),
        _commit_ts(tx).alias("commit_ts"), _seq().alias("seq"), "schema_name", "table_name", "op", "pk", "pk_col",
        "data")


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact subscribers on each customer's lowest order, wildcard ones per supplier."""
    lowest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("okey"))
    exact = lowest.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("sub_id"),
        F.concat(F.lit("u"), (F.col("o_custkey") % 100).cast("string")).alias("user_id"),
        F.lit("exact").alias("kind"), F.lit("public").alias("schema_name"), F.lit("orders").alias("table_name"),
        F.col("okey").cast("string").alias("pk"), (F.col("o_custkey") * 2000).alias("start_lsn"),
        F.col("o_custkey").alias("k"))
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    wildcard = s.select(
        F.concat(F.lit("w"), key.cast("string")).alias("sub_id"),
        F.concat(F.lit("u"), (key % 100).cast("string")).alias("user_id"),
        F.lit("wildcard").alias("kind"), F.lit("public").alias("schema_name"),
        F.when(key % 2 == 0, "orders").otherwise("lineitem").alias("table_name"),
        F.lit(None).cast("string").alias("pk"), (key * 30000).alias("start_lsn"), key.alias("k"))
    both = exact.unionByName(wildcard)
    end = F.when(F.col("k") % 5 == 4, F.col("start_lsn") + 1_000_000)
    return both.select("sub_id", "user_id", "kind", "schema_name", "table_name", "pk", "start_lsn",
                       end.alias("end_lsn"), (F.col("k") % 4 + 1).alias("policy_id"))


def policies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(versions, grants): two versions per policy, the second from half the top position."""
    versions = table(spark, sf_dir, "orders").agg(F.max(_commit_lsn(_tx_id(F.col("o_orderkey")))).alias("top")).select(
        F.explode(F.array(*[F.struct(F.lit(p).cast("bigint").alias("policy_id"), F.lit(v).cast("bigint").alias("version"))
                            for p in POLICY_TABLES for v in (1, 2)])).alias("x"), "top").select(
        "x.policy_id", "x.version",
        F.when(F.col("x.version") == 1, F.lit(-1).cast("bigint")).otherwise(F.expr("top div 2")).alias("refresh_lsn"))
    rows = [(p, v, t, cols) for p, both in POLICY_TABLES.items() for v, tables in enumerate(both, 1)
            for t, cols in tables.items()]
    grants = spark.createDataFrame(rows, "policy_id bigint, version bigint, table_name string, columns array<string>")
    return versions, grants


def _tuple(values: list[tuple[Column, Column | None]]) -> Column:
    """Tuple of (text, kind override) pairs; null text means SQL NULL."""
    fields = []
    for text, unchanged in values:
        kind = F.when(text.isNull(), "n").otherwise("t")
        if unchanged is not None:
            kind, text = F.when(unchanged, "u").otherwise(kind), F.when(~unchanged, text)
        fields.append(F.struct(kind.alias("kind"), text.alias("text")))
    return F.array(*fields)


def _with_texts(rows: DataFrame, texts: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """Texts as columns of their own, so that a tuple's kinds and texts read each instead of making it twice; none for deletes."""
    made = {k: F.col(f"_text_{k}") for k in texts}
    return rows.withColumns({f"_text_{k}": F.when(F.col("op") != "delete", v) for k, v in texts.items()}), made


def _relation(columns) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(o).alias("type_oid"), F.lit(n == "id").alias("is_key"))
                     for n, o in columns])


def messages(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    """The same feed as landed log messages.

    Every session announces its relations, adds a column to orders half-way and sends one
    unusable relation. ``dirty`` adds values of the wrong type, an unknown relation,
    transactions without a commit and changes without a begin.
    """
    nothing = F.array().cast(MESSAGES["new_tuple"].dataType)
    orders, t = _with_texts(_order_rows(spark, sf_dir), _order_text())
    base = [(t[c], _untouched() if c == "priority" else None) for c, _ in ORDER_COLUMNS]
    wide = F.when(_late(F.col("tx_id")), _tuple(base + [(F.lit("web"), None)])).otherwise(_tuple(base))
    key_only = _tuple([(F.col("pk"), None)])
    gone = F.col("op") == "delete"
    orders = orders.withColumn("new_tuple", F.when(~gone, wide)).withColumn("old_tuple", F.when(gone, key_only))
    lines = _line_rows(spark, sf_dir, ranged=True)
    t = _line_text()
    if dirty:
        t["qty"] = F.when(F.col("l_partkey") % 97 == 0, "n/a").otherwise(t["qty"])
        lines = lines.withColumn("oid", F.when(F.col("l_partkey") % 89 == 0, MISSING_OID).otherwise(F.col("oid")))
    lines, t = _with_texts(lines, t)
    lines = (lines.withColumn("new_tuple", F.when(~gone, _tuple([(t[c], None) for c, _ in LINE_COLUMNS])))
             .withColumn("old_tuple", F.when(gone, key_only)))
    cols = ["okey", "tx_id", "oid", "op", "n", "new_tuple", "old_tuple"]
    tx = F.col("tx_id")
    # the lander stamps rows with what their begin announced; without a begin it has nothing
    known = (tx % 50 != 9) if dirty else F.lit(True)
    rows = orders.select(*cols).unionByName(lines.select(*cols)).select(
        _session(tx).alias("session_id"), _seq().alias("seq"), F.col("op").alias("kind"), F.when(known, tx).alias("xid"),
        F.when(known, _commit_lsn(tx)).cast("decimal(20,0)").alias("commit_lsn"),
        F.when(known, _commit_ts(tx)).alias("commit_ts"),
        F.col("oid").alias("relation_oid"), "new_tuple", "old_tuple")

    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("okey"))
    txs = keys.filter("okey % 40 <> 1").select(F.col("okey").alias("tx_id"))
    begins, commits = txs, txs
    if dirty:
        begins, commits = txs.filter("tx_id % 50 <> 9"), txs.filter("tx_id % 50 <> 7")
    first = tx * SEQ_PER_ORDER + 10
    last = tx * SEQ_PER_ORDER + F.when(tx % 40 == 0, 199_999).otherwise(99_999)
    stamps = [_commit_lsn(tx).cast("decimal(20,0)").alias("commit_lsn"), _commit_ts(tx).alias("commit_ts")]
    begin_rows = begins.select(_session(tx).alias("session_id"), first.alias("seq"), F.lit("begin").alias("kind"),
                               tx.alias("xid"), *stamps)
    commit_rows = commits.select(_session(tx).alias("session_id"), last.alias("seq"), F.lit("commit").alias("kind"),
                                 tx.alias("xid"), *stamps)

    sessions = keys.select(F.expr(f"okey div {ORDERS_PER_SESSION}").alias("s")).distinct()
    half, late = ORDERS_PER_SESSION // 2, ORDERS_PER_SESSION * 4 // 5
    composite = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(INT8).alias("type_oid"), F.lit(True).alias("is_key"))
                          for n in ("id", "user_id")])

    def announce(oid, schema, name, columns, order_offset, slot):
        return F.struct(F.lit(oid).cast("bigint").alias("relation_oid"), F.lit(schema).alias("rel_schema"),
                        F.lit(name).alias("rel_table"), columns.alias("rel_columns"),
                        F.lit(order_offset * SEQ_PER_ORDER + slot).cast("bigint").alias("_offset"))

    relations = sessions.select("s", F.explode(F.array(
        announce(ORDERS_OID, "public", "orders", _relation(ORDER_COLUMNS), 0, 0),
        announce(LINES_OID, "public", "lineitem", _relation(LINE_COLUMNS), 0, 1),
        announce(AUDIT_LINES_OID, "audit", "lineitem", _relation(LINE_COLUMNS), 0, 2),
        announce(ORDERS_OID, "public", "orders", _relation(ORDER_COLUMNS + [LATE_ORDER_COLUMN]), half, 0),
        announce(ORDERS_OID, "public", "orders", composite, late, 0))).alias("r")).select(
        F.concat(F.lit("s"), F.col("s").cast("string")).alias("session_id"),
        (F.col("s") * (ORDERS_PER_SESSION * SEQ_PER_ORDER) + F.col("r._offset")).alias("seq"),
        F.lit("relation").alias("kind"), "r.relation_oid", "r.rel_schema", "r.rel_table", "r.rel_columns")

    every = (rows.unionByName(begin_rows, allowMissingColumns=True)
             .unionByName(commit_rows, allowMissingColumns=True)
             .unionByName(relations, allowMissingColumns=True)
             .withColumn("pos", F.col("seq").cast("decimal(20,0)")))
    return every.select(*[F.col(f.name).cast(f.dataType) for f in MESSAGES])


# ---- frames derived from the events table ------------------------------------------

def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of user rows: signup inserts, error deletes, anything else updates."""
    e = events(spark, sf_dir)
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete") \
        .otherwise("update")
    value = F.col("value").cast("decimal(18,2)").cast("string")
    full = F.create_map(F.lit("id"), json_quote(F.col("user_id").cast("string")),
                        F.lit("last"), json_quote(F.col("event_type")),
                        F.lit("score"), F.when(F.col("event_id") % 7 == 0, "null").otherwise(json_quote(value)),
                        F.lit("bonus"), json_quote(value))
    some = F.when((F.col("event_id") % 3 == 0) & (op == "update"),
                  F.map_filter(full, lambda k, v: k != "bonus")).otherwise(full)
    return e.select(
        F.lit("e").alias("session_id"), F.col("event_id").alias("tx_id"),
        _commit_lsn(F.col("event_id")).alias("commit_lsn"), F.col("ts").alias("commit_ts"),
        F.col("event_id").alias("seq"), F.lit("public").alias("schema_name"), F.lit("users").alias("table_name"),
        op.alias("op"), F.col("user_id").cast("string").alias("pk"), F.lit("id").alias("pk_col"),
        F.when(op != "delete", some).alias("data"))


def auth_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        "ts", F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")).alias("backend"),
        F.when(F.col("event_id") % 10 == 0, "_health").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
        .alias("user_id"),
        F.when(F.col("event_id") % 3 == 0, "check").otherwise("refresh").alias("call_kind"),
        F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "signup", 403).otherwise(200)
        .alias("status"),
        F.when((F.col("event_type") == "view") & (F.col("event_id") % 5 == 0), "timeout").alias("error"),
        (F.col("value") / 1000).alias("duration_s"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    reason = (F.when(F.col("event_type") == "error", "slow_consumer").when(F.col("event_type") == "signup", "shutdown")
              .when(F.col("event_type") == "purchase", "tx_too_large").otherwise("client_closed"))
    return e.select(
        F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("sub_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("event_id") % 3 == 0, "wildcard").otherwise("exact").alias("kind"),
        F.col("ts").alias("connected_at"),
        F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 60).cast("bigint") * 1000000)
        .alias("disconnected_at"), reason.alias("reason"))


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter ``events_total`` (set back every 50th sample) and gauge ``load`` per user."""
    e = events(spark, sf_dir)
    instance = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    counter = (F.expr("event_id div 2") % 50 + F.col("user_id") % 3).cast("double")
    both = F.explode(F.array(F.struct(F.lit("events_total").alias("metric"), counter.alias("value")),
                             F.struct(F.lit("load").alias("metric"), F.col("value").alias("value"))))
    return e.select("ts", instance.alias("instance"), both.alias("x")).select(
        "ts", "instance", "x.metric",
        F.create_map(F.lit("kind"), F.lit("user")).alias("labels"), "x.value")


def alert_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample of every alert metric per event, for ten instances."""
    e = events(spark, sf_dir)
    n, v = F.col("event_id"), F.col("value")
    kind = F.col("event_type")
    gauges = {
        "wal_lsn_lag_bytes": v * 400_000, "pg_connection_status": F.when(kind == "error", 0.0).otherwise(1.0),
        "wal_standby_ack_failures_total": F.expr("event_id div 7") % 40,
        "auth_circuit_breaker_state": F.when(kind == "view", 1.0).when(kind == "click", 2.0).otherwise(0.0),
        "auth_breaker_stale_subscribers": n % 3, "subscriber_disconnects_total": n % 200 * 50,
        "tx_dropped_total": F.expr("event_id div 10"), "process_open_fds": v, "process_max_fds": F.lit(300.0),
        "go_memstats_heap_alloc_bytes": v * 1_000_000,
    }
    reasons = {"subscriber_disconnects_total": "slow_consumer", "tx_dropped_total": "multi_root"}
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.create_map(F.lit("reason"), F.lit(reasons.get(m, ""))).alias("labels"),
                              x.cast("double").alias("value")) for m, x in gauges.items()])
    return e.select("ts", F.concat(F.lit("i"), (F.col("user_id") % 10).cast("string")).alias("instance"),
                    F.explode(rows).alias("x")).select("ts", "instance", "x.*")


def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals per subscriber with some repeats and some steps back in commit order."""
    n = F.col("event_id")
    tx = F.when((n % 23 == 0) & (n >= 20), n - 20).when((n % 17 == 0) & (n >= 40), n - 40).otherwise(n)
    return events(spark, sf_dir).select(
        F.concat(F.lit("r"), (n % 20).cast("string")).alias("sub_id"), n.alias("arrival"),
        F.lit("e").alias("session_id"), tx.alias("tx_id"), _commit_lsn(tx).alias("commit_lsn"),
        F.col("ts").alias("received_at"), "value", "event_type")


def drifting_changes(changes: DataFrame) -> DataFrame:
    """The feed with some lines written in the transaction of the order after next."""
    order = F.substring_index("pk", "-", 1).cast("bigint")
    line = F.substring_index("pk", "-", -1).cast("bigint")
    moved = (F.col("table_name") == "lineitem") & (order % 7 == 0) & (line == 3)
    tx = _tx_id(order + 2)
    return (changes.withColumn("_moved", moved)
            .withColumn("tx_id", F.when(F.col("_moved"), tx).otherwise(F.col("tx_id")))
            .withColumn("session_id", _session(F.col("tx_id"))).withColumn("commit_lsn", _commit_lsn(F.col("tx_id")))
            .drop("_moved"))


def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text per customer, some broken, some without a user."""
    k = F.col("c_custkey")
    key = k.cast("string")
    user = F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("u"), key))
    tables = (F.when(k % 3 == 0, '{"orders": ["id", "status"], "lineitem": ["qty"]}')
              .when(k % 3 == 1, '{"orders": ["total"]}').otherwise("{}"))
    first = (F.when(k % 5 == 1, ', "initial_data": null')
             .when(k % 5 == 2, F.concat(F.lit(', "initial_data": {"n" : '), key, F.lit(', "t": [1, "a b"]}')))
             .when(k % 5 == 3, F.concat(F.lit(', "initial_data": "v'), key, F.lit('"')))
             .when(k % 5 == 4, F.concat(F.lit(', "initial_data": ['), key, F.lit(', 1.50]'))).otherwise(""))
    text = F.concat(F.lit('{"user_id": "'), user, F.lit('", "tables": '), tables, F.lit(', "roots": ["x"], "ttl_seconds": '),
                    (k % 7 * 10).cast("string"), first, F.when(k % 11 == 0, "").otherwise("}"))
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("doc"))


def channel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text line per customer: keys, wildcards, comments, blanks and invalid names."""
    k = F.col("c_custkey")
    key = k.cast("string")
    line = (F.when(k % 9 == 0, F.concat(F.lit("# note "), key)).when(k % 9 == 1, "   ")
            .when(k % 9 == 2, F.concat(F.lit("  lineitem/all  "))).when(k % 9 == 3, F.concat(F.lit("Bad-Name/"), key))
            .when(k % 9 == 4, F.concat(F.lit("orders/"), F.repeat(F.lit("x"), 250 + (k % 10).cast("int"))))
            .when(k % 9 == 5, F.lit("orders")).otherwise(F.concat(F.lit("orders/"), key)))
    return table(spark, sf_dir, "customer").select(k.alias("line_no"), line.alias("value"))


def frame_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded frames, one per event: data frames, errors, heartbeats and broken ones."""
    n = F.col("event_id")
    key = n.cast("string")
    text = (F.when(n % 6 == 0, ":").when(n % 6 == 1, F.concat(F.lit("event: tx\nid: "), key))
            .when(n % 6 == 2, F.concat(F.lit(':c\nevent: error\ndata: {"reason":"r'), key, F.lit('"}')))
            .when(n % 6 == 3, F.concat(F.lit("event: tx\nevent: other\ndata:{\"n\":"), key, F.lit("}\ndata: second")))
            .otherwise(F.concat(F.lit("event: tx\nid: "), key, F.lit('\ndata: {"tx_id":'), key, F.lit("}"))))
    return events(spark, sf_dir).select(
        n.alias("frame_no"), F.concat(F.lit("ch"), (F.col("user_id") % 12).cast("string")).alias("channel"), text.alias("value"))


def exposition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric text lines, one per event, labelled and plain, some not finite or malformed."""
    n = F.col("event_id")
    whole = F.floor("value").cast("bigint").cast("string")
    name = F.concat(F.lit("m_"), F.col("event_type"))
    text = (F.when(n % 10 == 0, F.concat(F.lit("# HELP "), name)).when(n % 10 == 1, F.concat(name, F.lit(" NaN")))
            .when(n % 10 == 2, F.concat(name, F.lit('{le="+Inf"} +Inf'))).when(n % 10 == 3, F.concat(name, F.lit(" ++.e")))
            .when(n % 10 == 4, F.concat(name, F.lit("  "), whole, F.lit(" 1640000000000")))
            .when(n % 10 == 5, F.concat(name, F.lit(" "), whole, F.lit("e1")))
            .otherwise(F.concat(name, F.lit('{type="a",b="c d"} '), whole)))
    return events(spark, sf_dir).select(n.alias("line_no"), text.alias("value"))


def position_series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(current, confirmed) positions as ``X/Y`` text per session."""
    from .functions import lsn_text
    n = F.col("event_id")
    at = F.when(n % 2 == 0, n + 3).otherwise(n).cast("decimal(20,0)") * F.lit(3_000_000_000).cast("decimal(20,0)")
    rows = events(spark, sf_dir).select(
        F.concat(F.lit("p"), (F.col("user_id") % 8).cast("string")).alias("session_id"), "ts", "event_id",
        lsn_text(at).alias("lsn_text"))
    return rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")


def refresh_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refresh outcomes per subscription of some customers."""
    k = F.col("o_custkey")
    status = F.when(k % 6 == 0, 403).when(k % 6 == 1, 503).otherwise(200)
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), k.cast("string")).alias("sub_id"), (F.col("o_orderkey") * 250).alias("lsn"),
        F.concat(F.lit("b"), (F.col("o_orderkey") % 4).cast("string")).alias("backend"), status.alias("status"), F.lit(None).cast("string").alias("error"), (F.col("o_orderkey") % 2 == 0).alias("exhausted"))


def open_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of positions in which each of four backends has its breaker open; the last ones stay open."""
    start = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 800").alias("x")).distinct()
    top = start.agg(F.max("x")).scalar()
    from_lsn = F.col("x") * 200_000 + F.col("b") * 10_000
    return start.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        F.concat(F.lit("b"), F.col("b").cast("string")).alias("backend"), from_lsn.alias("from_lsn"),
        F.when(F.col("x") < top, from_lsn + 60_000).alias("to_lsn"))
