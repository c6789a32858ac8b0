"""Registered queries: every operator over the test tables, flattened to scalar columns."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import workload as W
from .functions import lsn_parse
from .operators import (audit as A, changes as C, chunked, delivery as D, metrics as X, mirror as M,
                        rollups as U, routing as R)
from .plans import fanout
from .schemas import TX
from .session import configure, fresh_path, stage
from .sources import (assign_channels, parse_channels, parse_frames, parse_metrics_text, parse_policies,
                      read_dispatch, read_messages, stream_messages, valid_channels, write_deliveries, write_dispatch)
from .streaming import jobs as S, route as T
from .streaming.assemble import read_transactions, stream_transactions as stream_tx_job
from .streaming.carry import Carry
from .streaming.breaker import BreakerConfig, breaker_states, read_timeline, stream_breaker as stream_breaker_job

LSN_SPAN = 1 << 18
REGISTRY = {}
_LANDED = {}


def query(fn):
    """Register under the function name without its trailing underscore."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)
    REGISTRY[fn.__name__.rstrip("_")] = run
    return run


def landed(spark, d, name, build) -> DataFrame:
    """A derived feed, written once per session and read from there like any landed table."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _LANDED:
        _LANDED[key] = stage(build(spark, d), name)
    return _LANDED[key]


def changes_of(spark, d) -> DataFrame:
    return landed(spark, d, "changes", W.changes)


def heads_of(spark, d) -> DataFrame:
    """All rows of ``changes_of`` with the ``names`` of what updates hold instead of the payload, for queries that read no value."""
    return landed(spark, d, "heads", lambda s, p: W.changes(s, p).withColumn("names", R.update_names()).drop("data"))


def subs_of(spark, d) -> DataFrame:
    return landed(spark, d, "subs", W.subscriptions)


def big(name: str, alias: str | None = None):
    return F.col(name).cast("bigint").alias(alias or name)


def big_sum(name: str):
    return F.sum(name).cast("bigint").alias(name)


def routed(spark, d, **options) -> fanout.Routed:
    versions, grants = W.policies(spark, d)
    return fanout.route(heads_of(spark, d), subs_of(spark, d), versions, grants,
                        max_changes=W.MAX_CHANGES, **options)


# ---- matching and routing ----------------------------------------------------------

@query
def outcome_counts(spark, d):
    weights = fanout.outcome_weights(fanout.weighted_classes(routed(spark, d), LSN_SPAN))
    return weights.groupBy("kind", "outcome").agg(
        F.sum("n_pairs").cast("bigint").alias("n_pairs"), F.sum("n_delivered").cast("bigint").alias("n_delivered"))


@query
def outcomes_by_sub(spark, d):
    return fanout.outcome_totals(routed(spark, d), LSN_SPAN)


@query
def fan_out_work(spark, d):
    weights = fanout.outcome_weights(fanout.weighted_classes(routed(spark, d), LSN_SPAN))
    return (weights.groupBy("tx_id").agg(F.sum("n_delivered").cast("bigint").alias("work"))
            .filter("work > 0"))


@query
def beyond_anchor(spark, d):
    weights = fanout.outcome_weights(fanout.weighted_classes(routed(spark, d), LSN_SPAN))
    return weights.groupBy("kind", "table_name").agg(
        F.sum("n_beyond_anchor").cast("bigint").alias("n_beyond_anchor"))


@query
def terminate(spark, d):
    return routed(spark, d).subs.filter("violation_lsn is not null").select(
        "sub_id", "kind", big("violation_lsn"))


@query
def match_exact(spark, d):
    touched = R.touched_rows(changes_of(spark, d))
    return R.match_exact(touched, subs_of(spark, d)).select("tx_id", "sub_id", "table_name", "pk")


@query
def match_wildcard(spark, d):
    tables = R.touched_tables(R.touched_rows(heads_of(spark, d)))
    return R.wildcard_totals(tables, subs_of(spark, d))


@query
def match_live(spark, d):
    return R.live_totals(heads_of(spark, d), subs_of(spark, d), LSN_SPAN)


@query
def eligible(spark, d):
    touched = R.touched_rows(changes_of(spark, d))
    found = U.fan_out(touched, R.touched_tables(touched), subs_of(spark, d), LSN_SPAN).filter("n_subs > 0")
    return found.select("tx_id", big("n_subs", "n_pairs"), big("n_exact"))


@query
def start_cutoff(spark, d):
    return R.start_totals(heads_of(spark, d), subs_of(spark, d), LSN_SPAN)


@query
def schema_scope(spark, d):
    changes = changes_of(spark, d)
    pairs = R.match_exact(R.touched_rows(changes), subs_of(spark, d))
    own = pairs.select(*TX, "sub_id", F.col("schema_name").alias("sub_schema"))
    rows = changes.join(own, TX)
    same = R.same_schema(F.col("schema_name"), F.col("sub_schema"))
    return rows.groupBy("tx_id", "sub_id").agg(F.count(F.when(same, 1)).alias("n_inside"),
                                               F.count(F.when(~same, 1)).alias("n_outside"))


@query
def co_tx(spark, d):
    changes = changes_of(spark, d)
    pairs = R.match_exact(R.touched_rows(changes), subs_of(spark, d))
    live = pairs.filter(R.live_at(F.col("commit_lsn"), F.col("start_lsn"), F.col("end_lsn")))
    return R.expand_tx(live, changes).select("sub_id", "tx_id", "seq", "op", "table_name", "pk", "anchor")


@query
def multi_root(spark, d):
    return R.multi_root(changes_of(spark, d)).select(
        "tx_id", "schema_name", "table_name", big("n"), "n_roots", "multi_root")


@query
def whitelist(spark, d):
    versions, grants = W.policies(spark, d)
    every = F.explode(F.array(*[F.lit(p).cast("bigint") for p in W.POLICY_TABLES]))
    rows = R.policy_asof(changes_of(spark, d).withColumn("policy_id", every), versions)
    kept = R.apply_whitelist(rows, grants)
    cells = kept.select("policy_id", "version", "table_name", "op", F.explode_outer("data").alias("col", "value"))
    return cells.groupBy("policy_id", "version", "table_name", "op", "col").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query
def policy_asof(spark, d):
    versions, _ = W.policies(spark, d)
    rows = subs_of(spark, d).select("sub_id", "policy_id", F.col("start_lsn").alias("commit_lsn"))
    rows = rows.withColumn("session_id", F.lit("s")).withColumn("tx_id", F.col("commit_lsn"))
    return R.policy_asof(rows, versions).select("sub_id", "policy_id", "version", "commit_lsn")


@query
def anchor_survives(spark, d):
    versions, grants = W.policies(spark, d)
    changes, subs = heads_of(spark, d), subs_of(spark, d)
    followed = fanout.followed_rows(changes, subs)
    matched = fanout.match_classes(changes, subs, versions, followed)
    return (fanout.count_kept(changes, matched, grants, followed).filter("live and not multi_root")
            .select("tx_id", "kind", "table_name", "pk", "policy_id", "version", big("n_anchor"), big("n_kept")))


def digest(*cols):
    """One row's part in ``checksum``."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in map(_col, cols)])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def checksum(*cols):
    """Order-free content check that any SQL engine can repeat."""
    return F.sum(digest(*cols)).cast("bigint").alias("checksum")


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def messages_of(spark, d, dirty=False):
    name = "messages_dirty" if dirty else "messages"
    return landed(spark, d, name, lambda s, p: W.messages(s, p, dirty))


def users_of(spark, d):
    return landed(spark, d, "users", W.user_changes)


# ---- messages to changes -----------------------------------------------------------

@query
def src_messages(spark, d):
    path = fresh_path(spark, "log")
    W.messages(spark, d).write.parquet(path)
    return read_messages(spark, path).groupBy("session_id", "kind").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.sum(F.when(F.col("kind").isin("begin", "commit"), F.col("xid"))).alias("xid_sum"))


@query
def scope_filter(spark, d):
    tables = spark.createDataFrame([("public", "orders"), ("audit", "lineitem")], "schema_name string, table_name string")
    return C.publication_scope(changes_of(spark, d), tables, ["insert", "delete"]).groupBy(
        "schema_name", "table_name", "op").agg(F.count("*").alias("n"), checksum("pk"))


@query
def relation_valid(spark, d):
    good, bad = C.valid_relations(messages_of(spark, d))
    rows = good.withColumn("reason", F.lit("")).unionByName(bad)
    return rows.select("session_id", "seq", "rel_schema", "rel_table", F.size("rel_columns").cast("bigint").alias("n_columns"),
                       "reason")


@query
def relation_asof(spark, d):
    m = messages_of(spark, d)
    rows = C.relation_asof(m, C.valid_relations(m)[0], W.SPAN)
    return rows.groupBy("session_id", "relation_oid", F.size("rel.rel_columns").cast("bigint").alias("n_columns")).agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def typed_of(spark, d, dirty=False):
    name = "typed_dirty" if dirty else "typed"

    def build(s, p):
        m = messages_of(s, p, dirty)
        return C.type_changes(m, C.valid_relations(m)[0], W.SPAN)[0]
    return landed(spark, d, name, build)


@query
def type_changes(spark, d):
    cells = typed_of(spark, d).select("schema_name", "table_name", "op", "seq", F.explode("data").alias("col", "value"))
    # least and greatest texts are found by sorting: the key that tells most cells apart comes first
    found = cells.groupBy("col", "op", "table_name", "schema_name").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), checksum("seq", "value"))
    return found.select("schema_name", "table_name", "op", "col", "n", "low", "high", "checksum")


@query
def pk_extract(spark, d):
    return typed_of(spark, d).groupBy("schema_name", "table_name", "op", "pk_col").agg(
        F.count("*").alias("n"), checksum("seq", "pk"))


@query
def absent_null(spark, d):
    rows = typed_of(spark, d).filter("op <> 'delete' and table_name = 'orders'")
    names = F.array(*[F.lit(c) for c, _ in W.ORDER_COLUMNS + [W.LATE_ORDER_COLUMN]])
    state = F.when(~F.map_contains_key(F.col("data"), F.col("col")), "absent").when(
        F.col("data")[F.col("col")] == "null", "null").otherwise("value")
    return rows.withColumn("col", F.explode(names)).withColumn("state", state).groupBy("op", "col", "state").agg(
        F.count("*").alias("n"), checksum("seq"))


@query
def assemble_tx(spark, d):
    m = messages_of(spark, d, dirty=True)
    transactions, _ = C.assemble_transactions(m, typed_of(spark, d, dirty=True), W.SPAN)
    return transactions.select("session_id", "tx_id", big("commit_lsn"), "commit_ts", big("n_changes"))


@query
def change_order(spark, d):
    return C.change_order(changes_of(spark, d), span=W.SPAN).select("tx_id", "seq", "change_seq")


@query
def quarantine(spark, d):
    good, rejects = C.quarantine(messages_of(spark, d, dirty=True), W.SPAN)
    kept = good.select(F.lit("").alias("reason"), F.col("op").alias("kind"), "seq")
    return kept.unionByName(rejects.select("reason", "kind", "seq")).groupBy("reason", "kind").agg(
        F.count("*").alias("n"), checksum("seq"))


# ---- loaders -----------------------------------------------------------------------

@query
def policy_load(spark, d):
    docs, grants, rejects = parse_policies(W.policy_documents(spark, d))
    sizes = grants.groupBy("doc_id").agg(F.count("*").alias("n_tables"), F.sum(F.size("columns")).alias("n_columns"))
    good = docs.join(sizes, "doc_id", "left").select(
        "doc_id", F.lit("ok").alias("state"), "user_id", big("ttl_seconds"),
        F.coalesce("n_tables", F.lit(0)).cast("bigint").alias("n_tables"),
        F.coalesce("n_columns", F.lit(0)).cast("bigint").alias("n_columns"))
    return good.unionByName(rejects.select("doc_id", F.col("reason").alias("state")), allowMissingColumns=True)


@query
def channel_load(spark, d):
    return parse_channels(W.channel_lines(spark, d)).select("line_no", "table_name", "kind", "pk", "channel")


@query
def channel_valid(spark, d):
    good, bad = valid_channels(parse_channels(W.channel_lines(spark, d)))
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False))).select(
        "line_no", "channel", "ok")


@query
def channel_assign(spark, d):
    good, _ = valid_channels(parse_channels(W.channel_lines(spark, d)))
    slots = chunked.row_numbers(good, [], ["line_no"], "slot").withColumn("slot", F.col("slot") - 1)
    subscribers = W.table(spark, d, "supplier").select(F.col("s_suppkey").alias("number"))
    return assign_channels(subscribers, slots).select("number", "channel")


@query
def frame_parse(spark, d):
    return parse_frames(W.frame_texts(spark, d)).select("frame_no", "event", "data", "id")


@query
def metrics_parse(spark, d):
    return parse_metrics_text(W.exposition_lines(spark, d))


@query
def initial_events(spark, d):
    docs, _, _ = parse_policies(W.policy_documents(spark, d))
    return D.initial_events(subs_of(spark, d), docs)


@query
def terminal_events(spark, d):
    endings = W.sessions(spark, d).select(F.col("user_id").alias("sub_id"), F.col("disconnected_at").alias("at"), "reason")
    return D.terminal_events(endings)


# ---- delivery ----------------------------------------------------------------------

@query
def encode_events(spark, d):
    changes, caps = changes_of(spark, d), (["schema_name"], W.MAX_CHANGES)
    encoded = D.encode(changes, *caps)
    events = encoded.events().select(
        "tx_id", "schema_name", "frame_bytes", F.md5("payload").alias("payload_md5"), F.lit(None).cast("string").alias("reason"))
    rejected = encoded.rejected().select(
        "tx_id", "schema_name", "frame_bytes", F.lit(None).cast("string").alias("payload_md5"), "reason")
    return events.unionByName(rejected)


@query
def payload_cap(spark, d):
    sizes = D.payload_cap(D.payload_sizes(changes_of(spark, d), ["schema_name"]), max_bytes=1500)
    return sizes.groupBy("schema_name", "over_cap").agg(
        F.count("*").alias("n"), F.sum("frame_bytes").cast("bigint").alias("frame_bytes"),
        F.sum("n_changes").cast("bigint").alias("n_changes"))


def exact_deliveries(spark, d):
    """Events of the row-level subscriptions, from the whole routing plan."""
    versions, grants = W.policies(spark, d)
    changes, subs = changes_of(spark, d), subs_of(spark, d).filter("kind = 'exact'")
    return fanout.deliver(changes, subs, versions, grants, W.MAX_CHANGES)


@query
def sink_roundtrip(spark, d):
    path = fresh_path(spark, "deliveries")
    write_deliveries(exact_deliveries(spark, d), path)
    return spark.read.parquet(path).select("sub_id", "tx_id", "frame_bytes", F.md5("payload").alias("payload_md5"))


def event_totals(received):
    """Per subscription what it was sent: events, bytes and their content."""
    return received.groupBy("sub_id").agg(F.count("*").alias("n_events"), F.sum("frame_bytes").cast("bigint").alias("frame_bytes"),
                                          F.sum("digest").cast("bigint").alias("checksum"))


def _digested(events):
    """What ``event_totals`` reads of an event, the same for all who get it."""
    return events.withColumn("digest", digest("tx_id", F.md5("payload"))).drop("payload")


@query
def sink_all(spark, d):
    """Events of all subscriptions, row-level and table-level, written with each payload once and read back."""
    versions, grants = W.policies(spark, d)
    sent = fanout.dispatch(changes_of(spark, d), subs_of(spark, d), versions, grants, W.MAX_CHANGES)
    path = fresh_path(spark, "dispatch")
    write_dispatch(sent.logs(), sent.stretches(), sent.events, path)
    return event_totals(read_dispatch(spark, path, view=_digested))


@query
def co_tx_all(spark, d):
    """What ``co_tx`` gives, for all subscriptions, counted."""
    return R.change_totals(heads_of(spark, d), subs_of(spark, d), LSN_SPAN)


# ---- mirrors -----------------------------------------------------------------------

@query
def mirror(spark, d):
    rows = users_of(spark, d).unionByName(changes_of(spark, d))
    return M.build_mirror(rows).groupBy("schema_name", "table_name", "col").agg(
        F.count("*").alias("n"), checksum("pk", "value"))


@query
def mirror_reset(spark, d):
    sub = F.concat(F.lit("m"), (F.col("pk").cast("bigint") % 6).cast("string"))
    rows = users_of(spark, d).withColumn("sub_id", sub)
    resets = rows.filter("tx_id % 50 = 0").select("sub_id", "commit_lsn")
    return M.build_mirror(M.reset_on_error(rows, resets), ["sub_id"]).select("sub_id", "pk", "col", "value")


@query
def snapshot_delta(spark, d):
    rows = users_of(spark, d)
    cut = rows.agg(F.expr("max(commit_lsn) div 2")).scalar()
    base = M.build_mirror(rows.filter(F.col("commit_lsn") <= cut))
    return M.snapshot_delta(base.withColumn("snapshot_lsn", cut), rows).select("pk", "col", "value")


@query
def entity_view(spark, d):
    view = M.entity_view(M.mirror_rows(changes_of(spark, d)), "orders", {"lineitem": "orders_id"})
    return view.groupBy("root_pk").agg(F.count("*").alias("n_cells"), checksum("table_name", "pk", "col", "value"))


@query
def entity_tree(spark, d):
    """Users with their orders and the lines of those."""
    rows = users_of(spark, d).unionByName(changes_of(spark, d))
    view = M.entity_view(M.mirror_rows(rows), "users", {"orders": ("user_id", "users"), "lineitem": ("orders_id", "orders")})
    return view.groupBy("root_pk").agg(F.count("*").alias("n_cells"), checksum("table_name", "pk", "col", "value"))


@query
def field_diff(spark, d):
    return M.field_diff(users_of(spark, d), LSN_SPAN).select("seq", "pk", "col", "old", "value")


# ---- audits ------------------------------------------------------------------------

LINE_TO_ORDER = [A.ForeignKey("lineitem", "orders", "substring_index(pk, '-', 1)")]


@query
def reconcile_tables(spark, d):
    expected = spark.createDataFrame([("public", "orders"), ("public", "lineitem"), ("public", "customer")],
                                     "schema_name string, table_name string")
    return A.reconcile_tables(changes_of(spark, d), expected)


@query
def audit_unanchored(spark, d):
    return A.audit_unanchored(W.drifting_changes(changes_of(spark, d)), LINE_TO_ORDER).select(
        "tx_id", "schema_name", "pk", "root_pk")


@query
def audit_foreign_child(spark, d):
    return A.audit_foreign_child(W.drifting_changes(changes_of(spark, d)), LINE_TO_ORDER).select(
        "tx_id", "pk", "root_pk", "delivered_to")


@query
def audit_multi_root(spark, d):
    return A.audit_multi_root(changes_of(spark, d), ["orders"]).select("tx_id", "table_name", "n_roots", big("n"))


@query
def audit_order(spark, d):
    return A.audit_order(W.received(spark, d), 4096).select(
        "sub_id", big("n_events"), big("n_duplicates"), big("n_order_breaks"))


# ---- rollups -----------------------------------------------------------------------

@query
def fan_out(spark, d):
    touched = R.touched_rows(changes_of(spark, d))
    return U.fan_out(touched, R.touched_tables(touched), subs_of(spark, d), LSN_SPAN).select("tx_id", big("n_subs"))


def _le_text():
    return F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("bigint").cast("string")).alias("le")


@query
def histogram(spark, d):
    sizes = changes_of(spark, d).groupBy(*TX).agg(F.count("*").alias("n_changes"))
    return U.histogram(sizes, F.col("n_changes"), ["session_id"], U.TX_SIZE_BOUNDS).select(
        "session_id", _le_text(), "n", "total")


@query
def hist_quantile(spark, d):
    buckets = U.histogram(W.sessions(spark, d), U.lifetime_s(), ["kind"], U.LIFETIME_BOUNDS)
    rows = U.histogram_quantile(buckets, 0.5, ["kind"]).withColumn("q", F.lit("0.5")).unionByName(
        U.histogram_quantile(buckets, 0.99, ["kind"]).withColumn("q", F.lit("0.99")))
    return rows.select("kind", "q", F.round("value", 6).alias("value"))


@query
def active_subs(spark, d):
    return U.active_subs(W.sessions(spark, d), F.lit("2024-01-15 12:00:00").cast("timestamp"))


@query
def auth_results(spark, d):
    return U.auth_results(W.auth_calls(spark, d), ["backend", "call_kind"])


@query
def delivery_lag(spark, d):
    lag = F.round(F.col("value") * 1000).cast("bigint")
    return U.delivery_lag(W.received(spark, d), ["event_type"], [0.5, 0.95, 0.99], lag, 1 << 16).select(
        "event_type", F.col("q").cast("string").alias("q"), "lag")


@query
def events_by_channel(spark, d):
    return U.events_by_channel(parse_frames(W.frame_texts(spark, d)), ["channel", "event"])


@query
def session_stats(spark, d):
    return U.session_stats(W.sessions(spark, d)).select(
        "reason", "n", *[F.round(c, 4).alias(c) for c in ("mean_s", "min_s", "max_s")])


@query
def session_percentiles(spark, d):
    """p50, p95 and p99 of session lengths from merged daily sketches, with whether the sessions themselves
    place each value at its rank, within the sketches' error."""
    sessions = W.sessions(spark, d)
    days = stage(U.session_sketches(sessions), "sketches")
    found = U.merged_percentiles(days, ["reason"], [0.5, 0.95, 0.99])
    length = sessions.select("reason", U.lifetime_s().alias("s"))
    ranks = length.join(F.broadcast(found), "reason").groupBy("reason", "q", "n", "value").agg(
        F.count(F.when(F.col("s") < F.col("value"), 1)).alias("below"), F.count(F.when(F.col("s") <= F.col("value"), 1)).alias("upto"))
    slack = F.lit(U.RANK_ERROR) * F.col("n") + 1
    near = (F.col("below") <= F.col("q") * F.col("n") + slack) & (F.col("upto") >= F.col("q") * F.col("n") - slack)
    return ranks.select("reason", F.col("q").cast("string").alias("q"), "n", near.alias("within_error"))


@query
def feed_topn(spark, d):
    rows = users_of(spark, d).withColumn("channel", F.concat(F.lit("users:"), (F.col("pk").cast("bigint") % 12).cast("string")))
    return U.feed_topn(rows, ["channel"], ["commit_lsn", "seq"]).select("channel", "tx_id", big("place"), big("n_left_out"))


@query
def export_sorted(spark, d):
    return U.export_sorted(changes_of(spark, d)).select("commit_lsn", "seq", "table_name", "op", "pk")


# ---- time series -------------------------------------------------------------------

@query
def concurrency(spark, d):
    return X.concurrency(W.sessions(spark, d), ["user_id"], 2).select(
        "user_id", big("peak"), F.round("over_cap_s", 3).alias("over_cap_s"))


@query
def concurrency_overall(spark, d):
    return X.concurrency_overall(W.sessions(spark, d), 50).select("bucket_start", big("level"), "over_cap")


@query
def counter_rate(spark, d):
    samples = W.metric_samples(spark, d).filter("metric = 'events_total'")
    keys = ["metric", "instance"]
    rows = X.counter_rate(samples, keys, 432_000, "increase").withColumnRenamed("result", "increase")
    rows = X.counter_rate(rows, keys, 432_000, "slope").withColumnRenamed("result", "slope")
    return rows.select("instance", "ts", "increase", F.round(F.col("slope") * 1e6, 4).alias("slope_u"))


@query
def alert_episodes(spark, d):
    samples = landed(spark, d, "samples", W.alert_samples)
    return X.alert_episodes(samples, X.RULES, 3600).select(
        "rule", "instance", "started_at", "ended_at", "n_samples")


@query
def failure_rate(spark, d):
    return X.failure_rate(W.auth_calls(spark, d), 3600).select(
        "backend", "bucket", big("window_failures"), big("window_total"), F.round("rate", 6).alias("rate"))


@query
def stale(spark, d):
    ttl = (F.col("user_id") % 20 + 1) * 3600
    at = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return X.stale(W.events(spark, d), ["user_id"], at, ttl).select(
        "user_id", "last_at", big("ttl_s"), F.round("age_s", 3).alias("age_s"))


@query
def lsn_lag(spark, d):
    current, confirmed = (s.withColumn("lsn", lsn_parse(F.col("lsn_text"))) for s in W.position_series(spark, d))
    return X.lsn_lag(current, confirmed).select("session_id", "ts", big("lag_bytes"))


@query
def steady_rate(spark, d):
    samples = W.alert_samples(spark, d).filter("metric = 'tx_dropped_total'")
    runs = samples.select("instance").distinct().select(
        "instance", F.lit("2024-01-02 00:00:00").cast("timestamp").alias("started_at"),
        F.lit(432_000).alias("warmup_s"), F.lit(1_728_000).alias("duration_s"))
    return X.steady_rate(samples, runs).select(
        "instance", F.round(F.col("per_s") * 1e6, 4).alias("per_ms"), F.round(F.col("floor_per_s") * 1e6, 4).alias("floor_ms"))


@query
def revocation(spark, d):
    versions, grants = W.policies(spark, d)
    cut = X.revocation_cutoff(subs_of(spark, d), versions, grants, W.refresh_calls(spark, d))
    return cut.select("sub_id", big("end_lsn"), "reason")


@query
def revocation_routing(spark, d):
    """Outcomes of the routing plan when permission refreshes end subscriptions, the breaker considered."""
    versions, grants = W.policies(spark, d)
    cut = X.revocation_cutoff(subs_of(spark, d), versions, grants, W.refresh_calls(spark, d), W.open_spans(spark, d), LSN_SPAN)
    routed = fanout.route(changes_of(spark, d), stage(cut.drop("reason"), "revoked"), versions, grants, max_changes=W.MAX_CHANGES)
    return fanout.outcome_totals(routed, LSN_SPAN)


# ---- permission backend and streams ------------------------------------------------

BREAKER = BreakerConfig(bucket_s=3600, floor=20, threshold=0.25, cooldown_s=7200)


@query
def breaker_timeline(spark, d):
    return breaker_states(W.auth_calls(spark, d), BREAKER).select("backend", "at", "state", "label")


def _replayed(frames, path, writer):
    """Land frames one after the other, each in parallel; after each the stream goes on from its checkpoint."""
    checkpoint = fresh_path(frames[0].sparkSession, "chk")
    for frame in frames:
        frame.write.mode("append").parquet(path)
        S.run(writer(path), checkpoint)


def _files(out):
    return lambda stream: stream.writeStream.format("parquet").option("path", out)


def _thirds(df, col):
    low, top = df.agg(F.min(col), F.max(col)).first()
    if low is None:
        return [df] * 3
    cuts = [low - 1, *[low + (top - low) * i // 3 for i in (1, 2)], top]
    return [df.filter((F.col(col) > F.lit(a)) & (F.col(col) <= F.lit(b))) for a, b in zip(cuts, cuts[1:])]


@query
def stream_src(spark, d):
    out = fresh_path(spark, "streamed")
    _replayed(_thirds(messages_of(spark, d), "seq"), fresh_path(spark, "log"),
              lambda path: _files(out)(stream_messages(spark, path)))
    return read_messages(spark, out).groupBy("session_id", "kind").agg(F.count("*").alias("n"), checksum("seq"))


@query
def stream_assemble(spark, d):
    out = fresh_path(spark, "assembled")
    _replayed(_thirds(messages_of(spark, d, dirty=True), "seq"), fresh_path(spark, "log"),
              lambda path: S.stream_assemble(stream_messages(spark, path), out))
    return S.read_assembled(spark, out).groupBy("tx_id").agg(F.count("*").alias("n"), checksum("seq"))


@query
def stream_route(spark, d):
    changes, out = changes_of(spark, d), fresh_path(spark, "routed")
    _replayed(_thirds(changes, "commit_lsn"), fresh_path(spark, "changes"),
              lambda path: T.stream_route(spark.readStream.schema(changes.schema).parquet(path), lambda s: subs_of(s, d),
                                          lambda s: W.policies(s, d), out, W.MAX_CHANGES, LSN_SPAN))
    subs = subs_of(spark, d)
    totals = T.read_outcomes(spark, out, subs).join(subs.select("sub_id", "kind"), "sub_id")
    return totals.groupBy("kind", "outcome").agg(F.sum("n_pairs").alias("n_pairs"), big_sum("n_delivered"))


@query
def stream_feed(spark, d):
    """``sink_all`` from the log messages, by micro-batches."""
    out = fresh_path(spark, "feed")
    _replayed(_thirds(messages_of(spark, d), "seq"), fresh_path(spark, "log"),
              lambda path: T.stream_feed(stream_messages(spark, path), lambda s: subs_of(s, d), lambda s: W.policies(s, d), out,
                                         W.MAX_CHANGES, "365 days", W.SPAN, LSN_SPAN))
    return event_totals(T.read_deliveries(spark, out, view=_digested))


@query
def stream_mirror(spark, d):
    users, out = users_of(spark, d), fresh_path(spark, "mirror")
    _replayed(_thirds(users, "commit_lsn"), fresh_path(spark, "users"),
              lambda path: S.stream_mirror(spark.readStream.schema(users.schema).parquet(path), out))
    return S.read_mirror(spark, out).select("pk", "col", "value")


@query
def stream_dedupe(spark, d):
    rows = W.received(spark, d).select("sub_id", *TX, "received_at", "arrival")
    out = fresh_path(spark, "deduped")
    _replayed(_thirds(rows, "arrival"), fresh_path(spark, "received"), lambda path: S.stream_dedupe(
        spark.readStream.schema(rows.schema).parquet(path), "received_at", "14 days", out))
    return Carry(spark, out).whole("events", rows.schema).select("sub_id", "tx_id")


@query
def stream_once(spark, d):
    """Every arrival, with whether it was delivered or found to be a repeat or out of commit order."""
    rows = W.received(spark, d).select("sub_id", *TX, "received_at", "arrival")
    out = fresh_path(spark, "once")
    _replayed(_thirds(rows, "arrival"), fresh_path(spark, "received"), lambda path: S.stream_once(
        spark.readStream.schema(rows.schema).parquet(path), out))
    parts = [Carry(spark, out).whole(name, rows.schema).select("sub_id", "tx_id", "arrival", F.lit(name == "events").alias("delivered"))
             for name in ("events", "repeats")]
    return parts[0].unionByName(parts[1])


@query
def stream_transactions(spark, d):
    """Transactions of the log with faults, typed and assembled by micro-batches."""
    out = fresh_path(spark, "transactions")
    _replayed(_thirds(messages_of(spark, d, dirty=True), "seq"), fresh_path(spark, "log"),
              lambda path: stream_tx_job(stream_messages(spark, path), out, "365 days", W.SPAN))
    transactions, changes = read_transactions(spark, out)
    content = changes.groupBy(*TX).agg(checksum("seq", "op", "pk"))
    return transactions.join(content, TX, "left").select("session_id", "tx_id", big("commit_lsn"), "commit_ts", big("n_changes"), "checksum")


def _call_slices(spark, d):
    return [f.drop("us") for f in _thirds(W.auth_calls(spark, d).withColumn("us", F.unix_micros("ts")), "us")]


def _call_stream(spark, frames, path):
    return spark.readStream.schema(frames[0].schema).parquet(path)


@query
def stream_failure_rate(spark, d):
    frames, out = _call_slices(spark, d), fresh_path(spark, "rates")
    _replayed(frames, fresh_path(spark, "calls"), lambda path: S.stream_failure_rate(
        _call_stream(spark, frames, path), "30 hours", "1 hour", "2 days", out))
    return S.read_failure_rate(spark, out).select(
        "backend", "window_start", "failures", "total", F.round("rate", 6).alias("rate"))


@query
def stream_breaker(spark, d):
    frames, out = _call_slices(spark, d), fresh_path(spark, "breaker")
    _replayed(frames, fresh_path(spark, "calls"),
              lambda path: stream_breaker_job(_call_stream(spark, frames, path), BREAKER, out))
    return read_timeline(spark, out).select("backend", "at", "state", "label")
