"""Time series of samples, sessions and permission calls: rates, alerts, staleness."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import auth_result, lsn_diff
from ..session import stage
from . import chunked
from .skew import salted_join

MICRO = 1_000_000
# fixed values: session caps and the failure window of the permission backend
PER_USER_CAP, GLOBAL_CAP = 10, 50_000
FAILURE_BUCKETS = 30


def _us(ts: str) -> Column:
    return F.unix_micros(ts)


# ---- sessions ----------------------------------------------------------------------

def session_edges(sessions: DataFrame, by: list[str]) -> DataFrame:
    """Rows (…, at_us, step): +1 at connect, -1 at disconnect, merged per instant."""
    edges = F.array(F.struct(_us("connected_at").alias("at_us"), F.lit(1).alias("step")),
                    F.struct(_us("disconnected_at").alias("at_us"), F.lit(-1).alias("step")))
    rows = sessions.select(*by, F.explode(edges).alias("e")).select(*by, "e.*").filter("at_us is not null")
    return rows.groupBy(*by, "at_us").agg(F.sum("step").alias("step"))


def concurrency(sessions: DataFrame, by: list[str], cap: int, span_s: int = 86_400) -> DataFrame:
    """Peak of live sessions per key and the seconds spent above ``cap``."""
    level = chunked.running_sum(session_edges(sessions, by), by, ["at_us"], {"level": F.col("step")}, span_s * MICRO)
    steps = chunked.previous(level, by, ["at_us"], ["at_us", "level"], "before", span_s * MICRO)
    over = F.when(F.col("before.level") > cap, F.col("at_us") - F.col("before.at_us")).otherwise(0)
    return steps.groupBy(*by).agg(F.max("level").alias("peak"), (F.sum(over) / MICRO).alias("over_cap_s"))


def concurrency_overall(sessions: DataFrame, cap: int, bucket_s: int = 60) -> DataFrame:
    """Live sessions at the end of every bucket that saw a change, over all users.

    Steps are summed per bucket before the running total, so what is ordered globally is
    one row per bucket, not one per session.
    """
    buckets = (session_edges(sessions, []).withColumn("bucket", F.expr(f"at_us div {bucket_s * MICRO}"))
               .groupBy("bucket").agg(F.sum("step").alias("step")))
    level = chunked.running_sum(buckets, [], ["bucket"], {"level": F.col("step")}, 1440)
    return level.select(F.timestamp_micros(F.col("bucket") * (bucket_s * MICRO)).alias("bucket_start"), "level",
                        (F.col("level") > cap).alias("over_cap"))


# ---- counters and gauges -----------------------------------------------------------

def _upto(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_upto`` and ``_before``: totals of the piece up to each row's time and before it.

    A range window is the difference of two of these, so its cost doesn't grow with the samples it spans. Steps that
    are no numbers are counted apart: in a total they would spoil all windows behind them.
    """
    step = F.col("_step")
    amounts = {"steps": F.sum(F.when(F.abs(step) < float("inf"), step)), "n": F.count("value"), "nan": F.count(F.when(F.isnan(step), 1)),
               "up": F.count(F.when(step == float("inf"), 1)), "down": F.count(F.when(step == float("-inf"), 1))}
    order = Window.partitionBy(*keys, "_piece").orderBy("_us")
    totals = lambda last: F.struct(*[F.coalesce(a.over(order.rangeBetween(Window.unboundedPreceding, last)), F.lit(0)).alias(n)
                                     for n, a in amounts.items()])
    return rows.withColumn("_upto", totals(0)).withColumn("_before", totals(-1))


def _with_first(rows: DataFrame, keys: list[str], range_s: int, used: Column | None = None) -> DataFrame:
    """Add ``_first``: the first row within the ``range_s`` seconds up to each row (null where not ``used``).

    Every row is also put where its range begins and takes the row that follows there, in one pass backwards.
    """
    own, back = F.lit(False), F.lit(True)
    used = F.lit(True) if used is None else used
    rows = rows.withColumn("_back", F.explode(F.when(used, F.array(own, back)).otherwise(F.array(back))))
    rows = rows.withColumn("_at", F.col("_us") - F.when(F.col("_back"), range_s * MICRO - 1).otherwise(0))
    seen = F.when(~F.col("_back"), F.struct("_us", "value", "_step", "_before"))
    upto = Window.partitionBy(*keys, "_piece").orderBy(F.col("_at").desc(), "_back").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_first", F.last(seen, ignorenulls=True).over(upto)).filter("_back").drop("_back", "_at")


def _in_range(fn: str, range_s: int) -> Column:
    """Result of ``fn`` from a row's ``_upto`` and ``_first``; null with one sample."""
    held = {n: F.col(f"_upto.{n}") - F.col(f"_first._before.{n}") for n in ("steps", "n", "nan", "up", "down")}
    total = (F.when((held["nan"] > 0) | ((held["up"] > 0) & (held["down"] > 0)), float("nan"))
             .when(held["up"] > 0, float("inf")).when(held["down"] > 0, float("-inf")).otherwise(held["steps"]))
    increase, delta = total - F.col("_first._step"), F.col("value") - F.col("_first.value")
    seconds = (F.col("_us") - F.col("_first._us")) / MICRO
    made = {"increase": increase, "rate": increase / range_s, "delta": delta, "slope": delta / F.nullif(seconds, F.lit(0.0))}
    return F.when(held["n"] > 1, made[fn])


def counter_rate(samples: DataFrame, keys: list[str], range_s: int, fn: str) -> DataFrame:
    """Add ``result`` over the window ``(ts - range, ts]`` of each sample.

    ``increase`` adds up the steps between the window's samples, a fall being a counter
    reset; ``rate`` is increase per second of the range; ``delta`` is last minus first;
    ``slope`` is delta over the time between those two. Nothing is extrapolated; windows
    with one sample give null.
    """
    reach = range_s * MICRO
    span = max(reach * 8, 86_400 * MICRO)
    rows = samples.withColumn("_us", _us("ts"))
    rows = chunked.previous(rows, keys, ["_us"], ["value"], "_before", span)
    step = F.when(F.col("value") >= F.col("_before.value"), F.col("value") - F.col("_before.value")).otherwise(F.col("value"))
    rows = rows.withColumn("_step", F.when(F.col("_before").isNull(), 0.0).otherwise(step)).drop("_before")
    near = chunked.with_lookback(rows, "_us", reach, span)
    near = _with_first(_upto(near, keys), keys, range_s)
    return (near.withColumn("result", _in_range(fn, range_s)).filter("not _context")
            .drop("_us", "_step", "_piece", "_context", "_upto", "_before", "_first"))


@dataclass(frozen=True)
class Rule:
    """``fn(metric{labels}[range_s]) op threshold`` held for ``for_s`` seconds.

    ``other`` is a second metric at the same instance and time: with ``divide`` the first
    is divided by it, else its own ``other_op other_threshold`` must hold too.
    """

    name: str
    metric: str
    op: str
    threshold: float
    for_s: int
    fn: str = "value"
    range_s: int = 0
    labels: dict = field(default_factory=dict)
    other: str | None = None
    divide: bool = False
    other_op: str = ">"
    other_threshold: float = 0.0


MIB = 1024 * 1024
# fixed values: the alert rules
RULES = [
    Rule("wal_lag_high", "wal_lsn_lag_bytes", ">", 100 * MIB, 300),
    Rule("pg_disconnected", "pg_connection_status", "==", 0, 60),
    Rule("standby_ack_failures", "wal_standby_ack_failures_total", ">", 3, 60, "increase", 300),
    Rule("auth_breaker_open", "auth_circuit_breaker_state", "==", 1, 60),
    Rule("stale_without_breaker", "auth_circuit_breaker_state", "==", 0, 60,
         other="auth_breaker_stale_subscribers", other_op=">", other_threshold=0),
    Rule("slow_consumer_rate", "subscriber_disconnects_total", ">", 0.1, 600, "rate", 300, {"reason": "slow_consumer"}),
    Rule("multi_root_drops", "tx_dropped_total", ">", 0, 300, "rate", 300, {"reason": "multi_root"}),
    Rule("fd_pressure", "process_open_fds", ">", 0.8, 600, other="process_max_fds", divide=True),
    Rule("heap_growth", "go_memstats_heap_alloc_bytes", ">", 100 * MIB, 1800, "delta", 1800),
]


def _holds(value: Column, op: str, threshold: float) -> Column:
    return {">": value > threshold, ">=": value >= threshold, "<": value < threshold, "<=": value <= threshold,
            "==": value == threshold, "!=": value != threshold}[op]


def _fanned(samples: DataFrame, rules: list[Rule]) -> DataFrame:
    """Samples once for each rule that reads them, as ``main`` or not, with their labels as text: rule (its number),
    main, instance, labels, ts, value. Which rules a metric feeds is part of the plan: one scan serves all."""
    def uses(metric: str) -> Column:
        found = []
        for i, r in enumerate(rules):
            own = F.lit(True)
            for name, value in r.labels.items():
                own = own & F.coalesce(F.col("labels")[name] == value, F.lit(False))
            if r.metric == metric:
                found.append(F.when(own, F.struct(F.lit(i).alias("rule"), F.lit(True).alias("main"))))
            if r.other == metric:
                found.append(F.struct(F.lit(i).alias("rule"), F.lit(False).alias("main")))
        return F.array(*found)

    metrics = sorted({m for r in rules for m in (r.metric, r.other) if m})
    use = F.lit(None).cast("array<struct<rule:int,main:boolean>>")
    for m in metrics:
        use = F.when(F.col("metric") == m, uses(m)).otherwise(use)
    labels = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))
    return (samples.filter(F.col("metric").isin(*metrics)).select("instance", "ts", "value", labels.alias("labels"), F.explode(use).alias("u"))
            .filter("u is not null").select("u.rule", "u.main", "instance", F.coalesce("labels", F.lit("{}")).alias("labels"), "ts", "value"))


def evaluate_rules(samples: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, for_s, instance, labels, ts, holds) at the sample times of each rule's metric.

    A series is an instance with all its labels: counters of different labels never mix. A second metric is read
    at the same instance and time, its largest value if it has several series there. The steps of all counters are
    found in one pass, and each range in use is one pass over the same pieces, whatever number of samples it spans.
    """
    pick = lambda make: F.element_at(F.array(*[F.lit(make(r)) for r in rules]), F.col("rule") + 1)
    rows = stage(_fanned(samples, rules), "rule-samples")  # read by the passes below, the samples once
    beside = Window.partitionBy("rule", "instance", "ts")
    if any(r.other for r in rules):
        rows = rows.withColumn("_other", F.max(F.when(~F.col("main"), F.col("value"))).over(beside)).filter("main")
    else:
        rows = rows.withColumn("_other", F.lit(None).cast("double"))
    rows = rows.drop("main")
    ranges = sorted({r.range_s for r in rules if r.fn != "value"})
    if ranges:
        keys, reach = ["rule", "instance", "labels"], max(ranges) * MICRO
        span = max(reach * 8, 86_400 * MICRO)
        rows = chunked.previous(rows.withColumn("_us", _us("ts")), keys, ["_us"], ["value"], "_before", span)
        step = F.when(F.col("value") >= F.col("_before.value"), F.col("value") - F.col("_before.value")).otherwise(F.col("value"))
        rows = rows.withColumn("_step", F.when(F.col("_before").isNull(), 0.0).otherwise(step)).drop("_before")
        rows = chunked.with_lookback(rows, "_us", reach, span)
        rows = _upto(rows, keys).withColumn("_result", F.lit(None).cast("double"))
        for range_s in ranges:
            own = [(i, r) for i, r in enumerate(rules) if r.fn != "value" and r.range_s == range_s]
            rows = _with_first(rows, keys, range_s, F.col("rule").isin([i for i, _ in own]))
            for i, r in own:
                rows = rows.withColumn("_result", F.when(F.col("rule") == i, _in_range(r.fn, range_s)).otherwise(F.col("_result")))
        of_range = F.col("rule").isin([i for i, r in enumerate(rules) if r.fn != "value"])
        rows = rows.withColumn("value", F.when(of_range, F.col("_result")).otherwise(F.col("value"))).filter("not _context").drop(
            "_us", "_step", "_piece", "_context", "_upto", "_before", "_first", "_result")
    holds = F.lit(False)
    for i, r in enumerate(rules):
        value, both = F.col("value"), F.lit(True)
        if r.other:
            both = F.col("_other").isNotNull()
            if r.divide:
                value = F.col("value") / F.nullif(F.col("_other"), F.lit(0.0))
            else:
                both = _holds(F.col("_other"), r.other_op, r.other_threshold)
        holds = F.when(F.col("rule") == i, _holds(value, r.op, r.threshold) & both).otherwise(holds)
    absent = F.lit(False)  # a rule on two metrics has a verdict only where both have a sample
    for i, r in enumerate(rules):
        if r.other:
            absent = absent | ((F.col("rule") == i) & F.col("_other").isNull())
    return rows.filter(~absent).select(pick(lambda r: r.name).alias("rule"), pick(lambda r: r.for_s).alias("for_s"), "instance", "labels", "ts",
                                       F.coalesce(holds, F.lit(False)).alias("holds"))


def alert_episodes(samples: DataFrame, rules: list[Rule], scrape_s: int) -> DataFrame:
    """Episodes that fire, by rule and series: the condition held at every sample for at least ``for`` seconds.

    A gap of more than two scrape intervals between samples ends an episode.
    """
    keys, order = ["rule", "instance", "labels"], ["_us"]
    span = 86_400 * MICRO
    # the passes below read the verdicts several times: evaluate the rules once
    rows = stage(evaluate_rules(samples, rules).withColumn("_us", _us("ts")), "verdicts")
    rows = chunked.previous(rows, keys, order, ["_us", "holds"], "_before", span)
    goes_on = F.col("_before.holds") & (F.col("_us") - F.col("_before._us") <= 2 * scrape_s * MICRO)
    start = F.when(F.col("holds") & ~F.coalesce(goes_on, F.lit(False)), F.col("_us"))
    rows = chunked.fill_forward(rows.withColumn("_start", start), keys, order, F.col("_start"), "episode", span)
    episodes = rows.filter("holds").groupBy(*keys, "for_s", "episode").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("n_samples"))
    held = F.unix_micros("ended_at") - F.unix_micros("started_at")
    return episodes.filter(held >= F.col("for_s") * F.lit(MICRO)).drop("episode", "for_s")


# ---- permission backend ------------------------------------------------------------

def call_buckets(calls: DataFrame, bucket_s: int) -> DataFrame:
    """Successes and failures per backend and bucket; only ``unavailable`` is a failure."""
    failed = auth_result(F.col("status"), F.col("error")) == "unavailable"
    return (calls.withColumn("bucket", F.expr(f"unix_micros(ts) div {bucket_s * MICRO}"))
            .groupBy("backend", "bucket").agg(F.count(F.when(~failed, 1)).alias("successes"),
                                              F.count(F.when(failed, 1)).alias("failures")))


def failure_rate(calls: DataFrame, bucket_s: int = 1, n_buckets: int = FAILURE_BUCKETS) -> DataFrame:
    """Failure share over the last ``n_buckets`` buckets at each bucket with calls."""
    rows = chunked.with_lookback(call_buckets(calls, bucket_s), "bucket", n_buckets, n_buckets * 256)
    window = Window.partitionBy("backend", "_piece").orderBy("bucket").rangeBetween(-(n_buckets - 1), 0)
    failures, total = F.sum("failures").over(window), F.sum(F.col("failures") + F.col("successes")).over(window)
    return (rows.withColumn("window_failures", failures).withColumn("window_total", total)
            .filter("not _context").select("backend", "bucket", "window_failures", "window_total",
                                           (F.col("window_failures") / F.col("window_total")).alias("rate")))


def stale(refreshes: DataFrame, keys: list[str], at: Column, ttl: Column, ts: str = "ts") -> DataFrame:
    """Keys whose last refresh is older than their ``ttl`` seconds (a column constant per key)."""
    last = refreshes.groupBy(*keys).agg(F.max(ts).alias("last_at"), F.max(ttl).alias("ttl_s"))
    age = (F.unix_micros(at) - F.unix_micros("last_at")) / MICRO
    return last.withColumn("age_s", age).filter(F.col("age_s") > F.col("ttl_s"))


def lsn_lag(current: DataFrame, confirmed: DataFrame, span_s: int = 86_400) -> DataFrame:
    """Bytes between the current position and the latest one confirmed in the session, 0 before any."""
    both = current.select("session_id", "ts", F.col("lsn").alias("_now")).unionByName(
        confirmed.select("session_id", "ts", F.col("lsn").alias("_done")), allowMissingColumns=True)
    # at one instant the confirmation counts first
    both = both.withColumn("_us", _us("ts")).withColumn("_second", F.col("_now").isNotNull())
    rows = chunked.fill_forward(both, ["session_id"], ["_us", "_second"], F.col("_done"), "_last", span_s * MICRO)
    return rows.filter("_now is not null").select(
        "session_id", "ts", F.coalesce(lsn_diff(F.col("_now"), F.col("_last")), F.lit(0)).alias("lag_bytes"))


def steady_rate(samples: DataFrame, runs: DataFrame, floor_share: float = 0.8) -> DataFrame:
    """Per run: (counter at the end - counter after warm-up) / time between, and the floor from it.

    ``runs`` has instance, started_at, warmup_s, duration_s. The counter at a time is its
    last sample up to then.
    """
    rows = salted_join(samples, runs, ["instance"], ["ts"])
    since = (F.unix_micros("ts") - F.unix_micros("started_at")) / MICRO
    cut = rows.withColumn("_t", since).groupBy("instance", "warmup_s", "duration_s").agg(
        F.max_by("value", F.when(F.col("_t") <= F.col("warmup_s"), F.col("ts"))).alias("_warm"),
        F.max_by("value", F.when(F.col("_t") <= F.col("duration_s"), F.col("ts"))).alias("_end"))
    rate = (F.col("_end") - F.col("_warm")) / (F.col("duration_s") - F.col("warmup_s"))
    return cut.select("instance", rate.alias("per_s"), (rate * floor_share).alias("floor_per_s"))


def while_open(calls: DataFrame, open_spans: DataFrame, span: int = chunked.DEFAULT_SPAN) -> DataFrame:
    """Add ``open``: whether the call's backend had its breaker open at the call's position.

    ``open_spans`` has backend, from_lsn, to_lsn (null: not closed again); those of a backend don't overlap. The last
    opening before each call is carried forward in pieces of the positions, so a backend with most calls is spread.
    """
    marks = open_spans.select("backend", F.col("from_lsn").cast("long").alias("lsn"), F.struct("to_lsn").alias("_span"))
    rows = calls.withColumn("_call", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    rows = rows.withColumn("_second", F.col("_call").isNotNull())  # an opening counts at its own position
    rows = chunked.fill_forward(rows, ["backend"], ["lsn", "_second"], F.col("_span"), "_last", span).filter("_call = 1")
    inside = F.col("_last").isNotNull() & (F.col("_last.to_lsn").isNull() | (F.col("lsn") < F.col("_last.to_lsn")))
    return rows.withColumn("open", inside).drop("_call", "_span", "_second", "_last")


def revocation_cutoff(subs: DataFrame, versions: DataFrame, grants: DataFrame, calls: DataFrame,
                      open_spans: DataFrame | None = None, span: int = chunked.DEFAULT_SPAN) -> DataFrame:
    """Subscriptions with ``end_lsn`` and ``reason`` from permission refreshes.

    The first refresh after the start that no longer lists the table, or that the backend
    refused (401, 403, 404), ends it as auth_revoked; exhausted retries end it as
    auth_unavailable, unless the breaker of their backend is open then (``open_spans``; calls
    name their backend). ``calls`` has sub_id, lsn, status, error, exhausted.
    """
    if open_spans is None:
        calls = calls.withColumn("open", F.lit(False))
    else:
        calls = while_open(calls, open_spans, span)
    policies = subs.select("policy_id", "table_name").distinct()
    lost = (policies.join(versions, "policy_id")
            .join(grants.select("policy_id", "version", "table_name"), ["policy_id", "version", "table_name"], "left_anti")
            .select("policy_id", "table_name", F.col("refresh_lsn").alias("lsn")))
    by_policy = salted_join(subs.select("sub_id", "policy_id", "table_name", "start_lsn"), lost,
                            ["policy_id", "table_name"], ["sub_id"])
    result = auth_result(F.col("status"), F.col("error"))
    reason = (F.when(result.isin("unauthorized", "forbidden", "not_found"), "auth_revoked")
              .when((result == "unavailable") & F.col("exhausted") & ~F.col("open"), "auth_unavailable"))
    failed = calls.withColumn("reason", reason).filter("reason is not null").join(
        subs.select("sub_id", "start_lsn"), "sub_id")
    cut = (by_policy.withColumn("reason", F.lit("auth_revoked")).select("sub_id", "start_lsn", "lsn", "reason")
           .unionByName(failed.select("sub_id", "start_lsn", "lsn", "reason")).filter("lsn > start_lsn"))
    first = cut.groupBy("sub_id").agg(F.min(F.struct("lsn", "reason")).alias("_cut"))
    joined = subs.join(first, "sub_id", "left")
    end = F.when(F.col("_cut").isNull(), F.col("end_lsn")).otherwise(F.least("end_lsn", "_cut.lsn"))
    reason = F.when(F.col("end_lsn").isNull() | (F.col("_cut.lsn") <= F.col("end_lsn")), F.col("_cut.reason"))
    return joined.withColumn("reason", reason).withColumn("end_lsn", end).drop("_cut")
