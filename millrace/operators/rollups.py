"""Counts, histograms and rankings over routed and delivered data."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import auth_result
from ..schemas import TX
from . import chunked, routing as R

# fixed values: histogram bounds of the reported distributions
TX_SIZE_BOUNDS = [1, 10, 100, 1000, 10000, 100000]
FAN_OUT_BOUNDS = [1, 5, 25, 100, 500, 2500, 10000]
WORK_BOUNDS = [1, 5, 25, 100, 500, 2500, 10000, 50000]
LIFETIME_BOUNDS = [1, 10, 60, 600, 3600, 21600, 86400]
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10]
FEED_LENGTH = 200


def fan_out(touched: DataFrame, tables: DataFrame, subs: DataFrame, span: int = chunked.DEFAULT_SPAN) -> DataFrame:
    """Subscriptions matched per transaction (``n_exact``: row-level ones), before start and guards; 0 when none.

    A subscription counts up to its ``end_lsn`` and, where ``subs`` carry it, its ``violation_lsn``.
    Subscriptions are counted per anchor: a transaction meets each anchor once, and a running
    sum of the ended ones is taken off along the log, so no (transaction, subscription) pair is built.
    """
    keys, nothing = R.LOG_KEYS, F.lit(0).cast("bigint")
    met = R.met_anchors(touched, tables, subs).withColumn("_n", nothing).withColumn("_mark", F.lit(0))
    last = F.least("end_lsn", "violation_lsn") if "violation_lsn" in subs.columns else F.col("end_lsn")
    ends = R.by_log(subs).withColumn("commit_lsn", last.cast(met.schema["commit_lsn"].dataType)).filter("commit_lsn is not null")
    marks = ends.groupBy(*keys, "commit_lsn").agg(F.count("*").alias("_n")).withColumn("_mark", F.lit(1))
    # an end sorts behind the transaction at its position, which it still counts in
    both = met.unionByName(marks, allowMissingColumns=True)
    counted = chunked.running_sum(both, keys, ["commit_lsn", "_mark", "session_id", "tx_id"], {"_gone": F.col("_n")}, span)
    there = F.col("n_anchored") - F.col("_gone")
    found = counted.filter("_mark = 0").select(*TX, there.alias("n"), F.when(F.col("kind") == "exact", there).otherwise(nothing).alias("x"))
    unmet = tables.select(*TX, nothing.alias("n"), nothing.alias("x"))
    return found.unionByName(unmet).groupBy(*TX).agg(F.sum("n").alias("n_subs"), F.sum("x").alias("n_exact"))


def outcome_counts(outcomes: DataFrame, by: list[str], cube: bool = False) -> DataFrame:
    grouped = outcomes.cube(*by) if cube else outcomes.groupBy(*by)
    return grouped.agg(F.count("*").alias("n_pairs"), F.sum("n_delivered").alias("n_delivered"))


def histogram(df: DataFrame, value: Column, by: list[str], bounds: list[float]) -> DataFrame:
    """Cumulative buckets (…, le, n) with a last bucket at infinity; ``total`` is the sum of values.

    One counter per bound is kept while scanning, so a group costs a handful of numbers.
    """
    counters = [F.count(F.when(F.col("_x") <= b, 1)).alias(f"_b{i}") for i, b in enumerate(bounds)]
    flat = df.withColumn("_x", value).groupBy(*by).agg(*counters, F.count("_x").alias("_all"), F.sum("_x").alias("total"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)],
                   F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("n")))
    return flat.select(*by, F.explode(rows).alias("b"), "total").select(*by, "b.le", "b.n", "total")


def histogram_quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Quantile by linear interpolation in the bucket that reaches rank ``q * total``.

    The first bucket starts at 0; a rank in the last bucket gives its lower bound. Null
    for empty histograms. A label set has as many rows as there are bounds.
    """
    order = Window.partitionBy(*by).orderBy("le")
    rows = (buckets.withColumn("_low", F.coalesce(F.lag("le").over(order), F.lit(0.0)))
            .withColumn("_under", F.coalesce(F.lag("n").over(order), F.lit(0)))
            .withColumn("_rank", F.max("n").over(Window.partitionBy(*by)) * F.lit(float(q))))
    inside = F.col("_low") + (F.col("le") - F.col("_low")) * (F.col("_rank") - F.col("_under")) / (F.col("n") - F.col("_under"))
    value = (F.when(F.col("le") == float("inf"), F.col("_low"))
             .when(F.col("n") == F.col("_under"), F.col("_low")).otherwise(inside))
    hit = (F.col("n") >= F.col("_rank")) & (F.col("_rank") > 0)
    return rows.groupBy(*by).agg(F.min_by(value, F.when(hit, F.col("le"))).alias("value"))


def active_subs(sessions: DataFrame, at: Column) -> DataFrame:
    """Open sessions by kind at one time."""
    open_ = (F.col("connected_at") <= at) & (F.col("disconnected_at").isNull() | (F.col("disconnected_at") > at))
    return sessions.groupBy("kind").agg(F.count(F.when(open_, 1)).alias("n_active"))


def auth_results(calls: DataFrame, by: list[str]) -> DataFrame:
    return calls.withColumn("result", auth_result(F.col("status"), F.col("error"))).groupBy(*by, "result").agg(
        F.count("*").alias("n"))


def delivery_lag(received: DataFrame, by: list[str], qs: list[float], lag: Column, span: int,
                 exact: bool = True) -> DataFrame:
    """Percentiles (…, q, lag) of an integer lag per group.

    Exact: the smallest lag reached by a share ``q`` of the rows, from counts per distinct
    lag and running totals in pieces. Otherwise ``percentile_approx``.
    """
    rows = received.withColumn("lag", lag)
    if not exact:
        found = rows.groupBy(*by).agg(F.percentile_approx("lag", qs, 10000).alias("_p"))
        return found.select(*by, F.explode(F.arrays_zip(
            F.array(*[F.lit(q) for q in qs]).alias("q"), F.col("_p").alias("lag"))).alias("x")).select(*by, "x.*")
    counts = rows.groupBy(*by, "lag").agg(F.count("*").alias("_n"))
    running = chunked.running_sum(counts, by, ["lag"], {"_upto": F.col("_n")}, span)
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    ranked = running.join(totals, by) if by else running.crossJoin(F.broadcast(totals))
    # the row that crosses rank q * total
    picks = F.filter(F.array(*[F.lit(q) for q in qs]), lambda q: (F.col("_upto") >= q * F.col("_all"))
                     & ((F.col("_upto") - F.col("_n")) < q * F.col("_all")))
    return ranked.select(*by, F.explode(picks).alias("q"), "lag")


def events_by_channel(frames: DataFrame, by: list[str]) -> DataFrame:
    return frames.groupBy(*by).agg(F.count("*").alias("n_events"))


def lifetime_s() -> Column:
    return (F.unix_micros("disconnected_at") - F.unix_micros("connected_at")) / 1e6


def session_stats(sessions: DataFrame) -> DataFrame:
    """Ended sessions per reason (a missing reason is a client that left) and their lifetimes."""
    reason = F.when(F.coalesce("reason", F.lit("")) == "", "client_closed").otherwise(F.col("reason"))
    return sessions.filter("disconnected_at is not null").withColumn("reason", reason).groupBy("reason").agg(
        F.count("*").alias("n"), F.avg(lifetime_s()).alias("mean_s"),
        F.min(lifetime_s()).alias("min_s"), F.max(lifetime_s()).alias("max_s"))


# Entries of a lifetime sketch; ranks read from merged sketches are off by less than RANK_ERROR with 99 % confidence.
SKETCH_K, RANK_ERROR = 800, 0.005


def session_sketches(sessions: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """(day, reason, n, sketch): quantile sketches of the lifetimes of sessions that ended on a day.

    Sketches merge: kept per day, they give the percentiles of any span of days without its sessions. Each has
    some thousands of bytes, whatever the number of sessions.
    """
    reason = F.when(F.coalesce("reason", F.lit("")) == "", "client_closed").otherwise(F.col("reason"))
    ended = sessions.filter("disconnected_at is not null and connected_at is not null")
    return ended.groupBy(F.to_date("disconnected_at").alias("day"), reason.alias("reason")).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double(lifetime_s(), F.lit(k)).alias("sketch"))


def merged_percentiles(sketches: DataFrame, by: list[str], qs: list[float], k: int = SKETCH_K) -> DataFrame:
    """(…, n, q, value) of the merged ``sketches``; a value's rank is within ``RANK_ERROR`` of ``q``."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("_s"))
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias("value")) for q in qs]))
    return merged.select(*by, "n", each.alias("_q")).select(*by, "n", "_q.*")


def feed_topn(rows: DataFrame, channel: list[str], order: list[str], n: int = FEED_LENGTH) -> DataFrame:
    """Latest ``n`` rows per channel with ``place`` and the number left out.

    The rank filter lets Spark cut each task to ``n`` rows per channel before the shuffle.
    """
    latest = Window.partitionBy(*channel).orderBy(*[F.col(c).desc() for c in order])
    top = rows.withColumn("place", F.row_number().over(latest)).filter(F.col("place") <= n)
    counts = rows.groupBy(*channel).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("n_left_out"))
    return top.join(counts, channel)


def export_sorted(changes: DataFrame) -> DataFrame:
    """Range-partitioned commit order: reading the parts in turn reads the log in order."""
    return changes.repartitionByRange("commit_lsn", "seq").sortWithinPartitions("commit_lsn", "seq")
