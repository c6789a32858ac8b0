"""Timeline of the circuit breaker in front of the permission backend.

The failure window counts every call whatever the state, so the calls that would trip the
breaker are found in parallel with joins and windows. What is left per backend, one row
per probe and one per stretch between probes within a bucket, is walked in order.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import auth_result, breaker_label
from ..operators import chunked
from ..operators.metrics import MICRO, call_buckets
from ..session import stage

# fixed value: the user id of probe calls
PROBE_USER = "_health"


@dataclass(frozen=True)
class BreakerConfig:
    """Defaults are the service's: 1 s buckets, trip above one half of at least 20 calls."""

    bucket_s: int = 1
    n_buckets: int = 30
    floor: int = 20
    threshold: float = 0.5
    cooldown_s: int = 30


def trip_points(calls: DataFrame, cfg: BreakerConfig, history: DataFrame | None = None) -> DataFrame:
    """(backend, at_us, trips, probe_ok): probes, and the first call of each stretch that would trip.

    ``history`` holds bucket counts (backend, bucket, successes, failures) of earlier calls.
    """
    nothing = F.lit(0).cast("bigint")
    buckets = call_buckets(calls, cfg.bucket_s).withColumn("old_s", nothing).withColumn("old_f", nothing)
    if history is not None:
        old = history.withColumn("old_s", F.col("successes")).withColumn("old_f", F.col("failures"))
        counts = ["successes", "failures", "old_s", "old_f"]
        buckets = buckets.unionByName(old).groupBy("backend", "bucket").agg(*[F.sum(c).alias(c) for c in counts])
    near = chunked.with_lookback(buckets, "bucket", cfg.n_buckets, cfg.n_buckets * 256)
    before = Window.partitionBy("backend", "_piece").orderBy("bucket").rangeBetween(-(cfg.n_buckets - 1), -1)
    earlier = (near.withColumn("_f", F.coalesce(F.sum("failures").over(before), nothing) + F.col("old_f"))
               .withColumn("_s", F.coalesce(F.sum("successes").over(before), nothing) + F.col("old_s"))
               .filter("not _context").select("backend", "bucket", "_f", "_s"))
    failed = auth_result(F.col("status"), F.col("error")) == "unavailable"
    rows = calls.select("backend", F.unix_micros("ts").alias("at_us"), failed.alias("failed"),
                        (F.col("user_id") == PROBE_USER).alias("probe"))
    rows = rows.withColumn("bucket", F.expr(f"at_us div {cfg.bucket_s * MICRO}")).join(earlier, ["backend", "bucket"])
    # one bucket of one backend is a slice of time
    upto = Window.partitionBy("backend", "bucket").orderBy("at_us").rowsBetween(Window.unboundedPreceding, 0)
    failures = F.col("_f") + F.count(F.when(F.col("failed"), 1)).over(upto)
    total = F.col("_f") + F.col("_s") + F.count("*").over(upto)
    rows = (rows.withColumn("trips", (total >= cfg.floor) & (failures > total * cfg.threshold))
            .withColumn("stretch", F.count(F.when(F.col("probe"), 1)).over(upto)))
    probes = rows.filter("probe").select("backend", "at_us", "trips", (~F.col("failed")).alias("probe_ok"))
    first = (rows.filter("trips and not probe").groupBy("backend", "bucket", "stretch").agg(F.min("at_us").alias("at_us"))
             .select("backend", "at_us", F.lit(True).alias("trips"), F.lit(None).cast("boolean").alias("probe_ok")))
    return probes.unionByName(first)


class Breaker:
    """State of one backend, fed with its trip points in time order."""

    def __init__(self, cooldown_us: int, state: int = 0, opened_us: int = 0):
        self.cooldown_us, self.state, self.opened_us = cooldown_us, state, opened_us

    def feed(self, at_us: int, trips: bool, probe_ok) -> list[int]:
        """States entered at this point: 0 closed, 1 open, 2 half-open."""
        if self.state == 0:
            if not trips:
                return []
            self.state, self.opened_us = 1, at_us
            return [1]
        if probe_ok is None or at_us - self.opened_us < self.cooldown_us:
            return []
        if probe_ok:
            self.state = 0
        else:
            self.opened_us = at_us
        return [2, self.state]


def breaker_states(calls: DataFrame, cfg: BreakerConfig = BreakerConfig(), history: DataFrame | None = None,
                   start: DataFrame | None = None) -> DataFrame:
    """(backend, at, step, state, label) of every state change.

    Backends start closed, or as ``start`` (backend, state, opened_us) says.
    """
    cooldown = cfg.cooldown_s * MICRO

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend, breaker = None, None
        for part in parts:  # sorted by backend and time, one batch in memory
            out = []
            for name, at_us, trips, probe, start_state, opened_us in part.itertuples(index=False, name=None):
                if name != backend:
                    backend, breaker = name, Breaker(cooldown)
                if start_state >= 0:
                    breaker = Breaker(cooldown, start_state, opened_us)
                    continue
                states = breaker.feed(at_us, bool(trips), None if probe < 0 else probe == 1)
                out.extend((name, at_us, i, s) for i, s in enumerate(states))
            yield pd.DataFrame(out, columns=["backend", "at_us", "step", "state"])

    points = trip_points(calls, cfg, history).select(
        "backend", "at_us", "trips", F.coalesce(F.col("probe_ok").cast("int"), F.lit(-1)).alias("probe"),
        F.lit(-1).alias("start_state"), F.lit(0).cast("bigint").alias("opened_us"))
    if start is not None:
        points = points.unionByName(start.select(
            "backend", F.lit(-(1 << 62)).alias("at_us"), F.lit(False).alias("trips"), F.lit(-1).alias("probe"),
            F.col("state").cast("int").alias("start_state"), "opened_us"))
    # a bounded number of rows per backend and bucket: the order within a backend is inherent
    ordered = points.repartition("backend").sortWithinPartitions("backend", "at_us")
    return (ordered.mapInPandas(walk, "backend string, at_us bigint, step int, state int")
            .withColumn("at", F.timestamp_micros("at_us")).withColumn("label", breaker_label(F.col("state")))
            .withColumn("state", F.col("state").cast("bigint")))


def stream_breaker(calls: DataFrame, cfg: BreakerConfig, path: str) -> DataStreamWriter:
    """Timeline per micro-batch of calls in time order, written to ``path/timeline``.

    What a batch needs of the past is small and kept beside it: each backend's last bucket
    counts and its state. A retried batch reads its predecessor and overwrites its own folders.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = stage(batch, "calls")
        history = start = None
        if batch_id:
            history = spark.read.parquet(f"{path}/history/batch={batch_id - 1}")
            start = spark.read.parquet(f"{path}/state/batch={batch_id - 1}")
        breaker_states(rows, cfg, history, start).write.mode("overwrite").parquet(f"{path}/timeline/batch={batch_id}")
        steps = spark.read.parquet(f"{path}/timeline/batch={batch_id}").select(
            "backend", F.struct("at_us", "step").alias("_at"), "state", F.when(F.col("state") == 1, F.col("at_us")).alias("opened_us"))
        counts = call_buckets(rows, cfg.bucket_s)
        if start is not None:
            first = F.struct(F.lit(-(1 << 62)).alias("at_us"), F.lit(0).alias("step"))
            steps = steps.unionByName(start.select("backend", first.alias("_at"), "state", "opened_us"))
            counts = counts.unionByName(history).groupBy("backend", "bucket").agg(
                F.sum("successes").alias("successes"), F.sum("failures").alias("failures"))
        last = steps.groupBy("backend").agg(F.max_by("state", "_at").alias("state"),
                                            F.coalesce(F.max("opened_us"), F.lit(0)).alias("opened_us"))
        last.write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")
        newest = counts.agg(F.max("bucket")).scalar()
        (counts.filter(F.col("bucket") > newest - cfg.n_buckets)
         .write.mode("overwrite").parquet(f"{path}/history/batch={batch_id}"))

    return calls.writeStream.foreachBatch(one)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/timeline")
