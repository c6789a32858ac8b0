"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores. Feeds derived from the tables are landed first and reported as ``land_*``.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = ["outcome_counts", "outcomes_by_sub", "fan_out", "fan_out_work", "multi_root", "encode_events",
           "sink_all", "co_tx_all", "type_changes", "assemble_tx", "mirror", "field_diff", "entity_view", "audit_foreign_child",
           "alert_episodes", "counter_rate", "concurrency", "failure_rate", "breaker_timeline", "delivery_lag"]


def main() -> None:
    from pyspark.sql import SparkSession, functions as F
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "20g").config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from millrace import queries as Q
    from millrace.session import configure
    configure(spark)
    times = {}

    def clock(name, work):
        start = time.time()
        result = work()
        times[name] = round(time.time() - start, 3)
        return result

    clock("land_changes", lambda: Q.changes_of(spark, SF_DIR).count())
    clock("land_subs", lambda: Q.subs_of(spark, SF_DIR).count())
    clock("land_users", lambda: Q.users_of(spark, SF_DIR).count())
    for dirty in (False, True):
        clock("land_messages" + ("_dirty" if dirty else ""), lambda: Q.messages_of(spark, SF_DIR, dirty).count())
    chosen = os.environ.get("BENCH_QUERIES", ",".join(QUERIES)).split(",")
    pairs = delivered = None
    for name in chosen:
        run = Q.REGISTRY[name]
        if name == "outcome_counts":
            rows = clock(name, lambda: run(spark, SF_DIR).collect())
            pairs = sum(r.n_pairs for r in rows)
            delivered = sum(r.n_delivered for r in rows)
        else:
            clock(name, lambda: run(spark, SF_DIR).write.format("noop").mode("overwrite").save())
    total = round(sum(times[q] for q in chosen), 3)
    extra = {}
    if pairs:
        extra = {"pairs": pairs, "delivered_changes": delivered,
                 "pairs_per_s": round(pairs / times["outcome_counts"]),
                 "delivered_changes_per_s": round(delivered / times["outcome_counts"])}
        if "outcomes_by_sub" in times:
            extra["pairs_per_s_materialised"] = round(pairs / times["outcomes_by_sub"])
    print(json.dumps({"metric": "headline queries", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS), **extra}))


if __name__ == "__main__":
    main()
