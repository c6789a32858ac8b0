"""Routing on small literal transactions."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import rollups as U, routing as R
from millrace.plans import fanout

CHANGE = ("session_id string, tx_id bigint, commit_lsn bigint, seq bigint, schema_name string, table_name string, op string, "
          "pk string, pk_col string, data map<string,string>, commit_ts timestamp")
SUB = ("sub_id string, user_id string, kind string, schema_name string, table_name string, pk string, start_lsn bigint, "
       "end_lsn bigint, policy_id bigint")


def changes(spark, rows):
    """rows: (tx, table, op, pk[, columns[, schema]])"""
    import datetime
    at = datetime.datetime(2024, 1, 1)
    full = []
    for i, r in enumerate(rows):
        tx, table, op, pk, *rest = r
        cols = rest[0] if rest else ["id", "v"]
        schema = rest[1] if len(rest) > 1 else "public"
        full.append(("s", tx, tx * 10, i, schema, table, op, pk, "id", None if op == "delete" else {c: '"x"' for c in cols}, at))
    return spark.createDataFrame(full, CHANGE)


def subs(spark, rows):
    """rows: (id, table, pk or None[, start[, policy[, end]]])"""
    full = []
    for r in rows:
        name, table, pk, *rest = r
        start, policy, end = (list(rest) + [0, 1, None][len(rest):])
        full.append((name, "u", "exact" if pk else "wildcard", "public", table, pk, start, end, policy))
    return spark.createDataFrame(full, SUB)


def policies(spark, grants=None, versions=None):
    grants = grants or [(1, 1, "users", ["id", "v"]), (1, 1, "items", ["id", "v"])]
    versions = versions or [(1, 1, -1)]
    return (spark.createDataFrame(versions, "policy_id bigint, version bigint, refresh_lsn bigint"),
            spark.createDataFrame(grants, "policy_id bigint, version bigint, table_name string, columns array<string>"))


def routed(spark, rows, people, max_changes=100, **p):
    versions, grants = policies(spark, **p)
    return fanout.route(changes(spark, rows), subs(spark, people), versions, grants, max_changes)


def got(run):
    return {(r.sub_id, r.tx_id): (r.outcome, r.n_delivered, r.n_beyond_anchor) for r in run.outcomes().collect()}


def test_exact_wildcard_and_whole_transaction(spark):
    run = routed(spark, [(1, "users", "insert", "42"), (1, "items", "insert", "7"), (2, "items", "insert", "8")],
                 [("a", "users", "42"), ("b", "users", None), ("c", "users", "43"), ("d", "items", None)])
    assert got(run) == {("a", 1): ("delivered", 2, 1), ("b", 1): ("delivered", 2, 1), ("d", 1): ("delivered", 2, 1),
                        ("d", 2): ("delivered", 1, 0)}


def test_start_position_and_end(spark):
    run = routed(spark, [(t, "users", "insert", "1") for t in (1, 2, 3)], [("a", "users", "1", 20), ("b", "users", None, 0, 1, 20)])
    assert got(run) == {("a", 1): ("below_start", 0, 0), ("a", 2): ("below_start", 0, 0), ("a", 3): ("delivered", 1, 0),
                        ("b", 1): ("delivered", 1, 0), ("b", 2): ("delivered", 1, 0)}


def test_multi_root_drops_the_transaction_but_keeps_the_subscription(spark):
    run = routed(spark, [(1, "users", "insert", "1"), (1, "users", "insert", "2"), (2, "users", "insert", "1"), (2, "users", "update", "1")],
                 [("a", "users", "1"), ("b", "users", None)])
    assert got(run) == {("a", 1): ("multi_root", 0, 0), ("b", 1): ("multi_root", 0, 0), ("a", 2): ("delivered", 2, 0),
                        ("b", 2): ("delivered", 2, 0)}


@pytest.mark.parametrize("keys,multi", [(["", "1"], False), (["1", ""], True), (["", "", ""], False), (["", "1", "1"], False),
                                        (["1", "1"], False), (["1", "2"], True)])
def test_blank_keys_in_the_multi_root_rule(spark, keys, multi):
    df = changes(spark, [(1, "users", "insert", k) for k in keys])
    assert R.multi_root(df).first().multi_root == multi


def test_anchor_must_survive_the_whitelist(spark):
    # the user row changes only a hidden column: the item alone is not sent
    run = routed(spark, [(1, "users", "update", "1", ["id", "secret"]), (1, "items", "insert", "7"),
                         (2, "users", "update", "1", ["id"]), (3, "users", "delete", "1")], [("a", "users", "1")])
    assert got(run) == {("a", 1): ("silent", 0, 0), ("a", 2): ("silent", 0, 0), ("a", 3): ("delivered", 1, 0)}


def test_other_schemas_do_not_ride_along(spark):
    run = routed(spark, [(1, "users", "insert", "1"), (1, "items", "insert", "7", ["id"], "audit")], [("a", "users", "1")])
    assert got(run) == {("a", 1): ("delivered", 1, 0)}


def test_cap_counts_after_filtering_and_ends_the_subscription(spark):
    rows = [(1, "users", "insert", "1")] + [(1, "hidden", "insert", str(i)) for i in range(5)]
    rows += [(2, "users", "insert", "1")] + [(2, "items", "insert", str(i)) for i in range(5)] + [(3, "users", "insert", "1")]
    run = routed(spark, rows, [("a", "users", "1"), ("late", "users", "1", 20)], max_changes=3)
    assert got(run) == {("a", 1): ("delivered", 1, 0), ("a", 2): ("tx_too_large", 0, 0), ("late", 1): ("below_start", 0, 0),
                        ("late", 2): ("below_start", 0, 0), ("late", 3): ("delivered", 1, 0)}


def test_policy_version_in_force(spark):
    grants = [(1, 1, "users", ["id", "v"]), (1, 2, "users", ["id"])]
    run = routed(spark, [(1, "users", "update", "1"), (2, "users", "update", "1"), (3, "users", "update", "1")],
                 [("a", "users", "1")], grants=grants, versions=[(1, 1, -1), (1, 2, 20)])
    assert {k[1]: v[0] for k, v in got(run).items()} == {1: "delivered", 2: "delivered", 3: "silent"}


def test_large_transaction_is_one_outcome(spark):
    run = routed(spark, [(1, "users", "insert", str(i)) for i in range(10000)], [("a", "users", None)], max_changes=10000)
    assert got(run) == {("a", 1): ("multi_root", 0, 0)}


def test_weighted_counts_equal_the_pairs(spark):
    import random
    rng = random.Random(3)
    rows = [(tx, rng.choice(["users", "items"]), rng.choice(["insert", "update", "delete"]), str(rng.randint(1, 4)))
            for tx in range(1, 60) for _ in range(rng.randint(1, 4))]
    people = [(f"s{i}", rng.choice(["users", "items"]), rng.choice([None, "1", "2"]), rng.randint(0, 600), rng.choice([1, 2]),
               rng.choice([None, rng.randint(0, 700)])) for i in range(60)]
    run = routed(spark, rows, people, max_changes=3,
                 grants=[(1, 1, "users", ["v"]), (1, 1, "items", ["v"]), (2, 1, "users", ["id"])], versions=[(1, 1, -1), (2, 1, -1)])
    pairs = {}
    for r in run.outcomes().collect():
        key = (r.tx_id, r.kind, r.policy_id, r.outcome)
        pairs[key] = pairs.get(key, 0) + 1
    counted = {}
    for r in fanout.outcome_weights(fanout.weighted_classes(run, 64)).collect():
        key = (r.tx_id, r.kind, r.policy_id, r.outcome)
        counted[key] = counted.get(key, 0) + r.n_pairs
    assert counted == pairs


def test_whitelist_cases(spark):
    rows = changes(spark, [(1, "users", "insert", "1", ["id", "v", "w"]), (2, "users", "update", "1", ["id", "w"]),
                           (3, "users", "update", "1", ["id", "v", "w"]), (4, "users", "delete", "1"), (5, "other", "insert", "1"),
                           (6, "users", "truncate", "1"), (7, "users", "insert", "1", ["w"])])
    from pyspark.sql import functions as F
    tagged = rows.withColumn("policy_id", F.lit(1).cast("bigint")).withColumn("version", F.lit(1).cast("bigint"))
    _, grants = policies(spark, grants=[(1, 1, "users", ["v"])])
    seen = {r.tx_id: r.data for r in R.apply_whitelist(tagged, grants).collect()}
    assert seen == {1: {"id": '"x"', "v": '"x"'}, 3: {"id": '"x"', "v": '"x"'}, 4: None, 7: {}}


def test_transactions_without_a_policy_in_force_are_silent(spark):
    versions, grants = policies(spark, versions=[(1, 1, 20)])
    cs = changes(spark, [(1, "users", "insert", "a"), (2, "users", "insert", "a"), (3, "users", "insert", "a")])
    known = subs(spark, [("e", "users", "a"), ("w", "users", None), ("none", "users", None, 0, 9)])
    got = sorted((r.sub_id, r.tx_id, r.outcome) for r in fanout.route(cs, known, versions, grants).outcomes().collect())
    assert got == [("e", 1, "silent"), ("e", 2, "silent"), ("e", 3, "delivered"), ("none", 1, "silent"), ("none", 2, "silent"),
                   ("none", 3, "silent"), ("w", 1, "silent"), ("w", 2, "silent"), ("w", 3, "delivered")]


LOG = [(1, "users", "insert", "42"), (2, "users", "update", "42"), (2, "items", "insert", "7"), (3, "users", "insert", "42"),
       (3, "users", "insert", "43"), (4, "items", "insert", "8"), (5, "users", "update", "42", ["id"])]
PEOPLE = [("a", "users", "42"), ("b", "users", "42", 20), ("c", "users", None, 0, 1, 20), ("d", "items", None, 20, 1, 10),
          ("e", "users", "42", 0, 1, 10), ("f", "users", None, 30), ("g", "users", "44"), ("h", "items", None, 60)]


def test_ended_subscriptions_leave_the_fan_out(spark):
    touched = R.touched_rows(changes(spark, [(n, "users", "insert", "42") for n in (1, 2, 3)]))
    people = subs(spark, [("a", "users", "42", 0, 1, 10), ("b", "users", None, 0, 1, 20), ("c", "users", "42", 50)])
    found = U.fan_out(touched, R.touched_tables(touched), people, 16)
    assert {(r.tx_id, r.n_subs, r.n_exact) for r in found.collect()} == {(1, 3, 2), (2, 2, 1), (3, 1, 1)}


def test_violations_leave_the_fan_out(spark):
    touched = R.touched_rows(changes(spark, [(1, "users", "insert", "42"), (2, "users", "insert", "42"), (3, "items", "insert", "1")]))
    people = subs(spark, [("a", "users", "42")]).selectExpr("*", "10L as violation_lsn")
    found = U.fan_out(touched, R.touched_tables(touched), people, 16)
    assert {(r.tx_id, r.n_subs) for r in found.collect()} == {(1, 1), (2, 0), (3, 0)}


@pytest.mark.parametrize("span", [8, 1 << 20])
@pytest.mark.parametrize("max_changes", [1, 100])
def test_outcome_totals_equal_pairs(spark, span, max_changes):
    run = routed(spark, LOG, PEOPLE, max_changes, versions=[(1, 1, 15)])
    pairs = run.outcomes().groupBy("sub_id", "outcome").agg(
        {"*": "count", "n_delivered": "sum", "n_beyond_anchor": "sum"}).select(
        "sub_id", "outcome", "count(1)", "sum(n_delivered)", "sum(n_beyond_anchor)")
    totals = fanout.outcome_totals(run, span).select("sub_id", "outcome", "n_pairs", "n_delivered", "n_beyond_anchor")
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, pairs.collect()))


@pytest.mark.parametrize("span", [8, 1 << 20])
def test_log_totals_equal_pairs(spark, span):
    log, people = changes(spark, LOG), subs(spark, PEOPLE)
    seen = {}
    for r in R.match_live(log, people).collect():
        seen.setdefault(r.sub_id, []).append(r.tx_id)
    live = {(r.sub_id, r.n_tx, r.first_tx, r.last_tx) for r in R.live_totals(log, people, span).collect()}
    assert live == {(s, len(t), min(t), max(t)) for s, t in seen.items()}
    cut = {}
    for r in R.eligible(log, people).collect():
        n = cut.setdefault(r.sub_id, [0, 0])
        n[0 if r.commit_lsn > r.start_lsn else 1] += 1
    assert {(r.sub_id, r.n_after, r.n_before) for r in R.start_totals(log, people, span).collect()} == {
        (s, *n) for s, n in cut.items()}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_violation_pairs_no_transactions_with_subscriptions(spark, tmp_path):
    bad = [(t, "items", "insert", str(t * 10 + k)) for t in range(1, 9) for k in range(2 if t % 3 == 0 else 1)]
    bad += [(t, "users", "insert", "u") for t in (2, 6)]
    people = [("w1", "items", None), ("w2", "items", None, 30), ("w3", "items", None, 60), ("w4", "items", None, 0, 1, 59),
              ("w5", "items", None, 0, 1, 60), ("w6", "items", None, 90), ("e1", "users", "u"), ("e2", "users", "u", 20),
              ("e3", "users", "u", 60), ("other", "items", None, 0, 2)]
    names = ("classes", "subs")
    frames = [changes(spark, bad).selectExpr("session_id", "tx_id", "commit_lsn", "if(table_name = 'items', 'wildcard', 'exact') AS kind",
                                             "schema_name", "table_name", "if(table_name = 'items', null, pk) AS pk", "1L AS policy_id",
                                             "if(tx_id % 2 = 0, 'tx_too_large', 'silent') AS outcome"), subs(spark, people)]
    for name, df in zip(names, frames):
        df.write.parquet(str(tmp_path / name))
    classes, listed = (spark.read.parquet(str(tmp_path / n)) for n in names)
    for span in (1 << 20, 20):
        found = R.first_violation(classes, listed, span)
        assert {r.sub_id: r.violation_lsn for r in found.collect()} == {
            "w1": 20, "w2": 40, "w3": 80, "w4": 20, "w5": 20, "w6": None, "e1": 20, "e2": 60, "e3": None, "other": None}
    # no side is repeated: a plan estimates it without the repeats and would broadcast it
    assert "explode" not in _plan(R.first_violation(classes, listed))


def test_receivers_are_the_pairs_behind_the_start(spark):
    rows = [(t, "items", "insert", str(t)) for t in range(1, 40)] + [(t, "users", "insert", "u") for t in range(1, 40, 3)]
    people = [(f"w{i}", "items", None, i * 37, 1, end) for i, end in enumerate([None, 100, 30, None, 148, 300, None, 10 ** 15])]
    people += [(f"e{i}", "users", "u", i * 70, 1, end) for i, end in enumerate([None, 100, 130])]
    run = routed(spark, rows, people)
    want = run.outcomes().filter("outcome <> 'below_start'").select("sub_id", "tx_id").collect()
    for span in (1 << 20, 64):
        got_pairs = R.receivers(run.classes, run.subs, span).select("sub_id", "tx_id").collect()
        assert sorted(got_pairs) == sorted(want) and len(want) > 100
    only_rows = routed(spark, rows, people[-3:])
    assert R.receivers(only_rows.classes, only_rows.subs).count() == only_rows.outcomes().filter("outcome <> 'below_start'").count()


def test_pieces_of_stretches_are_not_sent_through_the_driver(spark, tmp_path):
    # a small file of subscriptions whose stretches cover many pieces of the log
    people = [(f"w{i}", "items", None, i * 30, 1, None) for i in range(40)]
    classes = changes(spark, [(t, "items", "insert", str(t)) for t in range(1, 200)]).selectExpr(
        "tx_id", "commit_lsn", "session_id", "'wildcard' AS kind", "schema_name", "table_name", "string(null) AS pk", "1L AS policy_id", "1L AS version")
    for name, df in (("classes", classes), ("subs", subs(spark, people).selectExpr("*", "bigint(null) AS violation_lsn"))):
        df.write.parquet(str(tmp_path / name))
    pairs = R.receivers(*(spark.read.parquet(str(tmp_path / n)) for n in ("classes", "subs")), 16)
    above = _plan(pairs).split("Generate explode")[0].split("\n")
    assert "Exchange hashpartitioning" in [line for line in above if "Exchange" in line][-1]
    assert pairs.count() == sum(t * 10 > i * 30 for t in range(1, 200) for i in range(40))


def test_sink_writes_a_stretch_of_a_shared_log_for_each_subscription(spark, tmp_path):
    from millrace.sources import read_dispatch, write_dispatch
    rows = [(t, "items", "insert", str(t)) for t in range(1, 60)] + [(t, "users", "insert", "u") for t in range(1, 60, 3)]
    rows += [(30, "items", "insert", f"m{k}") for k in range(9)] + [(41, "users", "insert", f"n{k}") for k in range(9)]
    people = [(f"w{i}", "items", None, i * 37 - 50, 1, end) for i, end in enumerate([None, 100, -60, None, 148, 300, None, 10 ** 15])]
    people += [(f"e{i}", "users", "u", i * 70, 1, end) for i, end in enumerate([None, 100, 130])] + [("none", "items", None, 10 ** 9)]
    versions, grants = policies(spark, versions=[(1, 1, 15)])
    parts = [changes(spark, [r for r in rows if (r[0] < 25) == first]) for first in (True, False)]
    out, want = str(tmp_path / "out"), []
    for n, part in enumerate(parts):
        sent = fanout.dispatch(part, subs(spark, people), versions, grants, 8)
        want += [(r.sub_id, r.tx_id, r.payload) for r in sent.received().join(sent.events, ["tx_id", "commit_lsn", "session_id", *fanout.EVENT]).collect()]
        write_dispatch(sent.logs(), sent.stretches(), sent.events, out, n)
    stored = {n: spark.read.parquet(f"{out}/{n}").count() for n in ("events", "logs", "received")}
    assert stored["received"] <= 2 * len(people) < stored["logs"] < len(want)
    seen = []
    got = read_dispatch(spark, out, view=lambda events: (seen.append(events.columns), events)[1])
    assert sorted((r.sub_id, r.tx_id, r.payload) for r in got.collect()) == sorted(want) and len(seen) == 1
    some = read_dispatch(spark, out, ["w0", "e0"]).collect()
    assert sorted((r.sub_id, r.tx_id, r.payload) for r in some) == sorted(w for w in want if w[0] in ("w0", "e0"))


def test_positions_keep_their_order_as_bigint(spark):
    from millrace.functions import lsn_order
    places = [-5, 0, 1, (1 << 63) - 1, 1 << 63, (1 << 64) - 1]
    got = [r[0] for r in spark.createDataFrame([(str(p),) for p in places], "p string").selectExpr("cast(p as decimal(20,0)) AS p").orderBy("p").select(lsn_order(F.col("p"))).collect()]
    assert got[0] is None and got[1:] == [p - (1 << 63) for p in places[1:]]


def test_routing_leaves_only_the_frames_that_are_read_on(spark, monkeypatch):
    import os
    staged, stage = {}, fanout.stage
    def kept(df, label):
        frame = stage(df, label)
        staged[label] = os.path.dirname(frame.inputFiles()[0]).removeprefix("file://")
        return frame
    monkeypatch.setattr(fanout, "stage", kept)
    run = routed(spark, LOG, PEOPLE)
    assert {n for n, path in staged.items() if os.path.exists(path)} == {"outcomes", "subs"} and len(staged) == 5
    assert len(got(run)) > 5
    # shuffles of finished queries don't wait for the driver's garbage collection
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def test_counts_of_the_routing_plan_land_no_payload(spark, monkeypatch):
    from millrace import queries as Q
    read = []
    monkeypatch.setattr(Q.fanout, "route", lambda changes, *a, **k: read.append(changes.columns))
    Q.routed(spark, "/root/testdata/sf0.001")
    assert "names" in read[0] and "data" not in read[0]


def test_repeated_side_is_not_broadcast(spark, tmp_path):
    from millrace.operators.skew import salted_join
    spark.range(50).selectExpr("id AS k").write.parquet(str(tmp_path / "small"))
    big = spark.range(500).selectExpr("id % 60 AS k", "id AS o")
    joined = salted_join(big, spark.read.parquet(str(tmp_path / "small")), ["k"], ["o"], salts=64)
    assert joined.count() == big.filter("k < 50").count()
    assert "Broadcast" not in _plan(joined)


def test_totals_along_the_log_equal_the_pairs(spark):
    rows = [(n, t, "insert", str(n % 4), ["id"], s) for n in range(1, 30) for t, s in (("users", "public"), ("items", "public"), ("users", "audit"))
            if (n + len(t)) % 3] + [(7, "users", "update", "9"), (7, "users", "update", "9")]
    log = changes(spark, rows)
    people = subs(spark, [("a", "users", "1", 35), ("b", "users", "1", 90, 1, 200), ("c", "users", None), ("d", "users", None, 120, 1, 100),
                          ("e", "items", None, 60, 1, 250), ("f", "items", "2"), ("g", "users", "9"), ("h", "none", None)])
    pairs = R.match_live(log, people)
    live = {r.sub_id: (r.n_tx, r.first_tx, r.last_tx) for r in R.live_totals(log, people, 64).collect()}
    own = {}
    for r in sorted(pairs.collect(), key=lambda r: r.commit_lsn):
        own.setdefault(r.sub_id, []).append(r.tx_id)
    assert live == {k: (len(v), v[0], v[-1]) for k, v in own.items()}
    carried = R.expand_tx(pairs, log).collect()
    assert {r.sub_id: (r.n_tx, r.n_changes, r.n_anchor) for r in R.change_totals(log, people, 64).collect()} == {
        k: (len(v), sum(r.sub_id == k for r in carried), sum(r.sub_id == k and r.anchor for r in carried)) for k, v in own.items()}
    # rows that nobody follows aren't moved to the subscriptions
    assert {r.pk for r in R.followed_changes(log, people).collect()} == {"1", "2", "9"}


def test_kept_changes_are_counted_where_they_are_joined(spark, monkeypatch):
    log = changes(spark, [(1, "users", "insert", "1"), (1, "users", "update", "1", ["id"]), (1, "items", "update", "2", ["v"]), (2, "users", "delete", "3")])
    people = subs(spark, [("a", "users", "1"), ("b", "items", None), ("c", "users", None)])
    staged = []
    monkeypatch.setattr(fanout, "stage", lambda df, label: (staged.append(label), df)[1])
    versions, grants = policies(spark)
    followed = fanout.followed_rows(log, people)
    assert sorted(r.pk for r in followed.collect()) == ["1", "1"]
    found = fanout.count_kept(log, fanout.match_classes(log, people, versions, followed), grants, followed)
    assert sorted((r.tx_id, r.kind, r.table_name, r.n_anchor, r.n_kept) for r in found.collect()) == [
        (1, "exact", "users", 1, 2), (1, "wildcard", "items", 1, 2), (1, "wildcard", "users", 1, 2), (2, "wildcard", "users", 1, 1)]
    # the changes times their classes aren't written
    assert staged == ["followed", "tables", "classes"]
