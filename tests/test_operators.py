"""Encoding, mirrors, loaders and time series on small literal frames."""

import datetime
import random

from pyspark.sql import functions as F

from millrace.functions import json_object
from millrace.operators import audit as A, delivery as D, metrics as X, mirror as M, rollups as U
from millrace.sources import parse_channels, parse_frames, parse_metrics_text, parse_policies, policy_id, valid_channels, write_deliveries
from millrace.streaming.breaker import Breaker

AT = datetime.datetime(2026, 5, 20)
CHANGE = ("session_id string, tx_id bigint, commit_lsn bigint, commit_ts timestamp, seq bigint, schema_name string, table_name string, "
          "op string, pk string, pk_col string, data map<string,string>")


def changes(spark, rows):
    return spark.createDataFrame([("s", tx, tx * 10, AT, i, "public", table, op, pk, "id", data)
                                  for i, (tx, table, op, pk, data) in enumerate(rows)], CHANGE)


def test_golden_payload(spark):
    df = changes(spark, [(12345, "users", "insert", "42", {"name": '"alice"'}), (12345, "users", "update", "42", {"name": '"bob"'}),
                         (12345, "users", "delete", "42", None)])
    event = D.encode_events(df, ["schema_name"], 10).first()
    assert event.payload == (
        '{"tx_id":12345,"commit_ts":"2026-05-20T00:00:00Z","changes":[{"op":"insert","table":"users","pk":"42","data":{"name":"alice"}},'
        '{"op":"update","table":"users","pk":"42","data":{"name":"bob"}},{"op":"delete","table":"users","pk":"42"}]}')
    assert event.frame_bytes == len("event: tx\nid: 12345\ndata: " + event.payload + "\n\n")
    assert D.payload_sizes(df, ["schema_name"]).first().frame_bytes == event.frame_bytes
    assert D.encode_events(df, ["schema_name"], 2).count() == 0
    assert D.encode_events(df, ["schema_name"], 10, event.frame_bytes - 1).count() == 0
    assert D.encode_events(df, ["schema_name"], 10, event.frame_bytes).count() == 1


def test_sizes_are_those_of_the_text_whatever_it_holds(spark):
    maps = [{}, {"a": "1"}, {"b": '"x"', "a": "null"}, {'q"<\n': '"\u20ac"', "\u2028&": "[1,2]", "\\": "{}"}, {"\u00e4": '"\u00fc"'}, {"": '""'},
            {"a": None}, {"a": None, "b": "1"}, {"b": "", "a": "2"}, None]
    df = changes(spark, [(i, 't"<', "update", pk, m) for i, m in enumerate(maps) for pk in ('1', 'k&"\t', None)])
    assert [r[0] for r in df.filter(D.fragment_bytes() != F.octet_length(D.fragment())).select("seq").collect()] == []
    assert df.filter(D.fragment_bytes().isNull() != D.fragment().isNull()).count() == 0
    # the members of an object in byte order, keys escaped
    assert df.filter("tx_id = 3").select(json_object(F.col("data"))).first()[0] == (
        '{"\\\\":{},"q\\"\\u003c\\n":"\u20ac","\\u2028\\u0026":[1,2]}')
    plan = D.payload_sizes(df, ["schema_name"])._jdf.queryExecution().optimizedPlan().toString()
    assert "arraysort" not in plan.lower().replace("_", "")


def test_mirror_fold(spark):
    df = changes(spark, [
        (1, "t", "insert", "1", {"a": "1", "b": "2"}), (2, "t", "update", "1", {"b": "null"}), (3, "t", "insert", "1", {"a": "9"}),
        (4, "t", "update", "1", {"c": "3"}), (5, "t", "update", "2", {"a": "5"}), (6, "t", "insert", "3", {"a": "1"}),
        (7, "t", "delete", "3", None), (8, "t", "delete", "4", None), (9, "t", "update", "4", {"a": "7"}), (10, "t", "insert", "5", {"a": "null"})])
    state = {r.pk: r.data for r in M.nested(M.build_mirror(df)).collect()}
    assert state == {"1": {"a": "9", "c": "3"}, "2": {"a": "5"}, "4": {"a": "7"}, "5": {"a": "null"}}


def test_entity_view_of_chains_loops_and_broken_links(spark):
    cells = [("p", "root", "1", "name", '"r"'), ("p", "root", "2", "name", '"s"'), ("p", "root", "2", "child_id", '"x"')]
    link = lambda table, pk, column, value, schema="p": (schema, table, pk, column, value)
    cells += [link("child", "a", "root_id", '"1"'), link("child", "b", "root_id", '"9"'), link("child", "c", "root_id", "null"), link("child", "d", "root_id", "2")]
    cells += [link("child", "a", "note", '"n"'), link("leaf", "l1", "child_id", '"a"'), link("leaf", "l2", "child_id", '"b"'), link("leaf", "l3", "child_id", '"zz"')]
    cells += [link("leaf", "l4", "child_id", '"a"', "q"), link("other", "o", "root_id", '"1"')]
    mirror = spark.createDataFrame(cells, "schema_name string, table_name string, pk string, col string, value string")
    view = M.entity_view(mirror, "root", {"child": "root_id", "leaf": ("child_id", "child")})
    got = sorted((r.root_pk, r.table_name, r.pk, r.col) for r in view.collect())
    assert got == [("1", "child", "a", "note"), ("1", "child", "a", "root_id"), ("1", "leaf", "l1", "child_id"), ("1", "root", "1", "name"),
                   ("2", "child", "d", "root_id"), ("2", "root", "2", "child_id"), ("2", "root", "2", "name")]
    # five tables deep, and two that point at each other
    deep = [link("t1", "k", "up", '"2"')] + [link(f"t{i}", "k", "up", '"k"') for i in range(2, 6)] + [link("t5", "j", "up", '"none"')]
    deep += [link("ring", "x", "up", '"y"'), link("gnir", "y", "up", '"x"')]
    parents = {"t1": ("up", "root")} | {f"t{i}": ("up", f"t{i - 1}") for i in range(2, 6)} | {"ring": ("up", "gnir"), "gnir": ("up", "ring")}
    found = M.root_keys(spark.createDataFrame(deep, mirror.schema), "root", parents)
    assert sorted((r.table_name, r.pk, r.root_pk) for r in found.collect()) == [(f"t{i}", "k", "2") for i in range(1, 6)]


def test_field_diff(spark):
    df = changes(spark, [(1, "t", "insert", "1", {"a": "1", "b": "2"}), (2, "t", "update", "1", {"a": "1", "b": "3"}),
                         (3, "t", "delete", "1", None), (4, "t", "update", "1", {"a": "1"}), (5, "t", "update", "1", {"a": "null"})])
    got = sorted((r.tx_id, r.col, r.old, r.value) for r in M.field_diff(df, 16).collect())
    assert got == [(1, "a", None, "1"), (1, "b", None, "2"), (2, "b", "2", "3"), (4, "a", None, "1"), (5, "a", "1", "null")]


def test_frames(spark):
    texts = ['event: tx\nid: 42\ndata: {"tx_id":42}', ":", "event: tx", "event: tx\nid: 1", 'event: error\ndata: {"reason":"x"}',
             "event: a\nevent: b\ndata:1\ndata: 2", "event:  two\ndata: "]
    got = {(r.event, r.data, r.id) for r in parse_frames(spark.createDataFrame(texts, "string")).collect()}
    assert got == {("tx", '{"tx_id":42}', "42"), ("error", '{"reason":"x"}', None), ("a", "1", None), (" two", "", None)}


def test_metric_text(spark):
    lines = ["# HELP a b", "", "a 1", 'a{x="y"} 2.5 1640000000000', "a NaN", 'b{le="+Inf"} +Inf', "c ++1", "d 1e3", "e .5", "9x 1"]
    got = {r.metric: r.value for r in parse_metrics_text(spark.createDataFrame(lines, "string")).collect()}
    assert got == {"a": 3.5, "d": 1000.0, "e": 0.5}


def test_channels(spark):
    lines = ["orders/42", " lineitem/all ", "# no", "", "Bad/1", "orders/", "orders/a/b", "orders/" + "x" * 257]
    good, bad = valid_channels(parse_channels(spark.createDataFrame(lines, "string")))
    assert {r.channel for r in good.collect()} == {"orders:42", "lineitem:all", "orders:a/b"}
    assert bad.count() == 3


def test_policies(spark):
    docs = ['{"user_id":"a","tables":{"t":["y","x"]},"roots":["q"],"initial_data": {"n": 1.50}}', '{"user_id":"","tables":{}}', "{oops",
            '{"user_id":"b","tables":{"t":["x","y"]}}', '{"user_id":"c","tables":{"t":7}}', '{"user_id":"d"} trailing']
    good, grants, rejects = parse_policies(spark.createDataFrame(docs, "string").withColumnRenamed("value", "doc"))
    assert {r.user_id: r.initial_data for r in good.collect()} == {"a": '{"n":1.50}', "b": None}
    assert sorted(r.reason for r in rejects.collect()) == ["bad_json", "bad_json", "bad_json", "no_user"]
    assert policy_id(grants, ["user_id"]).select("policy_id").distinct().count() == 1


def test_policies_are_judged_once_over_all_cores(spark):
    docs = spark.createDataFrame([(i, '{"user_id":"%s","tables":{"t":["x"]}%s' % (i, "}" if i % 3 else "")) for i in range(30)], "doc_id int, doc string")
    calls = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: (calls.add(1), t)[1], "string").asNondeterministic()
    good, grants, rejects = parse_policies(docs.coalesce(1).withColumn("doc", seen("doc")))
    assert (good.count(), grants.count(), rejects.count()) == (20, 20, 10) and calls.value == 30
    assert {r.initial_data for r in good.collect()} == {None}


def test_sink_is_partitioned_and_complete(spark, tmp_path):
    df = changes(spark, [(t, "t", "insert", str(t), {"a": "1"}) for t in range(20)])
    events = D.encode_events(df.withColumn("sub_id", F.lit("s")), ["sub_id"], 10)
    write_deliveries(events, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 20 and {"commit_date", "bucket"} <= set(back.columns)


def test_histogram_and_quantile(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 50, 500)], "g string, v int")
    buckets = U.histogram(df, F.col("v"), ["g"], [1, 10, 100])
    assert [(r.le, r.n) for r in buckets.orderBy("le").collect()] == [(1.0, 1), (10.0, 3), (100.0, 4), (float("inf"), 5)]
    # rank 2.5 of 5 lies in (1, 10], which holds ranks 2 and 3
    assert abs(U.histogram_quantile(buckets, 0.5, ["g"]).first().value - (1 + 9 * 1.5 / 2)) < 1e-9
    assert U.histogram_quantile(buckets, 0.99, ["g"]).first().value == 100.0


def test_exact_percentiles_without_groups(spark):
    df = spark.range(1, 101).withColumn("lag", F.col("id"))
    got = {r.q: r.lag for r in U.delivery_lag(df, [], [0.5, 0.95, 0.99], F.col("lag"), 16).collect()}
    assert got == {0.5: 50, 0.95: 95, 0.99: 99}


def test_rates_and_resets(spark):
    base = datetime.datetime(2024, 1, 1)
    values = [10, 20, 5, 8]
    rows = [("m", "i", base + datetime.timedelta(seconds=60 * i), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "metric string, instance string, ts timestamp, value double")
    got = [r.result for r in X.counter_rate(df, ["metric", "instance"], 150, "increase").orderBy("ts").collect()]
    assert got == [None, 10.0, 15.0, 8.0]
    got = [r.result for r in X.counter_rate(df, ["metric", "instance"], 150, "delta").orderBy("ts").collect()]
    assert got == [None, 10.0, -5.0, -12.0]


def test_episodes_need_time_and_no_gap(spark):
    base = datetime.datetime(2024, 1, 1)
    rule = X.Rule("r", "m", ">", 1, 120)
    seconds = [(0, 2), (60, 2), (120, 2), (180, 0), (240, 2), (300, 2), (600, 2), (660, 2)]
    df = spark.createDataFrame([("m", "i", base + datetime.timedelta(seconds=s), float(v), {"k": ""}) for s, v in seconds],
                               "metric string, instance string, ts timestamp, value double, labels map<string,string>")
    got = X.alert_episodes(df, [rule], 60).collect()
    assert [(r.n_samples, r.started_at) for r in got] == [(3, base)]


def test_rules_read_one_scan_and_keep_label_sets_apart(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(6):  # two counters on one instance, one far above the other; a filtered label; a second metric
        at = base + datetime.timedelta(seconds=60 * i)
        for shard, value in (("a", 1000.0), ("b", 5.0 * i)):
            rows.append(("m", "i", at, value, {"reason": "slow", "shard": shard}))
        rows += [("m", "i", at, 900.0 * i, {"reason": "other"}), ("used", "i", at, 9.0, {}), ("size", "i", at, 10.0 if i % 2 else 0.0, {}),
                 ("flag", "j", at, 1.0, None), ("noise", "i", at, 1.0, {})]
    rows.append(("used", "lone", base, 9.0, {}))
    df = spark.createDataFrame(rows, "metric string, instance string, ts timestamp, value double, labels map<string,string>")
    df.write.parquet(str(tmp_path / "samples"))
    rules = [X.Rule("grows", "m", ">", 4, 60, "increase", 120, {"reason": "slow"}), X.Rule("full", "used", ">", 0.8, 0, other="size", divide=True),
             X.Rule("both", "used", ">", 8, 0, other="size", other_op=">", other_threshold=5), X.Rule("on", "flag", "==", 1, 300)]
    verdicts = X.evaluate_rules(spark.read.parquet(str(tmp_path / "samples")), rules)
    assert "samples" not in verdicts._jdf.queryExecution().analyzed().toString().replace("rule-samples", "")
    assert all("rule-samples" in f for f in verdicts.inputFiles())
    got = {}
    for r in verdicts.collect():
        got.setdefault((r.rule, r.instance, r.labels), []).append(((r.ts - base).seconds // 60, r.holds))
    a, b = '{"reason":"slow","shard":"a"}', '{"reason":"slow","shard":"b"}'
    assert sorted(got) == sorted([("grows", "i", a), ("grows", "i", b), ("full", "i", "{}"), ("both", "i", "{}"), ("on", "j", "{}")])
    assert [h for _, h in sorted(got["grows", "i", a])] == [False] * 6
    assert [h for _, h in sorted(got["grows", "i", b])] == [False] + [True] * 5
    assert [h for _, h in sorted(got["full", "i", "{}"])] == [False, True] * 3 == [h for _, h in sorted(got["both", "i", "{}"])]
    episodes = X.alert_episodes(df, rules, 60).collect()
    assert sorted((r.rule, r.n_samples) for r in episodes) == [("both", 1)] * 3 + [("full", 1)] * 3 + [("grows", 5), ("on", 6)]


def test_exhausted_retries_end_nothing_while_the_breaker_is_open(spark):
    calls = spark.createDataFrame([(f"s{i}", lsn, "b" if i % 2 else "c", 503, None, True) for i, lsn in enumerate([4, 5, 9, 10, 30, 31, 40])],
                                  "sub_id string, lsn long, backend string, status int, error string, exhausted boolean")
    spans = spark.createDataFrame([("b", 5, 10), ("c", 8, 9), ("b", 31, None)], "backend string, from_lsn long, to_lsn long")
    for span in (4, 1000):
        assert {r.sub_id: r.open for r in X.while_open(calls, spans, span).collect()} == {
            "s0": False, "s1": True, "s2": False, "s3": False, "s4": False, "s5": True, "s6": False}
    subs = spark.createDataFrame([(f"s{i}", "t", 0, None, 1) for i in range(7)], "sub_id string, table_name string, start_lsn long, end_lsn long, policy_id long")
    versions = spark.createDataFrame([(1, 1, -1)], "policy_id long, version long, refresh_lsn long")
    grants = spark.createDataFrame([(1, 1, "t", ["a"])], "policy_id long, version long, table_name string, columns array<string>")
    cut = {r.sub_id: r.end_lsn for r in X.revocation_cutoff(subs, versions, grants, calls, spans).collect()}
    assert cut == {"s0": 4, "s1": None, "s2": 9, "s3": 10, "s4": 30, "s5": None, "s6": 40}


def test_merged_sketches_give_percentiles_within_their_error(spark):
    rng = random.Random(2)
    base = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(30_000):
        start = base + datetime.timedelta(seconds=rng.randrange(20 * 86_400))
        rows.append((start, start + datetime.timedelta(seconds=int(rng.paretovariate(1) * 10)), rng.choice(["x", "y", None])))
    rows += [(base, None, "x")]
    df = spark.createDataFrame(rows, "connected_at timestamp, disconnected_at timestamp, reason string").repartition(9)
    days = U.session_sketches(df)
    assert days.count() > 40
    found = U.merged_percentiles(days, ["reason"], [0.5, 0.95, 0.99]).collect()
    assert {r.reason for r in found} == {"x", "y", "client_closed"} and len(found) == 9
    for r in found:
        own = sorted((b - a).total_seconds() for a, b, x in rows if b and (x or "client_closed") == r.reason)
        low, high = sum(v < r.value for v in own), sum(v <= r.value for v in own)
        assert r.n == len(own) and low - 1 <= (r.q + U.RANK_ERROR) * r.n and high + 1 >= (r.q - U.RANK_ERROR) * r.n


def test_breaker_walk():
    b = Breaker(30)
    assert b.feed(0, False, None) == [] and b.feed(5, True, None) == [1]
    assert b.feed(20, True, True) == []          # still cooling down
    assert b.feed(35, True, False) == [2, 1]     # failed probe opens again
    assert b.feed(64, False, True) == [] and b.feed(65, False, True) == [2, 0]
    assert b.feed(66, True, None) == [1]


def test_reconcile_and_order(spark):
    names = "schema_name string, table_name string"
    seen, want = spark.createDataFrame([("p", "a"), ("p", "b")], names), spark.createDataFrame([("p", "b"), ("p", "c")], names)
    assert {(r.table_name, r.side) for r in A.reconcile_tables(seen, want).collect()} == {("a", "extra"), ("c", "missing")}
    rows = [("x", i, "s", tx, tx) for i, tx in enumerate([1, 2, 2, 5, 3])]
    got = A.audit_order(spark.createDataFrame(rows, "sub_id string, arrival bigint, session_id string, tx_id bigint, commit_lsn bigint"), 2).first()
    assert (got.n_events, got.n_duplicates, got.n_order_breaks) == (5, 1, 1)


def test_mirror_moves_changes_not_cells(spark):
    import random
    rng, rows = random.Random(7), []
    for i in range(1500):
        op = rng.choice(["insert", "update", "update", "update", "delete"])
        cols = rng.sample(["a", "b", "c", "d"], rng.randint(0, 4))
        data = None if op == "delete" or not rng.randrange(9) else {c: rng.choice([f'"{i}{c}"', "null"]) for c in cols}
        pk = "hot" if rng.randrange(3) == 0 else str(rng.randrange(300))
        rows.append((i // 2, i, "p", rng.choice(["t", "u"]), op, pk, data))
    df = spark.createDataFrame(rows, "commit_lsn bigint, seq bigint, schema_name string, table_name string, op string, pk string, "
                                     "data map<string,string>").repartition(5)
    want = sorted(map(tuple, M.standing(M.latest_cells(M.cells(df))).select(*M.ROW, "col", "value").collect()))
    for many in (1, 20, 1_000):
        assert sorted(map(tuple, M.flat(M.mirror_rows(df, many=many)).collect())) == want and len(want) > 300
    mirror = M.build_mirror(df)
    assert sorted(map(tuple, mirror.select(*M.ROW, "col", "value").collect())) == want
    plan = mirror._jdf.queryExecution().sparkPlan().toString()
    # the aggregation of the changes is the only step that needs a row's changes together
    assert "Window" not in plan and "max_by" not in plan


def test_ranges_cost_nothing_per_sample_they_span(spark):
    import math
    import random
    rng, base = random.Random(3), datetime.datetime(2024, 1, 1)
    at = sorted(rng.sample(range(4000), 300))
    values = [float(rng.randrange(50)) for _ in at]
    values[40], values[41], values[90], values[200] = float("inf"), 3.0, float("nan"), None
    df = spark.createDataFrame([("m", base + datetime.timedelta(seconds=s), v) for s, v in zip(at, values)], "metric string, ts timestamp, value double")

    def step(i):
        if not i:
            return 0.0
        a, b = values[i - 1], values[i]
        if a is None or b is None:
            return b
        return b - a if math.isnan(b) or b >= a else b  # NaN counts as the largest value

    steps = [step(i) for i in range(len(at))]
    made = X.counter_rate(df, ["metric"], 200, "increase")
    for i, r in enumerate(made.orderBy("ts").collect()):
        first = next(j for j in range(len(at)) if at[j] > at[i] - 200)
        known = [values[j] for j in range(first, i + 1) if values[j] is not None]
        want = sum(s for s in steps[first:i + 1] if s is not None)
        want = None if len(known) < 2 or steps[first] is None else want - steps[first]
        assert r.result == want or (math.isnan(r.result) and math.isnan(want)), (i, r.result, want)
    rules = [X.Rule("a", "m", ">", 1, 60, "rate", 300), X.Rule("b", "m", ">", 1, 60, "delta", 900)]
    judged = X.evaluate_rules(df.selectExpr("metric", "'i' AS instance", "ts", "value", "map('k', '') AS labels"), rules)
    for frame in (made, judged):
        # a frame whose both ends move is read again for every row
        assert "RangeFrame, -" not in frame._jdf.queryExecution().analyzed().toString()
