"""Value conversion: literal cases of the type rules."""

from pyspark.sql import functions as F

from millrace.functions import (channel_table, json_literal, json_quote, lsn_diff, lsn_parse, lsn_text, rfc3339_utc,
                                valid_name, valid_request_id)
from millrace.functions import pgtypes
from millrace.functions.jsontext import json_member

# fixed values: (type OID, text, JSON literal or None for an error)
CASES = [
    (21, "32767", "32767"), (21, "-32768", "-32768"), (21, "0", "0"), (23, "42", "42"), (23, "-1", "-1"),
    (23, "2147483647", "2147483647"), (23, "notanint", None),
    (20, "9223372036854775807", '"9223372036854775807"'), (20, "-9223372036854775808", '"-9223372036854775808"'),
    (700, "3.14", "3.14"), (701, "2.718281828", "2.718281828"), (701, "-1.5", "-1.5"), (701, "notafloat", None),
    (701, "100", "100"), (701, "1e10", "10000000000"), (701, "1e21", "1e+21"), (701, "0.00001", "0.00001"),
    (701, "1e-7", "1e-7"), (701, "NaN", None), (701, "Infinity", None), (701, "1e400", None),
    (16, "t", "true"), (16, "f", "false"), (16, "maybe", None),
    (25, "hello", '"hello"'), (25, "", '""'), (25, "日本語", '"日本語"'), (1043, "world", '"world"'), (1042, "x   ", '"x   "'),
    (25, 'a"b\\c\n\t\x01<&>', '"a\\"b\\\\c\\n\\t\\u0001\\u003c\\u0026\\u003e"'), (25, "a b ", '"a b\\u2028"'),
    (2950, "550e8400-e29b-41d4-a716-446655440000", '"550e8400-e29b-41d4-a716-446655440000"'),
    (1700, "3.14159", '"3.14159"'), (1700, "99999999999999999999999.9999", '"99999999999999999999999.9999"'),
    (1114, "2026-05-14 10:23:45.123456", '"2026-05-14T10:23:45.123456Z"'), (1114, "2026-05-14 10:23:45", '"2026-05-14T10:23:45Z"'),
    (1114, "yesterday", None),
    (1184, "2026-05-14T10:23:45+02:00", '"2026-05-14T08:23:45Z"'), (1184, "2026-05-14T08:23:45Z", '"2026-05-14T08:23:45Z"'),
    (1184, "2026-05-14 10:23:45.123456+02:00", '"2026-05-14T08:23:45.123456Z"'),
    (1184, "2026-05-14 08:23:45+00:00", '"2026-05-14T08:23:45Z"'),
    (1184, "2026-05-14T10:23:45.123456789+02:00", '"2026-05-14T08:23:45.123456789Z"'),
    (1184, "2026-05-14T10:23:45.1+00:00", '"2026-05-14T10:23:45.1Z"'),
    (1184, "2026-05-14 10:23:45.123+02", '"2026-05-14T08:23:45.123Z"'), (1184, "2026-05-14 10:23:45-05", '"2026-05-14T15:23:45Z"'),
    (1082, "2026-05-14", '"2026-05-14"'), (1083, "10:23:45.123456", '"10:23:45.123456"'),
    (1186, "2:30:00", '"PT2H30M"'), (1186, "0:00:06", '"PT6S"'), (1186, "PT2H30M", '"PT2H30M"'), (1186, "0:00:00", '"PT0S"'),
    (1186, "0:00:01.5", '"PT1.5S"'), (1186, "25:00:00", '"PT25H"'), (1186, "", '"PT0S"'),
    (1186, "1 year 2 mons 3 days 04:05:06", '"P1Y2M3DT4H5M6S"'), (1186, "5 days 00:00:00", '"P5D"'),
    (1186, "3 mons 0:00:00", '"P3M"'), (1186, "-0:30:00", '"PT-30M"'), (1186, "whenever", '"whenever"'),
    (114, '{"a":1}', '{"a":1}'), (3802, '{"a" : [1, 2]}', '{"a":[1,2]}'), (3802, '{"msg":"こんにちは"}', '{"msg":"こんにちは"}'),
    (3802, "null", "null"), (3802, "{broken", None), (3802, "1,2", None), (3802, '{"a":1} x', None), (3802, '"a b"', '"a b"'),
    (17, r"\x48656c6c6f", '"SGVsbG8="'), (17, r"\x", '""'), (17, "48656c6c6f", None), (17, r"\xZZZZ", None),
    (869, "192.168.1.1", '"192.168.1.1"'), (650, "192.168.0.0/24", '"192.168.0.0/24"'),
    (1007, "{1,2,3}", "[1,2,3]"), (1007, "{}", "[]"), (1007, "{1,NULL,3}", "[1,null,3]"), (1007, "{1,x}", None),
    (1009, "{foo,bar}", '["foo","bar"]'), (1009, '{"a,b","c"}', '["a,b","c"]'), (1009, "{hello,世界}", '["hello","世界"]'),
    (1009, '{"null","q\\"x"}', '[null,"q\\"x"]'), (1016, "{1,9223372036854775807}", '["1","9223372036854775807"]'),
    (1000, "{t,f,t}", "[true,false,true]"), (1007, "{{1,2},{3,4}}", '"{{1,2},{3,4}}"'),
    (99999, "rawtext", '"rawtext"'), (88888, "", '""'),
]


def test_json_literals(spark):
    df = spark.createDataFrame([(i, o, t) for i, (o, t, _) in enumerate(CASES)], "i int, oid int, t string").repartition(3)
    got = {r.i: r.j for r in df.select("i", json_literal(F.col("oid"), F.col("t")).alias("j")).collect()}
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if got[i] != c[2]]
    assert not wrong


def test_positions(spark):
    rows = spark.createDataFrame([("16/B374D848", "16/B374D800"), ("FFFFFFFF/FFFFFFFF", "0/0"), ("bad", "0/1")], "a string, b string")
    got = rows.select(lsn_parse(F.col("a")).alias("p"), lsn_text(lsn_parse(F.col("a"))).alias("t"),
                      lsn_diff(lsn_parse(F.col("a")), lsn_parse(F.col("b"))).alias("d")).collect()
    assert [(int(r.p), r.t, int(r.d)) for r in got[:2]] == [
        (97500059720, "16/B374D848", 72), (2**64 - 1, "FFFFFFFF/FFFFFFFF", 2**64 - 1)]
    assert got[2].p is None


def test_names_and_times(spark):
    row = spark.range(1).select(
        channel_table(F.lit("public.orders:42")).alias("a"), channel_table(F.lit("orders:all")).alias("b"),
        valid_name(F.lit("a_b9")).alias("c"), valid_name(F.lit("9a")).alias("d"), valid_name(F.lit("a" * 65)).alias("e"),
        valid_request_id(F.lit("x.Y-1_")).alias("f"), valid_request_id(F.lit("x y")).alias("g"),
        rfc3339_utc(F.timestamp_micros(F.lit(1704067200250000))).alias("h"),
        json_quote(F.lit("<a>")).alias("i")).first()
    assert tuple(row) == ("orders", "orders", True, False, False, True, False, "2024-01-01T00:00:00.25Z", '"\\u003ca\\u003e"')


def test_time_text_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.range(1).select(rfc3339_utc(F.timestamp_micros(F.lit(1704067200000000))).alias("a"),
                                    json_literal(F.lit(1184), F.lit("2026-05-14 10:23:45+02")).alias("b")).first()
        assert tuple(row) == ("2024-01-01T00:00:00Z", '"2026-05-14T08:23:45Z"')
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_json_member_keeps_numbers_as_written(spark):
    texts = [('{"a": [1.50, {"m": 2}], "m" : {"x": 1e2, "m": "}"}}', '{"x":1e2,"m":"}"}'), ('{"m":"v"}', '"v"'), ('{"b":1}', None)]
    df = spark.createDataFrame([t for t, _ in texts], "string").coalesce(1)
    assert [r[0] for r in df.select(json_member(F.col("value"), "m")).collect()] == [w for _, w in texts]


def test_compiled_branches_agree_with_the_general_way(spark, monkeypatch):
    texts = {
        pgtypes.FLOAT8: ["0", "0.05", "0.050", "00.5", "123456789.123456", "1234567890", "0.000001", "0.0000001", "1e5", "-0", "+1.5",
                         ".5", "5.", "0.1\n", "NaN", ""],
        pgtypes.INTERVAL: ["3 days 01:30:00", "1 day 00:00:00", "00:00:00", "00:00:07", "12:00:00", "1 day 00:05:00", "0 days 01:00:00",
                           "3 days 01:30:00.5", "-01:30:00", "1 year 2 mons", "3 days 01:30:00\n", " 3 days 01:30:00", "999999999 days 99:99:99"],
        1009: ['{R,"F, x",NULL}', '{}', '{"null",nUll}', '{a, b}', '{"a""b"}', '{"",x}', '{a"b}', '{"say \\"hi\\""}', '{<a>}', '{"a & b"}',
               '{a}\n', '{{a},{b}}', '{"{a}"}', '{NULLS,"null ",null}', '{"a" ,b}', '{$1,"$2"}', '{é}', '{a,}', '{,a}', 'a'],
        1007: ["{1,2,-3}", "{+1,007}", "{-0}", "{1,NULL}", "{}", "{1,x}", "{123456789012345678,1234567890123456789}", "{1}\n"],
        pgtypes.JSONB: ['{"tax": 0.1, "k": [1, 2]}', '{"a": "<b> &"}', '{"a": " "}', '[1, ', '1 2', '" x "'],
        pgtypes.TIMESTAMP: ["2024-01-02 03:04:05", "2024-01-02 03:04:05.120", "2024-01-02T03:04:05.000", "2024-13-02 03:04:05"],
    }
    rows = spark.createDataFrame([(oid, t) for oid, ts in texts.items() for t in ts], "oid int, text string")

    def literals():
        value = F.lit(None).cast("string")
        for oid in texts:
            value = F.when(F.col("oid") == oid, pgtypes.json_literal_of(oid, F.col("text"))).otherwise(value)
        return {(r.oid, r.text): r.value for r in rows.withColumn("value", value).collect()}

    got = literals()
    for name in ("_SHORT_FLOAT", "_DAYS_AND_CLOCK", "_INTEGERS", "_TEXTS"):
        monkeypatch.setattr(pgtypes, name, "(?!)")
    assert got == literals()
    assert got[(pgtypes.INTERVAL, "3 days 01:30:00")] == '"P3DT1H30M"' and got[(1009, '{R,"F, x",NULL}')] == '["R","F, x",null]'
    assert got[(pgtypes.TIMESTAMP, "2024-01-02 03:04:05.120")] == '"2024-01-02T03:04:05.12Z"' and got[(pgtypes.FLOAT8, "NaN")] is None
