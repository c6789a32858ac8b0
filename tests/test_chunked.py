"""Piecewise operators against plain windows, with most rows in one key."""

import random

from pyspark.sql import Window, functions as F

from millrace.operators import chunked
from millrace.operators.skew import salted_join


def frame(spark, n=600):
    rng = random.Random(7)
    orders = rng.sample(range(-500, 5000), n)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), o, rng.randint(0, 1), rng.choice([None, rng.randint(1, 9)])) for o in orders]
    return spark.createDataFrame(rows, "k string, o bigint, o2 int, v int").cache()


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_pieces_equal_plain_windows(spark):
    df = frame(spark)
    w = Window.partitionBy("k").orderBy("o", "o2")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    for span in (1, 37, 10_000):
        order = ["o", "o2"]
        assert same(chunked.fill_forward(df, ["k"], order, F.col("v"), "x", span), df.withColumn("x", F.last("v", True).over(upto)))
        assert same(chunked.fill_forward(df, ["k"], order, F.col("v"), "x", span, inclusive=False),
                    df.withColumn("x", F.last("v", True).over(before)))
        assert same(chunked.previous(df, ["k"], order, ["o", "v"], "x", span), df.withColumn("x", F.lag(F.struct("o", "v")).over(w)))
        assert same(chunked.running_sum(df, ["k"], order, {"x": F.col("v")}, span),
                    df.withColumn("x", F.coalesce(F.sum("v").over(upto), F.lit(0))))
        assert same(chunked.row_numbers(df, ["k"], order, "x", span), df.withColumn("x", F.row_number().over(w).cast("bigint")))


def test_read_off_equals_plain_windows(spark):
    df = frame(spark)
    w = Window.partitionBy("k").orderBy("o", "o2")
    upto, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    plain = df.withColumns({"x": F.coalesce(F.sum("v").over(upto), F.lit(0)), "before": F.last("v", True).over(upto),
                            "after": F.first("v", True).over(on)}).filter("o2 = 1").drop("v")
    for span in (1, 37, 10_000):
        found = chunked.read_off(df, ["k"], ["o", "o2"], F.col("o2") == 1, {"x": F.col("v")}, F.col("v"), span)
        assert same(found, plain)
        assert same(chunked.read_off(df, ["k"], ["o", "o2"], F.col("o2") == 1, {"x": F.col("v")}, span=span), plain.drop("before", "after"))


def test_lookback_windows(spark):
    df = frame(spark)
    plain = df.withColumn("x", F.count("*").over(Window.partitionBy("k").orderBy("o").rangeBetween(-40, 0)))
    near = chunked.with_lookback(df, "o", 40, 64)
    w = Window.partitionBy("k", "_piece").orderBy("o").rangeBetween(-40, 0)
    assert same(near.withColumn("x", F.count("*").over(w)).filter("not _context").drop("_piece", "_context"), plain)


def test_salted_join_keeps_every_row(spark):
    df = frame(spark)
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3)], "k string, s int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert same(salted_join(df, side, ["k"], ["o"], how), df.join(side, ["k"], how))
