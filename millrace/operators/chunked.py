"""Ordered operators over groups of any size.

A plain window puts a whole group into one task. Here the order column is cut into
pieces of a fixed span; windows run per (keys, piece), and one summary row per piece
carries state across piece borders. A key that holds a third of all rows is spread over
as many tasks as it has pieces.

``order`` is a list of columns that orders a group totally; the first one is numeric and
``span`` is given in its unit.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

DEFAULT_SPAN = 1 << 20


def piece_of(order: str, span: int) -> Column:
    return F.expr(f"(`{order}` - pmod(`{order}`, {span})) div {span}").cast("bigint")


def _inside(keys, order):
    return Window.partitionBy(*keys, "_piece").orderBy(*order)


def _across(keys):
    return Window.partitionBy(*keys).orderBy("_piece") if keys else Window.orderBy("_piece")


def _rows_before(keys):
    return _across(keys).rowsBetween(Window.unboundedPreceding, -1)


def _attach(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(carry, [*keys, "_piece"], "left").drop("_piece")


def fill_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
                 span: int = DEFAULT_SPAN, inclusive: bool = True) -> DataFrame:
    """Add ``out``: the latest non-null ``value`` at or before each row (before it, if not inclusive)."""
    rows = df.withColumn("_piece", piece_of(order[0], span)).withColumn("_v", value)
    carry = (rows.groupBy(*keys, "_piece")
             .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_tail"))
             .withColumn("_carry", F.last("_tail", ignorenulls=True).over(_rows_before(keys)))
             .filter(F.col("_carry").isNotNull()).drop("_tail"))
    upto = Window.currentRow if inclusive else -1
    here = _inside(keys, order).rowsBetween(Window.unboundedPreceding, upto)
    rows = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(here))
    return (_attach(rows, carry, keys)
            .withColumn(out, F.coalesce("_v", "_carry")).drop("_v", "_carry"))


def previous(df: DataFrame, keys: list[str], order: list[str], cols: list[str], out: str,
             span: int = DEFAULT_SPAN) -> DataFrame:
    """Add ``out``: struct of ``cols`` of the row before (null for the first row of a key)."""
    rows = df.withColumn("_piece", piece_of(order[0], span)).withColumn("_v", F.struct(*cols))
    carry = (rows.groupBy(*keys, "_piece").agg(F.max_by("_v", F.struct(*order)).alias("_tail"))
             .withColumn("_carry", F.lag("_tail").over(_across(keys)))
             .filter(F.col("_carry").isNotNull()).drop("_tail"))
    rows = rows.withColumn("_v", F.lag("_v").over(_inside(keys, order)))
    return (_attach(rows, carry, keys)
            .withColumn(out, F.coalesce("_v", "_carry")).drop("_v", "_carry"))


def running_sum(df: DataFrame, keys: list[str], order: list[str], amounts: dict[str, Column],
                span: int = DEFAULT_SPAN) -> DataFrame:
    """Add each ``out: amount``: sum over all rows of the key up to and including this one."""
    held = {out: f"_v_{out}" for out in amounts}
    rows = df.withColumn("_piece", piece_of(order[0], span)).withColumns(
        {held[out]: amount for out, amount in amounts.items()})
    before = _rows_before(keys)
    carry = rows.groupBy(*keys, "_piece").agg(*[F.sum(v).alias(f"_t{v}") for v in held.values()])
    carry = carry.select(*keys, "_piece", *[F.sum(f"_t{v}").over(before).alias(f"_c{v}") for v in held.values()])
    here = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({v: F.sum(v).over(here) for v in held.values()})
    zero = F.lit(0)
    return (_attach(rows, carry, keys)
            .withColumns({out: F.coalesce(v, zero) + F.coalesce(f"_c{v}", zero) for out, v in held.items()})
            .drop(*held.values(), *[f"_c{v}" for v in held.values()]))


def read_off(df: DataFrame, keys: list[str], order: list[str], mark: Column, amounts: dict[str, Column],
             near: Column | None = None, span: int = DEFAULT_SPAN) -> DataFrame:
    """The rows where ``mark`` (of columns of ``order``) holds, with each ``out: amount`` as in ``running_sum`` and, given
    ``near``, its latest non-null value at or before the row (``before``) and its first one at or behind it (``after``).

    Rows move once: pieces and their summaries come from the same shuffle, and only marked rows are joined with
    what is carried. The look ahead sorts just the marked rows and the values that directly follow one.
    """
    held = {out: f"_v_{out}" for out in amounts}
    rows = df.withColumn("_piece", piece_of(order[0], span)).withColumns({held[out]: amount for out, amount in amounts.items()})
    seen = [] if near is None else ["_near"]
    rows = rows.withColumns({c: near for c in seen}).select(*keys, "_piece", *order, *held.values(), *seen).repartition(*keys, "_piece")
    # the last place of a piece is asked for so that the summaries read the columns the pieces do, and share their shuffle
    carry = rows.groupBy(*keys, "_piece").agg(
        F.max(F.struct(*order)).alias("_end"), *[F.sum(v).alias(f"_t{v}") for v in held.values()],
        *[f(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(n) for c in seen for f, n in ((F.max_by, "_tail"), (F.min_by, "_head"))])
    earlier = _rows_before(keys)
    later = Window.partitionBy(*keys).orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.last(n, ignorenulls=True).over(w).alias(c) for n, w, c in (("_tail", earlier, "_c_before"), ("_head", later, "_c_after")) if seen]
    carry = carry.filter("_end is not null").select(
        *keys, "_piece", *[F.sum(f"_t{v}").over(earlier).alias(f"_c{v}") for v in held.values()], *ends)
    inside = _inside(keys, order)
    here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"_s{v}": F.sum(v).over(here) for v in held.values()})
    if seen:
        rows = rows.withColumns({"before": F.last("_near", ignorenulls=True).over(here), "_next": F.lag(F.col("_near").isNull(), 1, True).over(inside)})
        rows = rows.filter(mark | (F.col("_next") & F.col("_near").isNotNull()))
        back = Window.partitionBy(*keys, "_piece").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("after", F.last("_near", ignorenulls=True).over(back))
    found = rows.filter(mark).join(carry, [*keys, "_piece"], "left")
    sums = [(F.coalesce(f"_s{v}", F.lit(0)) + F.coalesce(f"_c{v}", F.lit(0))).alias(out) for out, v in held.items()]
    return found.select(*keys, *order, *sums, *[F.coalesce(c, f"_c_{c}").alias(c) for c in ("before", "after") if seen])


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str,
                span: int = DEFAULT_SPAN) -> DataFrame:
    return running_sum(df, keys, order, {out: F.lit(1).cast("bigint")}, span)


def running_max(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
                span: int = DEFAULT_SPAN) -> DataFrame:
    """Add ``out``: the largest ``value`` before each row (null for the first row of a key)."""
    rows = df.withColumn("_piece", piece_of(order[0], span)).withColumn("_v", value)
    carry = rows.groupBy(*keys, "_piece").agg(F.max("_v").alias("_tail"))
    carry = carry.withColumn("_carry", F.max("_tail").over(_rows_before(keys))).drop("_tail")
    here = _inside(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_v", F.max("_v").over(here))
    return _attach(rows, carry, keys).withColumn(out, F.greatest("_v", "_carry")).drop("_v", "_carry")


def with_lookback(df: DataFrame, order: str, reach: int, span: int) -> DataFrame:
    """Copy rows near a piece's end into the next piece, flagged ``_context``.

    A range frame of up to ``reach`` units per (keys, ``_piece``) then sees every row it
    needs; drop the flagged copies afterwards. ``reach`` must not exceed ``span``.
    """
    if reach > span:
        raise ValueError("reach must not exceed span")
    own = piece_of(order, span)
    near_end = F.col(order) >= (own + 1) * span - reach
    pieces = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return (df.withColumn("_own", own).withColumn("_piece", F.explode(pieces))
            .withColumn("_context", F.col("_piece") != F.col("_own")).drop("_own"))
