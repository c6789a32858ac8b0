"""Matching transactions to subscriptions and deciding what each one receives.

Subscribers that share anchor and policy get the same events, so filtering and counting
happen once per *anchor class* (transaction, anchor, policy version). The per-subscriber
pairs, far more numerous, are only built where a result needs one row for each.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lsn_order
from ..schemas import TX
from ..session import fits, stage
from . import chunked
from .skew import join_few, salted_join

ANCHOR = ["kind", "schema_name", "table_name", "pk"]
CLASS = ["policy_id", "version"]
# Policy versions, or grants, of up to so many bytes in all are joined by broadcast.
BROADCAST_POLICIES = 8 << 20
# fixed value: most changes one event may carry
MAX_CHANGES = 10_000


def after_start(commit_lsn: Column, start_lsn: Column) -> Column:
    return commit_lsn > start_lsn


def same_schema(change_schema: Column, sub_schema: Column) -> Column:
    return change_schema == sub_schema


def live_at(commit_lsn: Column, start_lsn: Column, end_lsn: Column) -> Column:
    return after_start(commit_lsn, start_lsn) & (end_lsn.isNull() | (commit_lsn <= end_lsn))


# ---- what a transaction touches ----------------------------------------------------

def touched_rows(changes: DataFrame) -> DataFrame:
    """One row per (transaction, schema, table, pk); aggregated before the shuffle."""
    return changes.groupBy(*TX, "pk", "table_name", "schema_name").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def followed_changes(changes: DataFrame, subs: DataFrame) -> DataFrame:
    """Changes of rows that a row-level subscription follows. They move by row, so ``touched_rows`` of them moves nothing more."""
    keys = ["pk", "table_name", "schema_name"]
    return changes.join(subs.filter("kind = 'exact'").select(*keys).distinct(), keys, "left_semi")


def touched_tables(touched: DataFrame) -> DataFrame:
    """Per (transaction, schema, table): number of rows and the multi-root verdict.

    More than one distinct key makes a transaction multi-root. Rows without a key are
    skipped while no keyed row came before them and count as a different key afterwards.
    """
    keyed = F.col("pk") != ""
    roots = F.count(F.when(keyed, 1))
    late_blank = F.max(F.when(~keyed, F.col("last_seq"))) > F.min(F.when(keyed, F.col("first_seq")))
    return touched.groupBy(*TX, "schema_name", "table_name").agg(
        F.sum("n").alias("n"), roots.alias("n_roots"),
        ((roots > 1) | F.coalesce(late_blank, F.lit(False))).alias("multi_root"))


def multi_root(changes: DataFrame) -> DataFrame:
    return touched_tables(touched_rows(changes))


# ---- matching ----------------------------------------------------------------------

def _wildcard_side(subs: DataFrame) -> DataFrame:
    return subs.filter(F.col("kind") == "wildcard").drop("pk")


def match_exact(touched: DataFrame, subs: DataFrame) -> DataFrame:
    """Row-level matches: touched rows x exact subscriptions on schema, table and pk."""
    exact = subs.filter(F.col("kind") == "exact")
    return salted_join(touched.select(*TX, "schema_name", "table_name", "pk"), exact,
                       ["pk", "table_name", "schema_name"], TX)


def match_wildcard(tables: DataFrame, subs: DataFrame) -> DataFrame:
    """Table-level matches. There are few tables, which adaptive execution splits."""
    return (salted_join(tables.select(*TX, "schema_name", "table_name"), _wildcard_side(subs),
                        ["schema_name", "table_name"], TX)
            .withColumn("pk", F.lit(None).cast("string")))


def eligible(changes: DataFrame, subs: DataFrame) -> DataFrame:
    """One row per (transaction, subscription): a subscription has one anchor, so exact and
    wildcard matches of touched rows and tables cannot repeat a pair."""
    touched = touched_rows(changes)
    return match_exact(touched, subs).unionByName(match_wildcard(touched_tables(touched), subs))


def match_live(changes: DataFrame, subs: DataFrame) -> DataFrame:
    pairs = eligible(changes, subs)
    return pairs.filter(live_at(F.col("commit_lsn"), F.col("start_lsn"), F.col("end_lsn")))


def expand_tx(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """All changes of a matched transaction in the subscription's schema."""
    own = pairs.select(*TX, "schema_name", "sub_id", "kind", F.col("table_name").alias("anchor_table"),
                       F.col("pk").alias("anchor_pk"))
    anchor = (F.col("table_name") == F.col("anchor_table")) & (F.col("anchor_pk").isNull()
                                                              | (F.col("pk") == F.col("anchor_pk")))
    return changes.join(own, [*TX, "schema_name"]).withColumn("anchor", anchor)


# ---- totals along the log, without pairs -------------------------------------------

LOG_KEYS = ["_pk", "table_name", "schema_name", "kind"]
# behind every position
END = 1 << 62


def by_log(df: DataFrame) -> DataFrame:
    """Add ``_pk``: the key of the anchor's log, blank for wildcards."""
    return df.withColumn("_pk", F.coalesce("pk", F.lit("")))


def met_anchors(touched: DataFrame, tables: DataFrame, subs: DataFrame, values: tuple[str, ...] = ()) -> DataFrame:
    """One row per (transaction, anchor it meets) with ``n_anchored``, the anchor's subscriptions, and ``values`` of the
    touched row or table. ``touched`` may be of the ``followed_changes`` alone."""
    groups = by_log(subs).groupBy(*LOG_KEYS).agg(F.count("*").alias("n_anchored"))
    rows = touched.select(*TX, "schema_name", "table_name", F.col("pk").alias("_pk"), F.lit("exact").alias("kind"), *values)
    whole = tables.select(*TX, "schema_name", "table_name", F.lit("").alias("_pk"), F.lit("wildcard").alias("kind"), *values)
    return salted_join(rows, groups.filter("kind = 'exact'"), LOG_KEYS, TX).unionByName(
        join_few(whole, groups.filter("kind = 'wildcard'"), LOG_KEYS, TX))


def totals_along(rows: DataFrame, subs: DataFrame, keys: list[str], values: dict[str, Column], span: int,
                 nearest: str | None = None) -> DataFrame:
    """Per subscription, ``at_start`` and ``at_last``: structs of sums (``sum_<value>``) over the rows
    of its keys up to ``start_lsn`` and up to ``last_lsn`` (null: all).

    ``nearest`` names a column whose value in the last row up to the position (``before``) and in
    the first one behind it (``after``) is added. Running totals are read off at the distinct
    positions asked for, so work is rows + subscriptions, not their product.
    """
    lsn = rows.schema["commit_lsn"].dataType
    own = ["sub_id", "start_lsn", "last_lsn", *keys]
    asked = subs.select(*own, F.explode(F.array(
        F.struct(F.lit(True).alias("_first"), F.col("start_lsn").cast(lsn).alias("commit_lsn")),
        F.struct(F.lit(False).alias("_first"), F.coalesce("last_lsn", F.lit(END)).cast(lsn).alias("commit_lsn"))))
        .alias("_a")).select(*own, "_a.*")
    near = [F.col(nearest).alias("_near")] if nearest else []
    log = rows.select(*keys, "commit_lsn", *[c.alias(v) for v, c in values.items()], *near, F.lit(0).alias("_mark"))
    marks = asked.select(*keys, "commit_lsn").distinct().withColumn("_mark", F.lit(1))
    # marks sort behind the rows at their position
    order, out = ["commit_lsn", "_mark"], [f"sum_{v}" for v in values]
    found = chunked.read_off(log.unionByName(marks, allowMissingColumns=True), keys, order, F.col("_mark") == 1,
                             {f"sum_{v}": F.col(v) for v in values}, F.col("_near") if nearest else None, span)
    if nearest:
        out = [*out, "before", "after"]
    read = salted_join(asked, found.select(*keys, "commit_lsn", *out), [*keys, "commit_lsn"], ["sub_id"])
    held = F.struct(*out)
    return read.groupBy(*own).agg(F.max(F.when(F.col("_first"), held)).alias("at_start"),
                                  F.max(F.when(~F.col("_first"), held)).alias("at_last"))


def within(value: str) -> Column:
    """A total of ``totals_along`` behind the start and up to the last position; 0 if that comes first."""
    inside = F.col("last_lsn").isNull() | (F.col("last_lsn") >= F.col("start_lsn"))
    return F.when(inside, F.col(f"at_last.sum_{value}") - F.col(f"at_start.sum_{value}")).otherwise(F.lit(0).cast("bigint"))


def _tx_totals(changes: DataFrame, subs: DataFrame, last: Column, span: int) -> DataFrame:
    met = met_anchors(touched_rows(followed_changes(changes, subs)), touched_tables(touched_rows(changes)), subs)
    one = {"n": F.lit(1).cast("bigint")}
    return totals_along(met, by_log(subs).withColumn("last_lsn", last), LOG_KEYS, one, span, nearest="tx_id")


def live_totals(changes: DataFrame, subs: DataFrame, span: int) -> DataFrame:
    """``match_live`` by subscription, without its pairs: number of transactions, first and last in log order."""
    found = _tx_totals(changes, subs, F.col("end_lsn"), span)
    return found.select("sub_id", "kind", within("n").alias("n_tx"), F.col("at_start.after").alias("first_tx"),
                        F.col("at_last.before").alias("last_tx")).filter("n_tx > 0")


def start_totals(changes: DataFrame, subs: DataFrame, span: int) -> DataFrame:
    """Matched transactions of each subscription behind its start and up to it, ended or not."""
    found = _tx_totals(changes, subs, F.lit(None).cast("bigint"), span)
    return found.select("sub_id", within("n").alias("n_after"), F.col("at_start.sum_n").alias("n_before")).filter(
        "n_after + n_before > 0")


def change_totals(changes: DataFrame, subs: DataFrame, span: int) -> DataFrame:
    """``expand_tx`` of the live matches by subscription, without its rows: transactions, changes in the
    subscription's schema that come with them, and those of them on its anchor.

    Changes are counted once per transaction and anchor; running totals along each anchor's log are read off
    where a subscription starts and ends.
    """
    # a transaction has one row per table here, also with what it changed in the table's schema
    in_schema = Window.partitionBy(*TX, "schema_name")
    tables = touched_tables(touched_rows(changes)).select(*TX, "schema_name", "table_name", "n").withColumn("n_changes", F.sum("n").over(in_schema))
    tables = stage(tables, "tables")
    table = [*TX, "schema_name", "table_name"]
    rows = touched_rows(followed_changes(changes, subs)).join(tables.select(*table, "n_changes"), table)
    met = met_anchors(rows, tables, subs, ("n", "n_changes"))
    values = {"n": F.lit(1).cast("bigint"), "changes": F.col("n_changes"), "own": F.col("n")}
    found = totals_along(met, by_log(subs).withColumn("last_lsn", F.col("end_lsn")), LOG_KEYS, values, span)
    return found.select("sub_id", "kind", within("n").alias("n_tx"), within("changes").alias("n_changes"),
                        within("own").alias("n_anchor")).filter("n_tx > 0")


def wildcard_totals(tables: DataFrame, subs: DataFrame) -> DataFrame:
    """``match_wildcard`` by subscription: transactions are counted once per table."""
    anchors = ["schema_name", "table_name"]
    seen = tables.groupBy(*anchors).agg(F.count("*").alias("n_tx"), F.min("tx_id").alias("first_tx"), F.max("tx_id").alias("last_tx"))
    return salted_join(_wildcard_side(subs), seen, anchors, ["sub_id"]).select("sub_id", "n_tx", "first_tx", "last_tx")


# ---- policies ----------------------------------------------------------------------

def policy_asof(rows: DataFrame, versions: DataFrame, broadcast: int = BROADCAST_POLICIES) -> DataFrame:
    """Add the policy version in force: the newest with ``refresh_lsn < commit_lsn``.

    Versions become position intervals, with one of no version in front of the first. Every row
    stays: before the first version, or without any, ``version`` is null and grants nothing.
    """
    later = Window.partitionBy("policy_id").orderBy("refresh_lsn")
    spans = versions.select("policy_id", "version", F.col("refresh_lsn").alias("_from"),
                            F.lead("refresh_lsn").over(later).alias("_to"))
    before = versions.groupBy("policy_id").agg(F.min("refresh_lsn").alias("_to")).select(
        "policy_id", F.lit(None).cast(versions.schema["version"].dataType).alias("version"),
        F.lit(-(1 << 62)).cast("long").alias("_from"), "_to")
    spans = spans.unionByName(before)
    if fits(versions, broadcast):
        joined = rows.join(F.broadcast(spans), "policy_id", "left")
    else:
        joined = salted_join(rows, spans, ["policy_id"], TX, how="left")
    inside = (F.col("commit_lsn") > F.col("_from")) & (F.col("_to").isNull() | (F.col("commit_lsn") <= F.col("_to")))
    return joined.filter(F.col("_from").isNull() | inside).drop("_from", "_to")


def _with_columns(changes: DataFrame, grants: DataFrame, broadcast: int) -> DataFrame:
    if fits(grants, broadcast):
        return changes.join(F.broadcast(grants), [*CLASS, "table_name"])
    return salted_join(changes, grants, [*CLASS, "table_name"], [*TX, "seq"])


def survives(op: Column, names: Column, pk_col: Column, columns: Column) -> Column:
    """Whether a change (with its column ``names``) of a granted table is still worth sending.

    Inserts and deletes always are; an update needs a listed column besides the key.
    """
    others = F.array_remove(F.coalesce(names, F.array().cast("array<string>")), pk_col)
    return op.isin("insert", "delete") | ((op == "update") & F.coalesce(F.arrays_overlap(others, columns), F.lit(False)))


def visible(data: Column, pk_col: Column, columns: Column) -> Column:
    return F.map_filter(data, lambda k, v: (k == pk_col) | F.array_contains(columns, k))


def whitelisted(changes: DataFrame, grants: DataFrame, names: Column | None = None,
                broadcast: int = BROADCAST_POLICIES) -> DataFrame:
    """Surviving changes with the granted ``columns``; the payload is not narrowed yet."""
    names = F.map_keys("data") if names is None else names
    return _with_columns(changes, grants, broadcast).filter(
        survives(F.col("op"), names, F.col("pk_col"), F.col("columns")))


def update_names() -> Column:
    return F.when(F.col("op") == "update", F.map_keys("data"))


def without_payload(changes: DataFrame) -> DataFrame:
    """What counting needs of a change: an update's column ``names`` (as they are, where changes carry them) instead of its values."""
    names = F.col("names") if "names" in changes.columns else update_names().alias("names")
    return changes.select(*TX, "seq", "schema_name", "table_name", "op", "pk", "pk_col", names)


def apply_whitelist(changes: DataFrame, grants: DataFrame, broadcast: int = BROADCAST_POLICIES) -> DataFrame:
    """Narrow each change (carrying policy_id, version) to what its policy lists."""
    kept = whitelisted(changes, grants, broadcast=broadcast)
    narrow = visible(F.col("data"), F.col("pk_col"), F.col("columns"))
    return kept.withColumn("data", F.when(F.col("op") != "delete", narrow)).drop("columns")


# ---- anchor classes ----------------------------------------------------------------

def anchor_classes(touched: DataFrame, tables: DataFrame, subs: DataFrame, versions: DataFrame) -> DataFrame:
    """Matched (transaction, anchor, policy version) with the multi-root verdict.

    ``live`` is false where no subscription of the class has started yet: nothing needs
    to be filtered for those.
    """
    groups = subs.groupBy(*ANCHOR, "policy_id").agg(F.min("start_lsn").alias("first_start"))
    verdicts = tables.select(*TX, "schema_name", "table_name", "multi_root")
    exact = match_exact(touched, groups).join(verdicts, [*TX, "schema_name", "table_name"])
    wildcard = join_few(verdicts, _wildcard_side(groups), ["schema_name", "table_name"], TX)
    both = exact.unionByName(wildcard.withColumn("pk", F.lit(None).cast("string")))
    both = both.withColumn("live", F.col("commit_lsn") > F.col("first_start")).drop("first_start")
    return policy_asof(both, versions)


def class_changes(changes: DataFrame, classes: DataFrame) -> DataFrame:
    """Changes of the transactions some class receives, once per (transaction, policy version)."""
    wanted = classes.filter("live and not multi_root").select(*TX, "schema_name", *CLASS).distinct()
    return changes.join(wanted, [*TX, "schema_name"])


def kept_rows(kept: DataFrame) -> DataFrame:
    """Surviving changes of each class, reduced to what counting needs (no shuffle)."""
    return kept.select(*TX, *CLASS, "schema_name", "table_name", "pk")


def anchor_survives(classes: DataFrame, rows: DataFrame, followed: DataFrame) -> DataFrame:
    """Add to each class ``n_anchor`` and ``n_kept``: surviving changes of its anchor and in all.

    ``rows`` are the ``kept_rows`` of the same classes, ``followed`` at least those of them that a row anchor follows.
    Counts per table serve all table anchors at once; only the followed rows are counted by key.
    """
    by_class = [*TX, *CLASS, "schema_name"]
    by_row = [*by_class, "table_name", "pk"]
    tables = rows.groupBy(*by_class, "table_name").agg(F.count("*").alias("n"))
    # one entry per table of the schema that the transaction touches
    totals = tables.groupBy(*by_class).agg(
        F.sum("n").alias("n_kept"), F.map_from_entries(F.collect_list(F.struct("table_name", "n"))).alias("_tables"))
    exact = classes.filter("kind = 'exact'")
    per_row = followed.join(exact.select(*by_row).distinct(), by_row).groupBy(*by_row).agg(F.count("*").alias("_n"))
    wildcard = classes.filter("kind = 'wildcard'").withColumn("_n", F.lit(None).cast("bigint"))
    both = exact.join(per_row, by_row, "left").unionByName(wildcard).join(totals, by_class, "left")
    anchor = F.when(F.col("kind") == "exact", F.col("_n")).otherwise(F.col("_tables")[F.col("table_name")])
    return (both.withColumn("n_anchor", F.coalesce(anchor, F.lit(0)))
            .withColumn("n_kept", F.coalesce("n_kept", F.lit(0))).drop("_n", "_tables"))


def class_outcomes(classes: DataFrame, max_changes: int = MAX_CHANGES, over_bytes: DataFrame | None = None) -> DataFrame:
    """First test that hits: multi_root, silent, tx_too_large (changes, then bytes), delivered.

    ``over_bytes`` lists the (transaction, schema, policy version) whose event is too long.
    """
    too_large = F.col("n_kept") > max_changes
    if over_bytes is not None:
        marked = over_bytes.select(*TX, "schema_name", *CLASS).distinct().withColumn("_long", F.lit(True))
        classes = classes.join(marked, [*TX, "schema_name", *CLASS], "left")
        too_large = too_large | F.coalesce(F.col("_long"), F.lit(False))
    outcome = (F.when(F.col("multi_root"), "multi_root").when(F.col("n_anchor") == 0, "silent")
               .when(too_large, "tx_too_large").otherwise("delivered"))
    sent = F.col("outcome") == "delivered"
    return (classes.withColumn("outcome", outcome)
            .withColumn("n_delivered", F.when(sent, F.col("n_kept")).otherwise(0))
            .withColumn("n_beyond_anchor", F.when(sent, F.col("n_kept") - F.col("n_anchor")).otherwise(0))
            .drop("_long"))


def first_violation(classes: DataFrame, subs: DataFrame, span: int = chunked.DEFAULT_SPAN) -> DataFrame:
    """Add ``violation_lsn`` to subscriptions: the first too-large transaction they meet.

    Later transactions find them disconnected. The first violation of an anchor and policy behind each start
    is carried back along the log, so work is violating classes + subscriptions, not their product.
    """
    keys = [*LOG_KEYS, "policy_id"]
    lsn = classes.schema["commit_lsn"].dataType
    bad = by_log(classes.filter("outcome = 'tx_too_large'")).select(
        *keys, "commit_lsn", F.col("commit_lsn").alias("_near"), F.lit(0).alias("_mark")).distinct()
    asked = by_log(subs).withColumn("commit_lsn", F.col("start_lsn").cast(lsn)).select("sub_id", "end_lsn", *keys, "commit_lsn")
    marks = asked.select(*keys, "commit_lsn").distinct().withColumn("_mark", F.lit(1))
    # backwards a start comes before the transaction at its position, which it excludes
    both = (bad.unionByName(marks, allowMissingColumns=True)
            .withColumn("_back", -F.col("commit_lsn")).withColumn("_rank", -F.col("_mark")))
    found = chunked.fill_forward(both, keys, ["_back", "_rank"], F.col("_near"), "violation_lsn", span)
    found = found.filter("_mark = 1 and violation_lsn is not null").select(*keys, "commit_lsn", "violation_lsn")
    hits = salted_join(asked, found, [*keys, "commit_lsn"], ["sub_id"])
    first = hits.filter(F.col("end_lsn").isNull() | (F.col("violation_lsn") <= F.col("end_lsn"))).select("sub_id", "violation_lsn")
    return subs.join(first, "sub_id", "left")


def _by_anchor(classes: DataFrame, subs: DataFrame, spread: list[str]) -> DataFrame:
    """Classes x subscriptions of the same anchor and policy (pk is null for wildcards)."""
    keys = ["_pk", "policy_id", "table_name", "schema_name", "kind"]
    return salted_join(by_log(classes), by_log(subs).drop("pk"), keys, spread).drop("_pk")


def present(commit_lsn: Column) -> Column:
    """Whether a subscription still existed when the transaction committed."""
    return ((F.col("end_lsn").isNull() | (commit_lsn <= F.col("end_lsn")))
            & (F.col("violation_lsn").isNull() | (commit_lsn <= F.col("violation_lsn"))))


def outcomes(classes: DataFrame, subs: DataFrame) -> DataFrame:
    """One row per (transaction, subscription). ``subs`` carry ``violation_lsn``."""
    pairs = _by_anchor(classes, subs.select("sub_id", *ANCHOR, "policy_id", "start_lsn", "end_lsn", "violation_lsn"),
                       TX)
    early = F.col("commit_lsn") <= F.col("start_lsn")
    return (pairs.filter(present(F.col("commit_lsn")))
            .select(*TX, "sub_id", "kind", "schema_name", "policy_id", "version",
                    F.when(early, "below_start").otherwise(F.col("outcome")).alias("outcome"),
                    F.when(early, 0).otherwise(F.col("n_delivered")).alias("n_delivered"),
                    F.when(early, 0).otherwise(F.col("n_beyond_anchor")).alias("n_beyond_anchor")))


def stretches(subs: DataFrame) -> DataFrame:
    """Per subscription the stretch of its anchor's log that it gets: behind ``start_lsn`` up to ``last_lsn`` (null: all)."""
    held = subs.select("sub_id", *ANCHOR, "policy_id", "start_lsn", F.least("end_lsn", "violation_lsn").alias("last_lsn"))
    return held.filter("last_lsn is null or last_lsn > start_lsn")


def met_stretches(classes: DataFrame, held: DataFrame) -> DataFrame:
    """The ``stretches`` that reach over a transaction of their anchor, or over a gap between two of them."""
    keys = [*LOG_KEYS, "policy_id"]
    ends = by_log(classes).groupBy(*keys).agg(F.min("commit_lsn").alias("_low"), F.max("commit_lsn").alias("_top"))
    met = salted_join(by_log(held), ends, keys, ["sub_id"]).filter("_top > start_lsn and (last_lsn is null or last_lsn >= _low)")
    return met.select(*held.columns)


def receivers(classes: DataFrame, subs: DataFrame, span: int = chunked.DEFAULT_SPAN) -> DataFrame:
    """``outcomes`` behind the start alone: (transaction, subscription) with the class they meet in."""
    return along(classes.select(*TX, *ANCHOR, *CLASS), stretches(subs), span).select(*TX, "sub_id", "kind", "schema_name", *CLASS)


def along(rows: DataFrame, held: DataFrame, span: int = chunked.DEFAULT_SPAN, per: list[str] | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """``rows`` of anchors' logs x the ``stretches`` that cover them; both sides agree in the columns ``per`` too.
    ``bounds`` is a frame of at least the same positions that is read for the first and the last one.

    A table-level subscription is looked up only in the pieces of the log that its stretch covers, so transactions
    before its start or behind its end aren't paired with it. Pairs are made where the rows of a piece lie and hold what is
    read of them alone, so a reader that counts moves none. The pieces of a stretch aren't broadcast: a plan
    estimates them as one row.
    """
    per = per or []
    keys = ["policy_id", "table_name", "schema_name", "kind", *per]
    rows = rows.withColumn("_at", lsn_order(F.col("commit_lsn")))
    held = held.filter("last_lsn is null or last_lsn >= 0").withColumns(
        {"_from": lsn_order(F.col("start_lsn")), "_to": lsn_order(F.col("last_lsn"))})
    exact = salted_join(by_log(rows.filter("kind = 'exact'")), by_log(held.filter("kind = 'exact'")).drop("pk"), ["_pk", *keys], TX).drop("_pk")
    piece = chunked.piece_of("commit_lsn", span)
    tables = rows.filter("kind = 'wildcard'").withColumn("_piece", piece)
    ends = (rows if bounds is None else bounds).filter("kind = 'wildcard'").agg(F.min(piece), F.max(piece)).first()
    low, top = (F.lit(x).cast("bigint") for x in ends)
    first, last = F.greatest(chunked.piece_of("start_lsn", span), low), F.least(chunked.piece_of("last_lsn", span), top)
    spans = held.filter("kind = 'wildcard'").drop("pk").filter((first <= last) & low.isNotNull()).withColumn("_piece", F.explode(F.sequence(first, last)))
    pairs = spans.join(tables.hint("merge"), ["_piece", *keys]).drop("_piece")
    inside = (F.col("_from").isNull() | (F.col("_at") > F.col("_from"))) & (F.col("_to").isNull() | (F.col("_at") <= F.col("_to")))
    found = [df.filter(inside).drop("_at", "_from", "_to", "start_lsn", "last_lsn") for df in (exact, pairs)]
    return found[0].unionByName(found[1])
