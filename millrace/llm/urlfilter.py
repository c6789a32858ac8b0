"""URL filters: a dated list joined as of each capture's fetch time."""

from pyspark.sql import Column, DataFrame, Window, functions as F


def host_of(url) -> Column:
    """Lower-case host without user, port and final dot; null for what is no absolute URL."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of a dated list.

    ``entries``: key (a host or domain), verdict ('block' or 'allow'), action ('add' or 'remove'),
    at (timestamp). An entry holds from its addition until the next entry of its key and verdict,
    ``valid_to`` excluded and null while it still holds; additions of what holds already go on with
    it. At one moment a removal comes before an addition, so both together leave the entry on the
    list. Entries with a null are left out, as they can't be placed. Keys are lower-cased.
    """
    known = (entries.select(F.lower("key").alias("key"), "verdict", "action", "at").dropna().distinct()
             .groupBy("key", "verdict", "at").agg(F.max((F.col("action") == "add").cast("int")).alias("on")))
    by_time = Window.partitionBy("key", "verdict").orderBy("at")
    changes = known.withColumn("was", F.coalesce(F.lag("on").over(by_time), F.lit(0))).filter("on <> was")
    return (changes.withColumn("valid_to", F.lead("at").over(by_time)).filter("on = 1")
            .select("key", "verdict", F.col("at").alias("valid_from"), "valid_to"))


def judged(captures: DataFrame, entries: DataFrame, id_col: str = "page_id") -> DataFrame:
    """For every capture (id, url, fetched_at) the entry that decides on it at its fetch time.

    Every domain that the host lies in is looked up, down to the top level. Of the entries active at
    ``fetched_at`` the longest key decides, and of equal keys 'allow'. Returns id, host, fetched_at,
    decision ('block' or 'allow'; 'allow' too if nothing is active), matched_key and valid_from (null
    if nothing is active). A capture without host or time matches nothing. Repeated rows each count.

    Captures meet the list by equal keys, with the as-of condition beside, never by a cross join. The
    join comes straight after the scan, so adaptive execution can split a key that most captures
    share (a top-level domain, a hot host) over tasks; the decision is a maximum per host and fetch
    time, combined before its shuffle.
    """
    rows = captures.select(F.col(id_col).alias(id_col), host_of(F.col("url")).alias("host"), F.col("fetched_at"))
    asked = rows.filter("host is not null and fetched_at is not null").select("host", "fetched_at").distinct()
    labels = F.split("host", r"\.")
    keys = asked.withColumn("labels", labels).withColumn(
        "key", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")),
                                     lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))))
    active = keys.join(intervals(entries), "key").filter(
        (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    best = active.groupBy("host", "fetched_at").agg(F.max(F.struct(
        F.length("key").alias("size"), (F.col("verdict") == "allow").alias("allow"), "key", "valid_from")).alias("m"))
    found = rows.join(best, ["host", "fetched_at"], "left")
    return found.select(id_col, "host", "fetched_at",
                        F.when(F.col("m.allow") | F.col("m").isNull(), "allow").otherwise("block").alias("decision"),
                        F.col("m.key").alias("matched_key"), F.col("m.valid_from").alias("valid_from"))
