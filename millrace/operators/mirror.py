"""Current state from changes: inserts replace, updates merge, deletes remove."""

from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage
from . import chunked
from .skew import join_few, salted_join

ROW = ["pk", "table_name", "schema_name"]  # most telling first, see schemas.TX
# rows of up to so many changes are folded in one task
MANY_CHANGES = 1_000


def cells(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per written column, plus a row without ``col`` where an insert or delete
    starts the row afresh (its value names the operation)."""
    at = F.struct("commit_lsn", "seq").alias("at")
    fresh = F.when(F.col("op").isin("insert", "delete"),
                   F.array(F.struct(F.lit(None).cast("string").alias("col"), F.col("op").alias("value"))).cast(
                       "array<struct<col:string,value:string>>"))
    nothing = F.array().cast("array<struct<col:string,value:string>>")
    written = F.transform(F.map_entries("data"), lambda e: F.struct(e["key"].alias("col"), e["value"].alias("value")))
    both = F.concat(F.coalesce(fresh, nothing), F.coalesce(F.when(F.col("op") != "delete", written), nothing))
    return changes.select(*(by or []), *ROW, at, F.explode(both).alias("c")).select(*(by or []), *ROW, "at", "c.*")


def latest_cells(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Last write per cell. A plain aggregation: a row written by a third of all changes is
    reduced to one value per column before the shuffle."""
    return rows.groupBy("pk", "col", *(by or []), *ROW[1:]).agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))


def standing(latest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cells written at or after the row's last insert or delete."""
    row = Window.partitionBy(*(by or []), *ROW)  # as many rows as the table has columns
    start = F.max(F.when(F.col("col").isNull(), F.col("at"))).over(row)
    return (latest.withColumn("_start", start)
            .filter(F.col("col").isNotNull() & (F.col("_start").isNull() | (F.col("at") >= F.col("_start"))))
            .drop("_start", "at"))


def _folded(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per mirrored row with its columns in the map ``data``, for rows of a bounded number of changes."""
    keys = [*(by or []), *ROW]
    empty = F.create_map().cast("map<string,string>")
    change = F.struct(F.struct("commit_lsn", "seq").alias("at"), "op", F.coalesce("data", empty).alias("data"))

    def merged(held, c):
        written = F.map_concat(F.map_filter(held, lambda k, v: ~F.map_contains_key(c["data"], k)), c["data"])
        return F.when(c["op"] == "delete", empty).when(c["op"] == "insert", c["data"]).otherwise(written)

    in_order = F.array_sort("_all", lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    only = F.col("_all")[0]
    data = F.when(F.size("_all") > 1, F.aggregate(in_order, empty, merged)).when(only["op"] != "delete", only["data"])
    # changes move once, each as one record, and are sorted as such; what is laid out in cells moves no more
    rows = changes.repartition(*keys).groupBy(*keys).agg(F.collect_list(change).alias("_all"))
    return rows.select(*keys, data.alias("data")).filter("size(data) > 0")


def mirror_rows(changes: DataFrame, by: list[str] | None = None, many: int = MANY_CHANGES) -> DataFrame:
    """State after all changes, one row per mirrored row with its columns in the map ``data``.

    The changes of a row are folded in one task. Rows of more than ``many`` changes are told apart by a count and
    reduced to their last write per cell before they move.
    """
    keys = [*(by or []), *ROW]
    hot = stage(changes.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > many).drop("_n"), "hot-rows")
    if hot.isEmpty():
        return _folded(changes, by)
    few = _folded(join_few(changes, hot, keys, ["seq"], "left_anti"), by)
    return few.unionByName(nested(_by_cell(join_few(changes, hot, keys, ["seq"], "left_semi"), by), by))


def _by_cell(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    return standing(latest_cells(cells(changes, by), by), by)


def flat(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cells of ``mirror_rows``."""
    return rows.select(*(by or []), *ROW, F.explode("data").alias("col", "value"))


def build_mirror(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Flat state (…, schema_name, table_name, pk, col, value) after all changes."""
    return flat(mirror_rows(changes, by), by)


def nested(mirror: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per mirrored row, columns back in a map."""
    return mirror.groupBy(*(by or []), *ROW).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "value")))).alias("data"))


def reset_on_error(changes: DataFrame, resets: DataFrame) -> DataFrame:
    """Changes that still count per ``sub_id``: those after its last reset."""
    last = resets.groupBy("sub_id").agg(F.max("commit_lsn").alias("_reset"))
    joined = salted_join(changes, last, ["sub_id"], ["commit_lsn", "seq"], how="left")
    return joined.filter(F.col("_reset").isNull() | (F.col("commit_lsn") > F.col("_reset"))).drop("_reset")


def snapshot_delta(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """State from a loaded snapshot (flat cells with ``snapshot_lsn``) and the changes after it."""
    table = ["schema_name", "table_name"]
    cut = snapshot.groupBy(*table).agg(F.max("snapshot_lsn").alias("_cut"))
    later = salted_join(changes, cut, table, ["commit_lsn", "seq"], how="left")
    later = later.filter(F.col("_cut").isNull() | (F.col("commit_lsn") > F.col("_cut")))
    base = snapshot.select(*ROW, F.struct(F.col("snapshot_lsn").alias("commit_lsn"),
                                          F.lit(-1).cast("bigint").alias("seq")).alias("at"), "col", "value")
    return standing(latest_cells(base.unionByName(cells(later))))


def root_keys(held: DataFrame, root_table: str, parents: dict[str, tuple[str, str]]) -> DataFrame:
    """(schema_name, table_name, pk, root_pk) of the child rows whose chain of foreign keys ends in a root key.

    Every row points at its parent; each round a pointer moves to where its target points, so it spans twice as
    many steps, and a chain of tables takes rounds in the logarithm of its depth. Rows whose chain is broken, or
    goes round in a circle, have no root.
    """
    held = held if "data" in held.columns else nested(held)
    link, up = F.lit(None).cast("string"), F.lit(None).cast("string")
    for child, (column, parent) in parents.items():
        link = F.when(F.col("table_name") == child, F.col("data")[column]).otherwise(link)
        up = F.when(F.col("table_name") == child, parent).otherwise(up)
    at = held.withColumn("_link", link).filter(F.col("_link") != "null").select(
        *ROW, up.alias("up_table"), F.regexp_replace("_link", '^"|"$', "").alias("up_pk"))
    if any(parent != root_table for _, parent in parents.values()):
        at, steps = stage(at, "pointers"), 1
        on = F.col("up_table") != root_table
        # a chain can't have more steps than there are rows on their way: what is left then goes in circles
        while (left := at.filter(on).count()) and steps <= 2 * left:
            ahead = at.select("schema_name", F.col("table_name").alias("up_table"), F.col("pk").alias("up_pk"),
                              F.col("up_table").alias("_table"), F.col("up_pk").alias("_pk"))
            moved = salted_join(at.filter(on), ahead, ["up_pk", "up_table", "schema_name"], ["pk"])
            moved = moved.select(*ROW, F.col("_table").alias("up_table"), F.col("_pk").alias("up_pk"))
            at, steps = stage(at.filter(~on).unionByName(moved), "pointers"), 2 * steps
        at = at.filter(~on)
    return at.select(*ROW, F.col("up_pk").alias("root_pk"))


def entity_view(mirror: DataFrame, root_table: str, children: dict[str, str | tuple[str, str]]) -> DataFrame:
    """Mirrored roots with the rows below them.

    ``children`` maps a table to its foreign-key column, which points at the root table, or to (column, parent
    table) for children of children. Output: root_pk, then the cells of the root itself and of each row below it.
    ``mirror`` is given in cells or, cheaper, as ``mirror_rows``. It is worked out once and read from the shared
    folder by the passes here, which move whole rows; cells are laid out at the end.
    """
    parents = {c: (link, root_table) if isinstance(link, str) else link for c, link in children.items()}
    rows = mirror.filter(F.col("table_name").isin(root_table, *parents))
    held = stage(rows if "data" in rows.columns else nested(rows), "entity-rows")
    roots = held.filter(F.col("table_name") == root_table)
    own = roots.select("schema_name", F.col("pk").alias("root_pk"), "table_name", "pk", "data")
    keys = roots.select("schema_name", F.col("pk").alias("root_pk"))
    links = salted_join(root_keys(held, root_table, parents), keys, ["schema_name", "root_pk"], ["pk"], how="left_semi")
    below = held.filter(F.col("table_name").isin(*parents)).join(links.filter(F.col("table_name") != root_table), ROW)
    both = own.unionByName(below.select(*own.columns))
    return both.select("schema_name", "root_pk", "table_name", "pk", F.explode("data").alias("col", "value"))


def field_diff(changes: DataFrame, span: int = chunked.DEFAULT_SPAN) -> DataFrame:
    """Columns whose value differs from the state before the change.

    The earlier value counts only if it is not older than the insert or delete that last
    started the row. Output: change columns, col, old (null when there was none), value.
    """
    order = ["commit_lsn", "seq"]
    marked = chunked.fill_forward(changes, ROW, order, F.when(
        F.col("op").isin("insert", "delete"), F.struct("commit_lsn", "seq")), "started", span, inclusive=False)
    rows = marked.filter("op <> 'delete'").select(
        "tx_id", "op", *ROW, *order, "started", F.explode("data").alias("col", "value"))
    rows = chunked.previous(rows, [*ROW, "col"], order, [*order, "value"], "before", span)
    known = F.col("before").isNotNull() & (F.col("started").isNull()
                                          | (F.struct("before.commit_lsn", "before.seq") >= F.col("started")))
    return (rows.withColumn("known", known)
            .filter(~F.col("known") | ~F.col("value").eqNullSafe(F.col("before.value")))
            .select("tx_id", "op", *ROW, *order, "col", F.when(F.col("known"), F.col("before.value")).alias("old"), "value"))
