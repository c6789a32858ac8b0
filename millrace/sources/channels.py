"""Channel lists: text lines ``table/pk`` or ``table/all``."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import channel_text, valid_name


def parse_channels(lines: DataFrame, text: str = "value") -> DataFrame:
    """Trimmed lines as channels; blank lines and ``#`` comments are skipped."""
    line = F.regexp_replace(text, r"^\s+|\s+$", "")
    rows = lines.withColumn("line", line).filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    table = F.substring_index("line", "/", 1)
    # without a slash there is no key part
    pk = F.when(F.instr("line", "/") > 0, F.expr("substring(line, instr(line, '/') + 1)")).otherwise("")
    rows = rows.withColumn("table_name", table).withColumn("_pk", pk)
    kind = F.when(F.col("_pk") == "all", "wildcard").otherwise("exact")
    rows = rows.withColumn("kind", kind).withColumn("pk", F.when(kind == "exact", F.col("_pk")))
    return rows.withColumn("channel", channel_text(F.col("kind"), F.col("table_name"), F.col("pk"))).drop("_pk")


def valid_channels(channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable channels, rejects): table name rule, key of 1 to 256 bytes."""
    size = F.octet_length(F.coalesce("pk", F.lit("")))
    ok = valid_name(F.col("table_name")) & ((F.col("kind") == "wildcard")
                                            | ((size >= 1) & (size <= 256) & (F.col("pk") != "all")))
    flagged = channels.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return flagged.filter("_ok").drop("_ok"), flagged.filter("not _ok").drop("_ok")


def assign_channels(subscribers: DataFrame, channels: DataFrame, number: str = "number") -> DataFrame:
    """Round-robin: subscriber ``i`` takes channel ``i mod n``.

    ``channels`` carries a dense ``slot`` from 0; only its size goes to the driver.
    """
    n = channels.count()
    if n == 0:
        return subscribers.withColumn("channel", F.lit(None).cast("string")).limit(0)
    return (subscribers.withColumn("slot", F.pmod(F.col(number), F.lit(n)))
            .join(channels.select("slot", "channel"), "slot"))


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    return parse_channels(spark.read.text(path))
