"""Recorded event logs and metric exposition text."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def parse_frames(frames: DataFrame, text: str = "value") -> DataFrame:
    """(event, data, id) of recorded frames, one frame text per row; other columns are kept.

    The first ``event:`` and ``data:`` line count and both are needed; comment lines start
    with a colon. One blank after the colon is not part of the value.
    """
    def first(name: str):
        lines = F.filter(F.split(text, "\n"), lambda line: F.startswith(line, F.lit(name)))
        return F.regexp_replace(F.get(lines, F.lit(0)), f"^{name} ?", "")

    fields = F.struct(first("event:").alias("event"), first("data:").alias("data"), first("id:").alias("id"))
    return (frames.withColumn("_f", F.explode(F.array(fields)))
            .filter("_f.event is not null and _f.data is not null").select("*", "_f.*").drop("_f", text))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames end at a blank line."""
    return parse_frames(spark.read.option("lineSep", "\n\n").text(path))


def parse_metrics_text(lines: DataFrame, by: list[str] | None = None, text: str = "value") -> DataFrame:
    """(metric, value) summed over all label sets; comments and non-finite samples are skipped.

    A line is a name, perhaps labels in braces, a number and perhaps a whole timestamp. The labels
    end at the last brace, so a quoted label value may hold one. Other lines are skipped.
    """
    line = F.trim(F.col(text))
    labelled = F.instr(line, "{") > 0
    name = F.when(labelled, F.substring_index(line, "{", 1)).otherwise(F.substring_index(line, " ", 1))
    rest = F.when(labelled, F.substring_index(line, "}", -1)).otherwise(F.substr(line, F.length(name) + 1))
    rows = lines.filter((line != "") & ~F.startswith(line, F.lit("#")) & (~labelled | (F.instr(line, "}") > 0)))
    rows = rows.select(*(by or []), F.trim(name).alias("metric"), F.split(F.trim(rest), " +").alias("_p"))
    number = lambda i, marks: F.when(F.translate(F.get("_p", F.lit(i)), "0123456789" + marks, "") == "", F.get("_p", F.lit(i)))
    rows = rows.filter((F.size("_p") == 1) | ((F.size("_p") == 2) & number(1, "").isNotNull()))
    # names: letters, digits, underscores and colons, no digit in front
    rows = rows.filter(F.col("metric").rlike("^[A-Za-z_:]") & ~F.col("metric").rlike("[^A-Za-z0-9_:]"))
    rows = rows.withColumn("_v", number(0, "+-.eE").try_cast("double")).filter(F.abs("_v") < float("inf"))
    return rows.groupBy(*(by or []), "metric").agg(F.sum("_v").alias("value"))


def read_metrics_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_metrics_text(spark.read.text(path))
