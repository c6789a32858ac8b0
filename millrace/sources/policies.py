"""Policy documents: one JSON text per user."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.jsontext import is_json, json_member
from ..session import stage

TASKS_PER_CORE = 3


def parse_policies(docs: DataFrame, text: str = "doc") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, grants, rejects) of JSON texts; other columns are kept.

    Rejected: text that is not one JSON document of the expected shape, or without a user.
    ``initial_data`` stays raw JSON text, a ``roots`` member is ignored.
    """
    # fixed values: members of a document
    schema = "user_id string, tables map<string,array<string>>, ttl_seconds int, _bad string"
    # a text costs far more than its bytes tell, so texts are dealt over all cores, and judged once for what reads them
    many = docs.repartition(TASKS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism)
    parsed = many.withColumn("_d", F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    whole = is_json(F.col(text))
    raw = json_member(F.col(text), "initial_data")
    reason = (F.when(~whole | F.col("_d").isNull() | F.col("_d._bad").isNotNull(), "bad_json")
              .when(F.coalesce(F.col("_d.user_id"), F.lit("")) == "", "no_user"))
    row = F.struct(F.coalesce(reason, F.lit("")).alias("reason"), F.when(reason.isNull(), raw).alias("initial_data"), F.col("_d.user_id").alias("user_id"),
                   F.col("_d.tables").alias("tables"), F.coalesce("_d.ttl_seconds", F.lit(0)).alias("ttl_seconds"))
    rows = stage(parsed.withColumn("_r", F.explode(F.array(row))).drop("_d"), "policies")
    good = rows.filter("_r.reason = ''").select(*[c for c in docs.columns if c not in (text, "user_id")],
                                                "_r.user_id", "_r.ttl_seconds", "_r.initial_data", "_r.tables")
    grants = good.select("*", F.explode("tables").alias("table_name", "columns")).drop("tables", "initial_data")
    grants = grants.withColumn("columns", F.array_sort(F.array_distinct(F.coalesce("columns", F.array().cast("array<string>")))))
    return good.drop("tables"), grants, rows.filter("_r.reason <> ''").select(*docs.columns, "_r.reason")


def policy_id(grants: DataFrame, by: list[str]) -> DataFrame:
    """Policy identity: a hash of the sorted grants, so equal whitelists share a class."""
    entry = F.concat_ws("=", "table_name", F.concat_ws(",", "columns"))
    # a whitelist lists tables of one schema; its size does not grow with the feed
    return grants.groupBy(*by).agg(F.xxhash64(F.concat_ws(";", F.array_sort(F.collect_set(entry)))).alias("policy_id"))


def read_policies(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whole-text documents, one per line."""
    return parse_policies(spark.read.text(path).withColumnRenamed("value", "doc"))
