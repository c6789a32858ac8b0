"""Registered queries of the corpus operators, and SQL where it can express them."""

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import decontaminate, lm, neighbours, passages, pieces, pii, resample, simhash, spelling, tokenfiles, toxicity, urlfilter, warc
from ..session import configure, fresh_path

PII_KEY = b"fixed key of the registered queries"


def tokenizer(setting: str = "MILLRACE_PIECES", name: str = "piece_bpe_32k.model") -> str:
    """Path of the SentencePiece model, or of another public vocabulary; ``setting`` in the environment names another file."""
    if path := os.environ.get(setting):
        return path
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    # tasks import the package: sessions started elsewhere must find it too
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's masked text and what was found in it."""
    found = pii.pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return found.select("doc_id", "text", *[f"n_{name}" for name in pii.NAMES])


# Dated list and fetch times, derived from the pages alike in both languages: numbers from the
# first seven hex digits of an MD5, days from 2024-01-01.
FIRST = 1704067200


def md5_number(text) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def captures(pages: DataFrame) -> DataFrame:
    x = md5_number(F.col("page_id").cast("string"))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(FIRST) + x % (366 * 86400)).alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Every host of the pages and the domain above it come on a list and off it again; some change sides."""
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    upper = hosts.select(F.regexp_replace("host", r"^[^.]*\.", "").alias("host")).filter(F.instr("host", ".") > 0)
    x = F.col("x")
    day = lambda d: F.timestamp_seconds(F.lit(FIRST) + d * 86400)
    side = F.when(x % 3 < 2, "block").otherwise("allow")
    other = F.when(x % 3 < 2, "allow").otherwise("block")
    start = x % 250
    entry = lambda verdict, action, at, when: F.when(when, F.struct(verdict.alias("verdict"), F.lit(action).alias("action"), day(at).alias("at")))
    always = F.lit(True)
    entries = F.array(entry(side, "add", start, always), entry(side, "remove", start + 1 + x % 90, always),
                      entry(side, "add", start + 60, x % 2 == 0), entry(other, "add", start + 30, x % 4 == 0))
    return (hosts.union(upper).distinct().withColumn("x", md5_number("host"))
            .select(F.col("host").alias("key"), F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("key", "e.*"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = urlfilter.judged(captures(pages), list_entries(pages))
    return out.select("page_id", "host", F.unix_seconds("fetched_at").alias("fetched_s"), "decision", "matched_key",
                      F.unix_seconds("valid_from").alias("valid_from_s"))


OP3_SQL = rf"""
WITH cap AS (
  SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') AS host,
    {FIRST} + ('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 7))::BIGINT % (366 * 86400) AS fetched_s
  FROM pages),
hosts AS (SELECT DISTINCT host FROM cap WHERE host IS NOT NULL),
keys AS (
  SELECT host FROM hosts UNION
  SELECT up FROM (SELECT regexp_replace(host, '^[^.]*\.', '') AS up FROM hosts) WHERE contains(up, '.')),
x AS (SELECT host AS key, ('0x' || substr(md5(host), 1, 7))::BIGINT AS x FROM keys),
e AS (
  SELECT key, CASE WHEN x % 3 < 2 THEN 'block' ELSE 'allow' END AS verdict, 1 AS o, x % 250 AS d FROM x UNION ALL
  SELECT key, CASE WHEN x % 3 < 2 THEN 'block' ELSE 'allow' END, 0, x % 250 + 1 + x % 90 FROM x UNION ALL
  SELECT key, CASE WHEN x % 3 < 2 THEN 'block' ELSE 'allow' END, 1, x % 250 + 60 FROM x WHERE x % 2 = 0 UNION ALL
  SELECT key, CASE WHEN x % 3 < 2 THEN 'allow' ELSE 'block' END, 1, x % 250 + 30 FROM x WHERE x % 4 = 0),
state AS (SELECT key, verdict, d, max(o) AS o FROM e GROUP BY ALL),
was AS (SELECT *, coalesce(lag(o) OVER (PARTITION BY key, verdict ORDER BY d), 0) AS w FROM state),
spans AS (
  SELECT key, verdict, o, {FIRST} + d * 86400 AS f, lead({FIRST} + d * 86400) OVER (PARTITION BY key, verdict ORDER BY d) AS t
  FROM was WHERE o <> w),
parts AS (
  SELECT page_id, host, fetched_s, array_to_string(list_slice(l, i, len(l)), '.') AS key
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, string_split(host, '.') AS l FROM cap WHERE host IS NOT NULL))),
best AS (
  SELECT page_id, p.key, s.verdict, s.f, row_number() OVER (PARTITION BY page_id ORDER BY length(p.key) DESC, s.verdict, s.f DESC) AS r
  FROM parts p JOIN spans s ON p.key = s.key AND s.o = 1 AND s.f <= fetched_s AND (s.t IS NULL OR fetched_s < s.t))
SELECT c.page_id, c.host, c.fetched_s, coalesce(b.verdict, 'allow') AS decision, b.key AS matched_key, b.f AS valid_from_s
FROM cap c LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON c.page_id = b.page_id
"""


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer())


def op5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.train(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Base 32 of the digest's 160 bits, in two halves of 80 that fit a 128-bit integer.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, {20 * h + 5 * q + 1}, 5))::BIGINT >> {5 * (3 - i)}) & 31)::INT + 1, 1)"
                      for h in (0, 1) for q in range(4) for i in range(4))
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT s, max(page_id) AS top FROM p GROUP BY s)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN f USING (s)
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the benchmark's texts."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-ids")
    tokenfiles.write(table(spark, sf_dir, "documents"), folder, tokenizer("MILLRACE_WORDS", "word_bpe_49k.json"))
    return tokenfiles.digests(spark, folder)


REGISTRY = {f.__name__: f for f in (op1_passages, op2_pseudonyms, op3_url_filter, op4_pieces, op5_leaks, op6_toxicity, op7_warc,
                                    op8_simhash, op9_neighbours, op10_cross_entropy, op11_resample, op12_spelling, op13_token_orc)}
SQL = {"op3_url_filter": OP3_SQL, "op7_warc": OP7_SQL}
