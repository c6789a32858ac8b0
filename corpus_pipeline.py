"""A training-data pipeline over ``documents``: each stage reads what the one before wrote.

Toxicity, SimHash near-dedup, benchmark decontamination, pseudonyms, SentencePiece encoding.
"""

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, pieces, pii, simhash, toxicity
from millrace.llm.queries import PII_KEY, table, tokenizer
from millrace.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, doesn't reject."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links (three-word shingles, two bits at most), that with the smallest doc_id."""
    return simhash.keep_one(docs).select(*COLUMNS)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in their text."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal values; formats keep n_chars right."""
    return pii.pseudonyms(docs, PII_KEY).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the ids of their texts (end id included) and their number."""
    return pieces.with_ids(docs.select(*COLUMNS), tokenizer())


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_duplicates), ("benchmark decontamination", drop_leaked),
          ("pii", mask_personal_data), ("sentencepiece", encode_pieces)]

# Classifiers, components of near copies and SentencePiece have no SQL form; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
