"""Importance resampling towards a target distribution over hashed word runs."""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .common import batch, texts
from .ranking import numbered


@dataclass(frozen=True)
class Settings:
    """words: longest run of a feature. buckets: size of the hashed distributions. percent of the documents with
    at least ``least`` words are drawn; ``seed`` begins the hashed text of a document's random number. characters:
    of the texts that are worked on at once, which bounds a task's memory; a longer text is worked on alone."""
    words: int = 1
    buckets: int = 10_000
    percent: int = 10
    least: int = 20
    seed: str = "2024"
    characters: int = 4_000_000


def crc_table() -> np.ndarray:
    """What each byte adds to a CRC-32, from the reversed polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


TABLE = crc_table()
# Bytes outside words: all of ASCII but digits and lower-case letters (A-Z is lower-cased before).
OUTSIDE = np.array([b < 128 and not chr(b).isalnum() or 65 <= b <= 90 for b in range(256)])


def crcs(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a uint8 matrix, all rows updated column by column."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = TABLE[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return ~crc


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a uint8 matrix without zero bytes, and which of them each row is."""
    n, length = rows.shape
    if length <= 8:
        held = np.zeros((n, 8), np.uint8)
        held[:, :length] = rows
        found, which = np.unique(held.view("<u8").ravel(), return_inverse=True)
        return found.view(np.uint8).reshape(-1, 8)[:, :length], which
    found, which = np.unique(np.ascontiguousarray(rows).view(f"S{length}").ravel(), return_inverse=True)
    return found.view(np.uint8).reshape(-1, length), which


def feature_crcs(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes from each start to its end.

    Features of equal length form one matrix, whose different rows are hashed together; the results are
    scattered back. Where a matrix has more columns than rows, zlib hashes row by row, to the same values.
    """
    out, length = np.empty(len(start), np.uint32), end - start
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.diff(length[order], prepend=-1))
    for lo, hi in zip(edges.tolist(), [*edges.tolist()[1:], len(order)]):
        at = order[lo:hi]
        size = int(length[at[0]])
        if size > len(at):
            out[at] = [zlib.crc32(raw[s:s + size]) for s in start[at].tolist()]
        else:
            rows, which = distinct(np.lib.stride_tricks.sliding_window_view(raw, size)[start[at]])
            out[at] = crcs(rows)[which]
    return out


def features(batch_texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, words of each text, number of the text of every feature)."""
    parts = [t.encode().lower() + b"\n" for t in batch_texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    inside = ~OUTSIDE[raw]
    kept = inside | np.concatenate([[False], inside[:-1]])  # a word's bytes and one separator behind it
    text_end = np.concatenate([[0], np.cumsum(kept)])[np.cumsum([len(p) for p in parts])]
    raw = np.where(inside, raw, np.uint8(32))[kept]
    edge = np.diff((raw != 32).astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(text_end, start, "right")
    found, owner = [], []
    for k in range(1, s.words + 1):
        first = np.flatnonzero(text[:len(text) - k + 1] == text[k - 1:]) if len(text) >= k else np.empty(0, np.int64)
        found.append(feature_crcs(raw, start[first], end[first + k - 1]) % np.uint32(s.buckets))
        owner.append(text[first])
    return np.concatenate(found), np.bincount(text, minlength=len(batch_texts)), np.concatenate(owner)


def blocks(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of consecutive rows with up to ``characters``, or one row with more."""
    ids, held, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if held and size + len(t) > s.characters:
                yield ids, held
                ids, held, size = [], [], 0
            ids.append(i)
            held.append(t)
            size += len(t)
    if held:
        yield ids, held


def bucket_counts(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """bucket and n, its features in all ``rows`` (doc_id, text); a task sends one row per bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def work(batches):
        total = np.zeros(s.buckets, np.int64)
        for _, held in blocks(batches, s):
            total += np.bincount(features(held, s)[0], minlength=s.buckets)
        found = np.flatnonzero(total)
        yield batch(schema, found.astype(np.int32), total[found])

    return rows.mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, s: Settings = Settings()) -> list[int]:
    """What a feature of each bucket adds to a document's weight: 1000 times the logarithm of the ratio of its
    smoothed shares in ``target`` and ``docs`` (bucket, n), rounded down. As long as ``buckets`` whatever the input."""
    both = (docs.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
            .select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    counted = {r.bucket: (r.s, r.t) for r in both.collect()}
    all_s, all_t = (float(sum(c[i] for c in counted.values())) for i in (0, 1))
    pairs = np.array([counted.get(b, (0, 0)) for b in range(s.buckets)], np.float64)
    ratio = (pairs[:, 1] + 1) * (all_s + s.buckets) / ((pairs[:, 0] + 1) * (all_t + s.buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64).tolist()


def weights(rows: DataFrame, gain: list[int], s: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of gains over a text's features."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def work(batches):
        each = np.array(gain, np.int64)
        for ids, held in blocks(batches, s):
            bucket, n_words, owner = features(held, s)
            weight = np.zeros(len(held), np.int64)
            np.add.at(weight, owner, each[bucket])
            yield batch(schema, ids, n_words, np.bincount(owner, minlength=len(held)), weight)

    return rows.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """1000 times a Gumbel number, rounded down, from the hash of the seed and the id: the highest sums of weight
    and noise are a draw without replacement in proportion to exp(weight / 1000)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text); rank is 1, 2, ... in order
    of falling score for the drawn documents, ties to the smaller doc_id, and null for the others.

    ``target`` (text) holds the texts whose distribution is aimed at. A null or empty text has no words, no
    features and weight 0, and isn't drawn. A null doc_id is hashed as an empty one and ranks before others of
    its score. Repeated rows are documents of their own: they count, and they share a score and differ in rank.
    Without documents the result is empty; without target texts all shares of the target are equal. All counts
    and weights cover whole texts; documents are read twice, and only the rows near the draw are sorted.
    """
    rows = texts(docs)
    goal = target.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gain = gains(bucket_counts(rows, s), bucket_counts(goal, s), s)
    scored = stage(weights(rows, gain, s).withColumn("score", F.col("weight") + noise(F.col("doc_id"), s.seed)), "scored")
    could = F.col("n_words") >= s.least
    share = max(0.0, 1 - s.percent / 100 - 0.001)
    seen = scored.filter(could).agg(F.count("*").alias("n"), F.percentile_approx("score", share, 10_000).alias("low")).first()
    drawn = s.percent * seen.n // 100
    near = could & (F.col("score") >= F.lit(seen.low).cast("long"))
    close = scored.filter(near).count() if drawn else 0
    if close < drawn:  # the quantile is approximate
        near, close = could, seen.n
    columns = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("weight")]
    top = numbered(scored.filter(near).select(*columns), order, "place", 64 + close // 100_000)
    rest = scored.filter(~near).select(*columns, F.lit(None).cast("long").alias("rank"))
    return top.select(*columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank")).unionByName(rest)
