"""Language-model scores: cross-entropy difference of a target and a background bigram model."""

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .common import batch, runs, texts
from .pieces import _packed, _unpacked
from .words import SPACE, hashed, mixed

START = 0  # stands for the context of a text's first word; no word hashes to it
WORDS, BIGRAMS, IDS, ROWS = 0, 1, 2, 3  # kinds of a block's rows
ASK, GIVEN = "bucket int, kind int, block long, target boolean, value binary", "block long, kind int, bucket int, value binary"


@dataclass(frozen=True)
class Settings:
    """prior: weight, in words, of the word distribution in each context. block: words that are worked on at once
    (a longer text is worked on alone); bucket: characters of all texts behind one part of the count tables. Both
    bound a task's memory and change no result."""
    prior: float = 50.0
    block: int = 3_000_000
    bucket: int = 16_000_000


class Block:
    """Words and bigrams of some texts: ``known``, the sorted hashes of its words and START; each word's number in
    it, each word's context, and the sorted keys of the different bigrams with each word's number among them."""

    def __init__(self, known: np.ndarray, word: np.ndarray, starts: np.ndarray):
        self.known, self.word, self.starts = known, word, starts
        self.context = np.zeros_like(word)
        self.context[1:] = word[:-1]
        self.context[starts[:-1][np.diff(starts) > 0]] = 0
        pairs, self.pair = np.unique(self.context << 32 | word, return_inverse=True)
        keys = mixed(mixed(known[pairs >> 32] ^ np.uint64(0x5851F42D4C957F2D)) + known[pairs & 0xFFFFFFFF])
        self.keys, place = np.unique(keys, return_inverse=True)
        self.pair = place[self.pair]

    @classmethod
    def of(cls, words: list[np.ndarray], lengths: list[np.ndarray]) -> "Block":
        """From the hashes of the words of runs of texts, and the texts' lengths in words."""
        known, number = np.unique(np.concatenate([np.array([START], np.uint64), *words]), return_inverse=True)
        return cls(known, number[1:], np.concatenate([[0], *lengths]).cumsum())

    def counts(self) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """(kind, sorted keys, columns): of words how often each stands and how often another follows it, of bigrams how often."""
        size = len(self.known)
        yield WORDS, self.known, [np.bincount(self.word, minlength=size), np.bincount(self.context, minlength=size)]
        yield BIGRAMS, self.keys, [np.bincount(self.pair, minlength=len(self.keys))]


def _pack(**columns: np.ndarray) -> bytes:
    """Columns as one compressed value; the bytes of numbers lie by place, first all lowest ones, as those that
    stand for large differences then compress apart."""
    planes = lambda a: np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()
    return _packed(**{f"{name}:{a.dtype.str}": pa.array([planes(a)], pa.large_binary()) for name, a in columns.items()})


def _unpack(value: pa.BinaryScalar) -> list[np.ndarray]:
    row, out = _unpacked(value), []
    for name, column in zip(row.schema.names, row.columns):
        kind = np.dtype(name.partition(":")[2])
        planes = np.frombuffer(column[0].as_buffer(), np.uint8).reshape(kind.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
    return out


def _blocks(batches: Iterable[pa.RecordBatch], s: Settings) -> Iterator[tuple[int, list, Block]]:
    """(name, doc_ids, block) of consecutive rows; a block ends by its own rows only, wherever batches end, and its name
    is a hash of its place and rows, so that reading the rows twice gives it twice."""
    ids, held, words, lengths, size, number = [], [], [], [], 0, 0

    def hash_held():
        found, starts = hashed(held, SPACE)
        words.append(found)
        lengths.append(np.diff(starts))
        held.clear()

    def close():
        hash_held()
        name = hashlib.blake2b(f"{TaskContext.get().partitionId()} {number} {ids}".encode(), digest_size=8)
        for w in words:
            name.update(w.tobytes())
        return int.from_bytes(name.digest(), "little", signed=True), ids, Block.of(words, lengths)

    pending = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n = len(t) // 6 + 1  # of words, about
            if ids and size + n > s.block:
                yield close()
                ids, words, lengths, size, pending, number = [], [], [], 0, 0, number + 1
            ids.append(i)
            held.append(t)
            size, pending = size + n, pending + n
            if pending > 200_000:  # hashing takes several times the memory of the texts
                hash_held()
                pending = 0
    if ids:
        yield close()


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Part of the count tables that holds each key; grows with the key, so sorted keys are sorted by part."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _questions(rows: DataFrame, n_buckets: int, target: bool, s: Settings) -> DataFrame:
    """Counts of each block, a packed row for each kind and bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("target", pa.bool_()), ("value", pa.binary())])

    def work(batches):
        for name, _, block in _blocks(batches, s):
            for kind, keys, columns in block.counts():
                bucket = _buckets(keys, n_buckets)
                found, first = np.unique(bucket, return_index=True)
                for k, lo, hi in zip(found.tolist(), first.tolist(), [*first.tolist()[1:], len(keys)]):
                    steps = np.diff(keys[lo:hi], prepend=np.uint64(0))
                    packed = _pack(key=steps, **{f"n{i}": c[lo:hi].astype(np.int32) for i, c in enumerate(columns)})
                    yield batch(schema, [k], [kind], [name], [target], [packed])

    return rows.mapInArrow(work, ASK)


def _answers(batches):
    """For each block's row of a bucket the sums over all blocks, and over those of the target, of its counts."""
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("value", pa.binary())])
    for (bucket, kind), group in runs(batches, 2):
        held = [_unpack(v) for chunk in group.column("value").chunks for v in chunk]
        target = group.column("target").to_pylist()
        edges = np.cumsum([0, *[len(h[0]) for h in held]])
        keys = np.concatenate([np.cumsum(h[0], dtype=np.uint64) for h in held])
        of_target = np.repeat(target, np.diff(edges))
        keys, place = np.unique(keys, return_inverse=True)
        sums = []
        for i in range(1, len(held[0])):
            n = np.concatenate([h[i] for h in held])
            sums += [np.bincount(place[side], n[side], len(keys)).astype(np.int64) for side in (~of_target, of_target)]
        for block, t, lo, hi in zip(group.column("block").to_pylist(), target, edges.tolist(), edges.tolist()[1:]):
            if not t:
                value = _pack(**{f"s{i}": c[place[lo:hi]] for i, c in enumerate(sums)})
                yield batch(schema, [block], [kind], [bucket], [value])


def _packed_rows(rows: DataFrame, s: Settings) -> DataFrame:
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("value", pa.binary())])

    def work(batches):
        for name, ids, block in _blocks(batches, s):
            row = _packed(doc_id=pa.array(ids, pa.int64()))
            whole = _pack(steps=np.diff(block.known, prepend=np.uint64(0)), word=block.word.astype(np.int32), starts=block.starts)
            yield batch(schema, [name] * 2, [IDS, ROWS], [0, 0], [row, whole])

    return rows.mapInArrow(work, GIVEN)


def word_counts(rows: DataFrame, s: Settings) -> DataFrame:
    """word (hash), n over all texts."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def work(batches):
        held, size = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                words, _ = hashed(b.column(0).slice(lo, 500).to_pylist(), SPACE)
                held.append(words)
                size += len(words)
                if size >= s.block:
                    words, n = np.unique(np.concatenate(held), return_counts=True)
                    yield batch(schema, words.view(np.int64), n)
                    held, size = [], 0
        if size:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            yield batch(schema, words.view(np.int64), n)

    return rows.select("text").mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def differences(block: Block, of_words: list[np.ndarray], of_bigrams: list[np.ndarray], size: int, total: tuple[int, int],
                prior: float) -> np.ndarray:
    """Loss under the target minus loss under the background of each word of a block in its context, in nats.

    Both models have the same vocabulary and are smoothed alike: a context's counts plus ``prior`` words spread by the
    model's word distribution, itself smoothed by one word spread evenly. The background's counts are scaled
    to the target's total, so that the prior weighs the same in both.
    """
    log_p = []
    for side in (0, 1):  # background, target
        scale = total[1] / total[side] if total[side] else 1.0
        words, mass, pairs = of_words[side] * scale, of_words[2 + side] * scale, of_bigrams[side] * scale
        spread = (words + 1 / size) / (total[side] * scale + 1)
        log_p.append(np.log(pairs[block.pair] + (prior * spread)[block.word]) - np.log(mass + prior)[block.context])
    return log_p[0] - log_p[1]


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_words and score of every row of ``docs`` (doc_id, text): the mean over all its words of the loss
    difference (nats; lower is nearer to the target) of a model of the documents in ``target_ids`` (doc_id) and
    one of all documents; 0 for a text without words.

    Words are lower-cased runs between ASCII white space, told apart by 64-bit hashes. Every word and every bigram is
    counted, whatever its frequency. The count tables lie in buckets by key, as many as the texts' size asks for;
    each block of texts sends its own counts there in packed rows and gets the sums back, so a key that all texts
    share is one entry per block. Null texts are empty. Repeated rows count, and each gets a score. Without target
    documents every score is near zero, as the smoothed target model knows nothing. ``docs`` is read twice and must give
    the same rows in the same order, as files do; a block whose readings differ fails the job.
    """
    rows = texts(docs)
    n_buckets = 64 + (rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0) // s.bucket
    seen = word_counts(rows, s).agg(F.count("*").alias("size"), F.sum("n").alias("n")).first()
    # the target's ids grow with the corpus: one plan for every size, without a broadcast
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    of_target = stage(_questions(rows.join(ids.hint("merge"), "doc_id", "left_semi"), n_buckets, True, s), "target-counts")

    def words_in(batches):
        for b in batches:
            n = [int(_unpack(v)[1].sum()) for v in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])

    in_target = of_target.filter(F.col("kind") == WORDS).select("value").mapInArrow(words_in, "n long").agg(F.sum("n").alias("n")).first().n
    size, total, prior = seen.size + 2, (seen.n or 0, in_target or 0), s.prior  # text starts and unseen words are entries too
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())])

    def scored(batches):
        for _, group in runs(batches, 1):
            kind, bucket = group.column("kind").to_numpy(), group.column("bucket").to_numpy()
            values = group.column("value").combine_chunks()
            sums = {}
            for k in (WORDS, BIGRAMS):
                at = np.flatnonzero(kind == k)
                parts = [_unpack(values[i]) for i in at[np.argsort(bucket[at])].tolist()]
                sums[k] = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * 2
            whole, row = (np.flatnonzero(kind == k) for k in (ROWS, IDS))
            if len(whole) != 1:
                raise RuntimeError("the documents came in another order when read again: stage them first")
            ids = _unpacked(values[row[0]]).column(0)
            steps, word, starts = _unpack(values[whole[0]])
            block = Block(np.cumsum(steps, dtype=np.uint64), word.astype(np.int64), starts)
            if len(sums[WORDS][0]) != len(block.known) or len(sums[BIGRAMS][0]) != len(block.keys):
                raise RuntimeError("the documents came in another order when read again: stage them first")
            n = np.diff(starts)
            loss = differences(block, sums[WORDS], sums[BIGRAMS], size, total, prior)
            mean = np.bincount(np.repeat(np.arange(len(n)), n), loss, len(n)) / np.maximum(n, 1)
            for lo in range(0, len(n), 10_000):
                yield batch(schema, ids.slice(lo, 10_000), n[lo:lo + 10_000], mean[lo:lo + 10_000])

    asked = _questions(rows, n_buckets, False, s).unionByName(of_target)
    given = asked.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answers, GIVEN)
    return (_packed_rows(rows, s).unionByName(given).repartition(n_buckets, "block").sortWithinPartitions("block")
            .mapInArrow(scored, "doc_id long, n_words long, score double"))
