"""Token ids in ORC files: run-length encoded ids, row indexes and Bloom filters on the document ids."""

import functools
import os
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage
from .common import batch, texts
from .ranking import starts

SCHEMA = "part int, doc_id long, at long, n_tokens int, ids array<int>"


@dataclass(frozen=True)
class Settings:
    """file: characters of text behind a file. stripe: bytes of a stripe, which is what a task reads. stride: rows
    between the entries of a row index. false_hits: share of the ids that a Bloom filter takes for held wrongly.
    table: different words whose ids a Python worker keeps; beyond that it begins anew."""
    file: int = 64_000_000
    stripe: int = 8 << 20
    stride: int = 1000
    false_hits: float = 0.01
    table: int = 1_000_000


class Encoder(dict):
    """Ids of words, as the bytes of little-endian integers, by a tokenizer that drops white space.

    Texts of printable ASCII, white space and the letters from U+00C0 to U+00FF, where lower case and normal form
    act on single characters, are split into words as the tokenizer does; its model reads each different word
    once, and the ids are put together by position. Of other texts the library itself reads those chunks between
    spaces and line feeds, which no piece crosses, that hold other characters. Both ways are compared on the way in.
    """

    def __init__(self, path: str, size: int):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.library, self.size, self.odd = Tokenizer.from_file(path), size, {}
        self.model = self.library.model
        letters = "".join(map(chr, range(0xC0, 0x100))).replace("\xd7", "").replace("\xf7", "")
        small = "a-z" + "".join(sorted(set(letters.lower())))
        space = r" \t\n\r\x0b\x0c"
        self.plain = re.compile(f"[{space}!-~{letters}]*").fullmatch
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{small}]+|[0-9]|[^{space}{small}0-9]+").findall
        self.cut = re.compile(r"[^ \n]+").findall
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = str.maketrans({c: spell(c)[0][0] for c in letters.lower()})
        sample = ["Ab", "cd's.Don'T", "ÉÀßÿ's", "'s,0_", "x<|y|>", "Z\t\x0b1", "中a", "a12-é'll"]
        if any(self.text(t) != self.whole(t) for t in [*sample, " \n".join(sample)]):
            raise ValueError("the tokenizer reads text across white space or splits words in another way")

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def __missing__(self, word: str) -> bytes:
        found = [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.spelling))]
        ids = self[word] = struct.pack(f"<{len(found)}i", *found)
        return ids

    def chunk(self, chunk: str) -> bytes:
        if "<|" not in chunk and self.plain(chunk):
            return b"".join(map(self.__getitem__, self.split(chunk.lower())))
        if chunk not in self.odd:
            self.odd[chunk] = self.whole(chunk)
        return self.odd[chunk]

    def text(self, text: str) -> bytes:
        if "<|" not in text and self.plain(text):
            return b"".join(map(self.__getitem__, self.split(text.lower())))
        return b"".join(map(self.chunk, self.cut(text)))

    def encode(self, rows: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id behind each, and where each text's begin and the last's end."""
        for held in (self, self.odd):
            if len(held) > self.size:
                held.clear()
        last = struct.pack("<i", end)
        made = [self.text(t) + last for t in rows]
        return np.frombuffer(b"".join(made), "<i4"), np.cumsum([0, *[len(m) // 4 for m in made]])


@functools.cache
def encoder(path: str, size: int) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path, size)


def write(docs: DataFrame, folder: str, tokenizer_path: str, end: int = 1, s: Settings = Settings()) -> None:
    """Writes the ids of every row of ``docs`` (doc_id, text), ``end`` appended, in ascending order of doc_id.

    Rows are dealt to ranges of doc_id, as many as the texts' size asks for, and sorted there; each range is a
    file: part (its number), doc_id, at (ids of the file before the row), n_tokens, ids. Spark's writer makes the
    files final only if their task succeeds, so lost executors leave nothing behind. A null text is empty and
    has the end id only. Rows without doc_id come first; rows that repeat one are kept, ordered by text.
    """
    rows = texts(docs)
    size = rows.agg(F.sum(F.length("text"))).scalar()
    n = 64 + (rows.sparkSession.createDataFrame([(0,)], "x int").select(size.alias("n")).first().n or 0) // s.file
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def work(batches):
        known, part, at = encoder(tokenizer_path, s.table), TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                some = b.slice(lo, 500)
                ids, edges = known.encode(some.column(1).to_pylist(), end)
                yield batch(schema, np.full(len(edges) - 1, part, np.int32), some.column(0), edges[:-1] + at, np.diff(edges).astype(np.int32),
                            pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32())))
                at += int(edges[-1])

    first = F.asc_nulls_first("doc_id")  # alone: the sampled keys of the ranges go to the driver
    (rows.repartitionByRange(n, first).sortWithinPartitions(first, F.asc("text")).mapInArrow(work, SCHEMA)
     .write.options(**{"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": s.stride, "orc.stripe.size": s.stripe,
                       "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": s.false_hits}).orc(folder))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the files; tasks share files by stripe, and filters on doc_id skip files, stripes and rows by
    their statistics, row indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(folder)


def documents(spark: SparkSession, folder: str, ids: list[int]) -> DataFrame:
    """The rows of the given documents."""
    return read(spark, folder).filter(F.col("doc_id").isin([int(i) for i in ids]))


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """part and start, the ids in all files before it; reads three columns of the files."""
    sizes = read(spark, folder).groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("n"))
    return starts(sizes, "part", "n")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers) of every row of the files."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches):
        for b in batches:
            ids = b.column(3)
            values, edges = ids.flatten().to_numpy().astype("<u4").data, np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
            crc = [zlib.crc32(values[lo:hi]) for lo, hi in zip(edges.tolist(), edges.tolist()[1:])]
            yield batch(schema, b.column(0), b.column(1), b.column(2), np.diff(edges), crc)

    found = read(spark, folder).select("part", "doc_id", "at", "ids").mapInArrow(
        work, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    first = stage(parts(spark, folder), "parts")
    return found.join(first, "part").select("doc_id", (F.col("at") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
