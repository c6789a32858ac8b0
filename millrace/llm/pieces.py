"""SentencePiece encoding and decoding over a table of distinct marked words."""

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import batch, runs, texts

MARK = "▁"
PART = 500  # rows that are packed together
AT = "chunk numbers of a packed row"
BUCKETS, ROWS = -1, -2  # kinds of a block's rows, beside the numbers of buckets


@dataclass(frozen=True)
class Settings:
    """Bounds of a block: distinct chunks, characters, rows. They bound a task's memory and change no result;
    one text longer than that is a block of its own. Larger blocks repeat fewer words. table: chunks of one
    bucket that are held at once; with enough shuffle partitions no bucket has more, and each is segmented once."""
    chunks: int = 1_000_000
    characters: int = 64_000_000
    rows: int = 200_000
    table: int = 1_000_000


class Pieces:
    """The model, and how texts are cut into chunks: white-space marks with the word that follows
    them, and line feeds.

    This is exact for a BPE model whose pieces hold marks only in front and hold no line feed, so
    that no merge can cross a cut; both are checked against the vocabulary.
    """

    def __init__(self, model_path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size) if not self.model.is_byte(i)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces cross white-space marks; chunks can't be segmented apart")
        if self.model.normalize("A  ﬁ\t ") != MARK + "A" + 2 * MARK + "ﬁ\t" + MARK:
            raise ValueError("the model normalizes texts; chunks can't be segmented apart")
        if any("\n" in p for p in pieces):
            raise ValueError("a piece holds a line feed; chunks can't be cut there")
        self.cut = re.compile(r" *[^ \n]+| +|\n").findall
        # The model marks the start of what it encodes; behind a line feed it sees a chunk as it stands.
        self.lead = "\n"
        self.lead_ids = self.model.encode(self.lead)
        self.end = self.model.eos_id()
        self.lists = pa.list_(pa.uint16() if size <= 1 << 16 else pa.int32())

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, the model's mark in front included; none for an empty text."""
        return self.cut(" " + text.replace(MARK, " ")) if text else []

    def segment(self, chunks: list[str]) -> list[list[int]]:
        return [i[len(self.lead_ids):] for i in self.model.encode([self.lead + c for c in chunks], num_threads=1)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of chunks; the first chunk of a whole text begins with a space that isn't part of it."""
        return [d[len(self.lead):] for d in self.model.decode([self.lead_ids + i for i in ids], num_threads=1)]


def _packed(**columns) -> bytes:
    """Columns as one compressed value."""
    whole = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(whole)
    return sink.getvalue().to_pybytes()


def _unpacked(value: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(value.as_buffer()).read_next_batch()


def _buckets(chunks: list[str], n: int) -> np.ndarray:
    """Share of the chunk table that each chunk belongs to."""
    return np.fromiter((zlib.crc32(c.encode()) % n for c in chunks), np.int32, len(chunks))


def _blocks(batches: Iterable[pa.RecordBatch], pieces: Pieces, text: str, kept: list[str] | None, s: Settings) -> Iterator[tuple]:
    """(block, its distinct chunks by number, packed rows with the ``kept`` columns) for each block of a task.

    Without ``kept`` nothing is packed. A block ends by its own rows only, wherever batches end, and
    its name is a hash of its first column and chunks, so reading the rows twice gives it twice.
    """
    def opened():
        held = defaultdict()
        held.default_factory = held.__len__  # a new chunk gets the next number
        return held, [], hashlib.blake2b(digest_size=8), 0, 0

    numbers, parts, name, n, size = opened()

    def close():
        name.update("\0".join(numbers).encode())
        return int.from_bytes(name.digest(), "little", signed=True), list(numbers), parts

    for b in batches:
        for lo in range(0, b.num_rows, PART):
            part, at, first = b.slice(lo, PART), [], 0
            column, keys = part.column(part.schema.names.index(text)).to_pylist(), part.column(0).to_pylist()
            for i, t in enumerate(column):
                chunks = pieces.chunks(t or "")
                if kept is None:
                    numbers |= dict.fromkeys(chunks)  # their order alone counts
                else:
                    at.append(list(map(numbers.__getitem__, chunks)))
                name.update(f"{keys[i]} {len(chunks)} ".encode())
                n, size = n + 1, size + len(t or "")
                full = len(numbers) >= s.chunks or size >= s.characters or n >= s.rows
                if full or i == len(column) - 1:
                    if kept is not None:
                        rows = part.slice(first, i + 1 - first).select(kept)
                        parts.append(_packed(**dict(zip(kept, rows.columns)), **{AT: pa.array(at, pa.list_(pa.int32()))}))
                    at, first = [], i + 1
                if full:
                    yield close()
                    numbers, parts, name, n, size = opened()
    if n:
        yield close()


class Block:
    """Rows of a block beside what the model made of its chunks."""

    def __init__(self, group: pa.Table, pieces: Pieces):
        kinds, values = group.column("kind").to_numpy(), group.column("value").combine_chunks()
        found, first = np.unique(kinds, return_index=True)  # sorted; equal blocks of repeated rows have equal chunks
        named = dict(zip(found.tolist(), first.tolist()))
        bucket = _unpacked(values[named[BUCKETS]]).column(0).to_numpy() if BUCKETS in named else None
        held = [_unpacked(values[named[k]]).column(0) for k in found[found >= 0].tolist()]
        if bucket is None or sum(map(len, held)) != len(bucket):
            raise RuntimeError("the documents came in another order when read again: stage them first")
        place = np.empty(len(bucket), np.int64)  # the table's rows come by bucket, in each by number
        place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
        lists = pa.concat_arrays(held).take(pa.array(place)) if held else pa.array([], pa.list_(pa.uint16()))
        self.pieces = pieces
        self.ids = lists.values.to_numpy().astype(np.int32)
        self.start = lists.offsets.to_numpy().astype(np.int64)
        self.packed = [values[i] for i in np.flatnonzero(kinds == ROWS).tolist()]

    def per_chunk(self, make: Callable) -> list:
        """``make`` gets ids of chunks, some thousands at once."""
        out, flat, start = [], self.ids.tolist(), self.start.tolist()
        for lo in range(0, len(start) - 1, 10_000):
            edges = start[lo:lo + 10_001]
            out += make([flat[a:b] for a, b in zip(edges, edges[1:])])
        return out

    def parts(self) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Kept columns, numbers of all chunks, and where each row's begin and the last's end."""
        for p in self.packed:
            rows = _unpacked(p)
            at = rows.column(AT)
            yield rows.select(rows.schema.names[:-1]), at.values.to_numpy(), at.offsets.to_numpy()

    def joined(self, at: np.ndarray, rows: np.ndarray) -> pa.ListArray:
        """The ids of rows, their chunks' ids in order of position and the end id."""
        n = self.start[at + 1] - self.start[at]
        place = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.start[at] - place[:-1], n) + np.arange(place[-1])]
        edges = place[rows]
        return pa.ListArray.from_arrays(pa.array(edges + np.arange(len(edges)), pa.int32()),
                                        pa.array(np.insert(ids, edges[1:], self.pieces.end), pa.int32()))


def over_blocks(docs: DataFrame, model_path: str, text: str, kept: list[str], make: Callable, schema, s: Settings) -> DataFrame:
    """Rows that ``make`` yields from every ``Block`` of ``docs``.

    The chunk table lies in buckets by a hash of the chunk, as many as there are shuffle partitions.
    Each block asks each bucket for its distinct chunks, in one packed row; the bucket segments every
    distinct chunk once and answers the block, where the ids meet the block's rows, which travel as
    chunk numbers instead of texts. A chunk that all texts share is asked for once per block.
    ``docs`` is read twice and must give the same rows in the same order, as files do; a block whose
    readings differ fails the job.
    """
    docs = docs if docs.columns[0] != text else docs.select(*[c for c in docs.columns if c != text], text)
    n_buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("value", pa.binary())])
    given = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("value", pa.binary())])

    def questions(batches):
        for block, chunks, _ in _blocks(batches, Pieces(model_path), text, None, s):
            bucket = _buckets(chunks, n_buckets)
            found, first = np.unique(np.sort(bucket), return_index=True)
            by_bucket = pa.array(chunks, pa.string()).take(pa.array(np.argsort(bucket, kind="stable")))
            for k, lo, hi in zip(found.tolist(), first.tolist(), [*first.tolist()[1:], len(chunks)]):
                yield batch(asked, [k], [block], [_packed(chunk=by_bucket.slice(lo, hi - lo))])

    def packed_rows(batches):
        for block, chunks, parts in _blocks(batches, Pieces(model_path), text, kept, s):
            yield batch(given, [block], [BUCKETS], [_packed(bucket=pa.array(_buckets(chunks, n_buckets)))])
            for p in parts:
                yield batch(given, [block], [ROWS], [p])

    def answers(batches):
        pieces, table, last = Pieces(model_path), {}, None
        for b in batches:
            for bucket, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                chunks = _unpacked(value).column(0).to_pylist()
                new = [c for c in chunks if c not in table] if bucket == last else chunks
                if bucket != last or len(table) + len(new) > s.table:
                    table, new, last = {}, chunks, bucket
                table.update(zip(new, pieces.segment(new)))
                yield batch(given, [block], [bucket], [_packed(ids=pa.array([table[c] for c in chunks], pieces.lists))])

    def assembled(batches):
        pieces = Pieces(model_path)
        for _, group in runs(batches, 1):
            yield from make(Block(group, pieces))

    values = "block long, kind int, value binary"
    table = (docs.mapInArrow(questions, "bucket int, block long, value binary")
             .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answers, values))
    return (docs.mapInArrow(packed_rows, values).unionByName(table)
            .repartition("block").sortWithinPartitions("block").mapInArrow(assembled, schema))


def encode(docs: DataFrame, model_path: str, settings: Settings = Settings()) -> DataFrame:
    """doc_id, ids (with the end id) and decoded, the text that the ids decode to.

    The ids of a text are its chunks' ids in order of position; a null or empty text has only the
    end id and decodes to an empty text. Rows are independent: repeated rows give repeated rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def make(block):
        decoded = block.per_chunk(block.pieces.decode)
        for rows, at, edges in block.parts():
            made = ["".join([decoded[i] for i in at[a:b].tolist()])[1:] for a, b in zip(edges, edges[1:])]
            yield batch(schema, rows.column(0), block.joined(at, edges), made)

    return over_blocks(texts(docs), model_path, "text", ["doc_id"], make, "doc_id long, ids array<int>, decoded string", settings)


def digests(docs: DataFrame, model_path: str, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``encode``, without shipping the ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def make(block):
        decoded = block.per_chunk(block.pieces.decode)
        written = block.per_chunk(lambda ids: [" ".join(map(str, i)) for i in ids])
        n, end = np.diff(block.start), str(block.pieces.end)
        for rows, at, edges in block.parts():
            total = np.concatenate([[0], np.cumsum(n[at])])[edges]
            own = [at[a:b].tolist() for a, b in zip(edges, edges[1:])]
            yield batch(schema, rows.column(0), np.diff(total) + 1, [sha(" ".join([written[i] for i in o] + [end])) for o in own],
                        [sha("".join([decoded[i] for i in o])[1:]) for o in own])

    return over_blocks(texts(docs), model_path, "text", ["doc_id"], make,
                       "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", settings)


def with_ids(docs: DataFrame, model_path: str, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` with ids and n_tokens of their texts appended; columns of these names are replaced.

    All columns travel with the chunk numbers, compressed.
    """
    names = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    out = T.StructType(docs.select(*names).schema.fields).add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType())

    def make(block):
        for rows, at, edges in block.parts():
            ids = block.joined(at, edges)
            columns = dict(zip(rows.schema.names, rows.columns)) | {"ids": ids, "n_tokens": pa.array(np.diff(ids.offsets.to_numpy()), pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in out.names], names=out.names)

    return over_blocks(docs.select(*names), model_path, "text", names, make, out, settings)
