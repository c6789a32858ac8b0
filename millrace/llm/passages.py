"""Substring dedup: MinHash banding of paragraph pieces, exact Jaccard, removal by components."""

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage, unstage
from .common import Forest, batch, components, link_groups, texts
from .words import SPACE, mixed, powers, split

WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")


@dataclass(frozen=True)
class Settings:
    """shingle: words of a shingle. similarity: Jaccard of two pieces' shingles that links them. bands:
    MinHash bands of one row each; linked pieces share a band with probability
    1 - (1 - similarity) ** bands at least, 0.992 for the defaults, and identical pieces always.
    reach: words to each side among which a cut inside a paragraph has the smallest hash. edge: words
    of a paragraph before the first and behind the last cut. min_words: shortest passage reported.
    flush: pieces a task looks through for copies before it hands band keys on."""
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 3
    reach: int = 6
    edge: int = 4
    min_words: int = 15
    flush: int = 1_000_000


def cut(all_texts: list[str], settings: Settings):
    """Pieces of texts: (text number, piece number in it, first word, words, hash, shingles, ends of the shingles).

    A paragraph is a line. Inside a line cuts follow from the words around them alone: where the hash
    of three words is the smallest within ``reach`` words to each side. So a passage that stands in
    two texts, wherever in a line, is cut alike in both but for its ends.
    """
    parts = [t.lower().encode() + b"\n" for t in all_texts]
    data = b"".join(parts)
    h, start, _ = split(data, SPACE)
    n = len(h)
    first_words = np.searchsorted(start, np.cumsum([0] + [len(p) for p in parts]))
    line = np.searchsorted(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), start)
    text_of = np.repeat(np.arange(len(parts)), np.diff(first_words))
    new_line = np.ones(n, bool)
    new_line[1:] = line[1:] != line[:-1]
    line_start = np.flatnonzero(new_line)
    length = np.diff(np.append(line_start, n))
    within = np.arange(n) - np.repeat(line_start, length)
    left = np.repeat(length, length) - within

    ahead = lambda k: np.concatenate([h[k:], np.zeros(min(k, n), np.uint64)])
    g = (mixed(h + ahead(1) * np.uint64(3) + ahead(2) * np.uint64(5)) >> np.uint64(33)).astype(np.uint32)
    g[left < 3] = np.iinfo(np.uint32).max  # words of the next line have no say: equal lines are cut alike
    smallest = (within >= settings.edge) & (left >= settings.edge)
    for k in range(1, settings.reach + 1):
        if k < n:
            same = line[k:] == line[:-k]
            smallest[k:] &= ~same | (g[k:] < g[:-k])
            smallest[:-k] &= ~same | (g[:-k] < g[k:])
    begin = np.flatnonzero(new_line | smallest)
    words = np.diff(np.append(begin, n))
    up, _ = powers()
    offset = (np.arange(n) - np.repeat(begin, words)) % len(up)
    piece_hash = mixed(np.add.reduceat(h * up[offset], begin)) if n else np.zeros(0, np.uint64)

    size = settings.shingle
    shingles = np.zeros(n, np.uint64)
    for k in range(size):
        shingles += ahead(k) * up[k + 1]
    to_end = np.repeat(words, words) - (np.arange(n) - np.repeat(begin, words))
    whole = to_end >= size
    short = words < size
    shingles[begin[short]] = piece_hash[short]
    whole[begin[short]] = True
    kept = (mixed(shingles[whole]) >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum(np.where(short, 1, words - size + 1)) if n else np.zeros(0, np.int64)
    piece_text = text_of[begin] if n else np.zeros(0, np.int64)
    first_piece = np.searchsorted(begin, first_words[:-1])
    number = np.arange(len(begin)) - first_piece[piece_text] if n else piece_text
    return piece_text, number, begin - first_words[piece_text] if n else piece_text, words, piece_hash, kept, ends


def pieces(docs: DataFrame, settings: Settings) -> DataFrame:
    """One row a piece: doc_id, row (a number for the document's row), no, first_word, n_words, h, shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("no", pa.int32()), ("first_word", pa.int32()), ("n_words", pa.int32()),
                        ("h", pa.int64()), ("shingles", pa.binary())])

    def work(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                text, no, first, n, h, shingles, ends = cut(part.column(1).to_pylist(), settings)
                if not len(h):
                    continue
                packed = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)),
                                                                     pa.py_buffer(shingles)])
                rows = pa.array(text)
                yield batch(schema, part.column(0).take(rows), part.column(2).take(rows), no.astype(np.int32), first.astype(np.int32),
                            n.astype(np.int32), h.view(np.int64), packed)

    # the number tells rows with one doc_id apart; fixed once the repeated pieces are written
    numbered = texts(docs).withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(work, "doc_id long, row long, no int, first_word int, n_words int, h long, shingles binary")


def band_keys(docs: DataFrame, settings: Settings) -> DataFrame:
    """key (band and its smallest shingle), h, n of all pieces of ``docs``: copies in a task come as one row."""
    schema = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])
    odd = np.random.default_rng(1).integers(0, 1 << 63, settings.bands, dtype=np.uint64) | np.uint64(1)

    def emit(held):
        h = np.concatenate([x[0] for x in held])
        keys = np.concatenate([x[1] for x in held], axis=1)
        h, at, n = np.unique(h, return_index=True, return_counts=True)
        for k in range(settings.bands):
            yield batch(schema, keys[k][at] | k << 32, h, n)

    def work(batches):
        held, size = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                _, _, _, _, h, shingles, ends = cut(b.column(1).slice(lo, 500).to_pylist(), settings)
                if not len(h):
                    continue
                flat, begins = shingles.astype(np.uint64), np.concatenate([[0], ends[:-1]])
                keys = np.stack([np.minimum.reduceat(mixed(flat * m) >> np.uint64(32), begins) for m in odd]).astype(np.int64)
                held.append((h.view(np.int64), keys))
                size += len(h)
                if size >= settings.flush:
                    yield from emit(held)
                    held, size = [], 0
        if size:
            yield from emit(held)

    return texts(docs).mapInArrow(work, "key long, h long, n long")


def jaccard_forest(similarity: float):
    """Links every pair of sets with that Jaccard similarity: two such sets share one of the smallest
    |s| - ceil(similarity * |s|) + 1 members of each (prefix filter), so only those are looked up."""
    def link(payloads: list[bytes]) -> Forest:
        forest, sets, index = Forest(len(payloads)), [], {}
        for i, p in enumerate(payloads):
            s = set(np.frombuffer(p, np.uint32).tolist())
            sets.append(s)
            prefix = sorted(s)[:len(s) - math.ceil(similarity * len(s)) + 1]
            tried = set()
            for x in prefix:
                for j in index.setdefault(x, []):
                    if j in tried or forest.find(j) == forest.find(i):
                        continue
                    tried.add(j)
                    shared = len(s & sets[j])
                    if shared >= similarity * (len(s) + len(sets[j]) - shared):
                        forest.join(i, j)
                index[x].append(i)
        return forest
    return link


def repeated_passages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Passages that stand in more than one place: doc_id, first_word, n_words, first_doc, removed.

    Texts are cut into pieces (``cut``). Pieces with ``similarity`` or more, and chains of them, are one
    cluster; its first piece (smallest doc_id and place) stays and the others are removed. Neighbouring
    clustered pieces make up a passage; passages of ``min_words`` or more are returned, parted where kept and
    removed pieces meet. first_doc is the smallest doc_id of the first piece's cluster. Words are runs between
    ASCII white space, compared in small letters; first_word counts from 0. Null and empty texts have none.
    Rows that repeat a doc_id are texts of their own. A row without doc_id comes before all others.
    ``docs`` are read and cut twice, as all pieces would take as much disk as the texts: stage a frame first
    that is dear or isn't the same at each reading.
    """
    key = Window.partitionBy("key")
    hits = stage(band_keys(docs, settings).withColumns({"total": F.sum("n").over(key), "lo": F.min("h").over(key), "hi": F.max("h").over(key)})
                 .filter("total > 1").select("key", "h", (F.col("lo") != F.col("hi")).alias("differ")), "band-hits")
    repeated = stage(pieces(docs, settings).join(hits.select("h").distinct(), "h", "left_semi"), "repeated-pieces")
    near = hits.filter("differ").select("key", "h").distinct()
    payload = repeated.join(near.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.first("shingles").alias("payload"))
    members = near.join(payload, "h").select("key", F.col("h").alias("id"), "payload")
    roots = components(link_groups(members, jaccard_forest(settings.similarity)))
    clustered = stage(repeated.drop("shingles").join(roots, F.col("h") == F.col("node"), "left")
                      .select("doc_id", "row", "no", "first_word", "n_words", F.coalesce("root", "h").alias("cluster")), "clustered-pieces")
    unstage(hits, repeated)
    first = (clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "no")).alias("first"))
             .filter("n > 1").drop("n"))
    joined = clustered.join(first, "cluster").select(
        "doc_id", "row", "no", "first_word", "n_words", F.col("first.doc_id").alias("first_doc"),
        ((F.col("row") != F.col("first.row")) | (F.col("no") != F.col("first.no"))).alias("removed"))
    text = Window.partitionBy("row").orderBy("no")
    runs_ = joined.withColumn("run", F.col("no") - F.row_number().over(text))
    long = runs_.withColumn("total", F.sum("n_words").over(Window.partitionBy("row", "run"))).filter(F.col("total") >= settings.min_words)
    parted = long.withColumn("part", F.col("no") - F.row_number().over(Window.partitionBy("row", "run", "removed").orderBy("no")))
    return (parted.groupBy("row", "run", "removed", "part")
            .agg(F.first("doc_id").alias("doc_id"), F.min("first_word").cast("long").alias("first_word"), F.sum("n_words").alias("n_words"),
                 F.min_by("first_doc", "no").alias("first_doc"))
            .select("doc_id", "first_word", "n_words", "first_doc", "removed"))


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the removed ``passages`` cut out of their texts, the white space behind them too.

    Passages are matched by doc_id, which must be unique; a row without doc_id stays as it is.
    """
    spans = (passages.filter("removed and doc_id is not null").groupBy("doc_id")
             .agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("_spans")))  # bounded by a text's words
    marked = docs.join(spans, "doc_id", "left").select(*docs.columns, "_spans")
    at = docs.columns.index("text")

    def work(batches):
        for b in batches:
            out = []
            for text, spans_ in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if spans_ and text:
                    places = [m.start() for m in WORD.finditer(text)] + [len(text)]
                    for s in reversed(spans_):
                        text = text[:places[s["first_word"]]] + text[places[min(s["first_word"] + s["n_words"], len(places) - 1)]:]
                out.append(text)
            columns = list(b.columns)[:-1]
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_columns)

    docs_columns = docs.columns
    return marked.mapInArrow(work, docs.schema)
