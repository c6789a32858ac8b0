"""SimHash near-duplicates, linked with BK-trees."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from ..session import stage
from .common import Forest, batch, components, link_groups, texts

SEED = 42
RADIUS = 2
MASK = (1 << 64) - 1


def fingerprint(text: str) -> int:
    """64-bit SimHash of a whole text: 3-word shingles, repeats included, A-Z lower-cased."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < 3:
        return xxh64_intdigest(b" ".join(words), SEED)
    votes, n = np.zeros(64, np.int64), len(words) - 2
    for at in range(0, n, 65_280):  # bounded memory for very long texts
        part = words[at:at + 65_282]
        hashes = np.fromiter((xxh64_intdigest(b" ".join(s), SEED) for s in zip(part, part[1:], part[2:])), "<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        votes += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        votes += bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def work(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
            yield batch(schema, b.column(0), pa.array(fps.view(np.int64)))

    return texts(docs).mapInArrow(work, "doc_id long, fp long")


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        if not new:
            return
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                return
            at = self.children[at][d]

    def within(self, value: int, radius: int):
        """Numbers of the nodes within the radius; by the triangle inequality only edges whose key
        is within the radius of the distance to the parent can lead to one."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            children = self.children[at]
            for edge in range(d - radius, d + radius + 1):
                if edge in children:
                    todo.append(children[edge])


def bk_forest(values: list[int], radius: int = RADIUS) -> Forest:
    forest, tree = Forest(len(values)), BKTree()
    for i, v in enumerate(values):
        v &= MASK
        for j in tree.within(v, radius):
            forest.join(i, j)
        tree.add(v)
    return forest


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links of at most 2 bits).

    Equal fingerprints are one node. Two within 2 bits agree in two of their four 16-bit blocks
    at least, so the shards are the sets of fingerprints that agree in such a pair of blocks. A
    shard's tree lives in the task that owns the shard: the trees grow with the corpus, and
    sending each only to the fingerprints that can reach it keeps the work in proportion.

    A null text counts as empty; empty texts share fingerprint zero. Repeated rows each get a row.
    A row without doc_id gets the smallest doc_id of its component, null if there is none.
    """
    fps = stage(fingerprints(docs), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    keys = F.array(*[F.lit(n << 32).cast("long").bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j])
                     for n, (i, j) in enumerate(pairs)])
    members = nodes.select(F.explode(keys).alias("key"), F.col("fp").alias("id"), F.col("fp").alias("payload"))
    roots = components(link_groups(members, bk_forest))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each component of ``found``, that with the smallest doc_id.

    Rows that repeat a kept doc_id are one row; rows without doc_id always stay.
    """
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.filter("doc_id is not null").join(kept, F.col("doc_id") == F.col("_kept")).drop("_kept")
    return rows.dropDuplicates(["doc_id"]).union(docs.filter("doc_id is null"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``keep_least`` of ``near_duplicates``."""
    return keep_least(docs, near_duplicates(docs))
