"""Near copies of whole texts: MinHash bands for candidates, exact Jaccard of word shingles, components."""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from . import simhash
from .common import Forest, batch, components, link_groups, texts
from .words import SPACE, hashed, mixed, powers


@dataclass(frozen=True)
class Settings:
    """shingle: words of a shingle. similarity: Jaccard of two texts' sets of shingles that links them.
    bands, rows: MinHash bands and smallest shingles in each; linked texts share a band with
    probability 1 - (1 - similarity ** rows) ** bands at least, 0.9998 for the defaults. early: bands
    looked through first, so that the others only deal with what these left apart. group: most
    texts of a band's group in one unit of work."""
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 16
    rows: int = 4
    early: int = 2
    group: int = 1024


def sketch(all_texts: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the set, band keys, shingles of all texts, ends of each text's shingles).

    A text of fewer words than a shingle has one shingle, all its words; a text without words has
    shingle zero. Shingles of a text are distinct and sorted.
    """
    words, starts = hashed(all_texts, SPACE)
    size, (up, _) = settings.shingle, powers()
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    whole = np.zeros(len(words), np.uint64)
    for k in range(size):
        whole += padded[k:k + len(words)] * up[k + 1]
    whole = (mixed(whole) >> np.uint64(32)).astype(np.uint32)
    sets = []
    for a, b in zip(starts.tolist(), starts[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(whole[a:b - size + 1]))
        elif b > a:
            sets.append((mixed((words[a:b] * up[1:b - a + 1]).sum(keepdims=True)) >> np.uint64(32)).astype(np.uint32))
        else:
            sets.append(np.zeros(1, np.uint32))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint32)
    ends = np.cumsum([len(s) for s in sets])
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    x = mixed(flat.astype(np.uint64) + np.uint64(1))
    odd = np.random.default_rng(3).integers(0, 1 << 63, (settings.bands, settings.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    keys = np.empty((len(sets), settings.bands), np.uint64)
    for band in range(settings.bands):
        key = np.full(len(sets), band + 1, np.uint64)
        for m in odd[band]:
            key = mixed(key * np.uint64(31) + np.minimum.reduceat(x * m, begins))
        keys[:, band] = key
    return mixed(np.add.reduceat(x, begins)), keys, flat, ends


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, h (hash of the set of shingles), keys (one for each band), shingles (packed)."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("keys", pa.list_(pa.int64())), ("shingles", pa.binary())])

    def work(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                h, keys, flat, ends = sketch(part.column(1).to_pylist(), settings)
                packed = [flat[a:e].tobytes() for a, e in zip([0, *ends[:-1].tolist()], ends.tolist())]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * settings.bands, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield batch(schema, part.column(0), h.view(np.int64), lists, packed)

    return texts(docs).mapInArrow(work, "doc_id long, h long, keys array<long>, shingles binary")


def jaccard_forest(similarity: float):
    """Links every pair of sets with that Jaccard similarity: two such sets share one of the smallest
    |s| - ceil(similarity * |s|) + 1 members of each. Sets listed under a member are kept by tree, as
    those of the own tree need no look."""
    def link(payloads: list[bytes]) -> Forest:
        forest, sets, index = Forest(len(payloads)), [], {}
        for i, p in enumerate(payloads):
            members = np.frombuffer(p, np.uint32).tolist()
            s, n = set(members), len(members)
            sets.append(s)
            prefix = members[:n - math.ceil(similarity * n - 1e-9) + 1]
            tried = set()
            for x in prefix:
                for tree, others in index.get(x, {}).items():
                    if forest.find(tree) == forest.find(i):
                        continue
                    for j in others:
                        if j in tried:
                            continue
                        tried.add(j)
                        m = len(sets[j])
                        if min(m, n) < similarity * max(m, n) - 1e-9:
                            continue
                        shared = len(s & sets[j])
                        if shared >= similarity * (n + m - shared) - 1e-9:
                            forest.join(i, j)
                            break
            for x in prefix:
                index.setdefault(x, {}).setdefault(forest.find(i), []).append(i)
        return forest
    return link


def near_copies(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over links of ``similarity`` or more.

    Texts with equal sets are one node. Candidates share a MinHash band; each pair of them that isn't
    linked yet is compared exactly. The first bands link nearly all there is, and only groups of the
    other bands with texts of different components are compared again. Null and empty texts are alike.
    A row without doc_id gets the smallest doc_id of its component, null if there is none.
    """
    found = stage(sketches(docs, settings), "near-sketches")
    nodes = found.groupBy("h").agg(F.min("doc_id").alias("doc"))
    edges = roots = None
    for first, last in ((0, settings.early), (settings.early, settings.bands)):
        if first >= last:
            continue
        keyed = found.select("h", F.explode(F.slice("keys", first + 1, last - first)).alias("key"))
        known = keyed.withColumn("root", F.col("h")) if roots is None else \
            keyed.join(roots, keyed.h == roots.node, "left").select("h", "key", F.coalesce("root", "h").alias("root"))
        open_ = (known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key"))
        near = stage(keyed.join(open_, "key").select("key", "h").distinct(), "near-candidates")
        payload = found.join(near.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.first("shingles").alias("payload"))
        members = near.join(payload, "h").select("key", F.col("h").alias("id"), "payload")
        more = stage(link_groups(members, jaccard_forest(settings.similarity), settings.group), "near-edges")
        edges = more if edges is None else edges.union(more)
        roots = components(edges)
    rooted = nodes.join(roots, nodes.h == roots.node, "left").select("h", "doc", F.coalesce("root", "h").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = rooted.join(least, "root").select("h", "component_id")
    return found.select("doc_id", "h").join(named, "h").select("doc_id", "component_id")


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``simhash.keep_least`` of ``near_copies``."""
    return simhash.keep_least(docs, near_copies(docs, settings))
