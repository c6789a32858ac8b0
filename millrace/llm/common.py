"""Helpers of the corpus operators: text columns, runs of sorted rows, grouped linking, components."""

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names; a null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def runs(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal first ``n_keys`` columns (not null), across batch borders."""
    held, held_key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        edges = [0, *change.tolist(), b.num_rows]
        for start, end in zip(edges, edges[1:]):
            key = tuple(k[start].item() for k in keys)
            if held and key != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(b.slice(start, end - start))
    if held:
        yield held_key, pa.Table.from_batches(held)


class Forest:
    """Union-find over the members of one bounded group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def link_groups(members: DataFrame, link: Callable[[list], Forest], limit: int = 4096) -> DataFrame:
    """Edges (a, b) that connect the linked members of every group.

    ``members`` has key, id and payload, no row twice. A group of up to ``limit`` members is one
    unit of work. A larger one is cut into shards of about that size and every pair of shards is
    a unit, so that each pair of members meets somewhere and no task holds more than two shards.
    ``link`` gets the payloads of a unit and returns a forest; a unit emits one edge for each
    member that is not its tree's root, never all pairs.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shards = F.ceil(F.col("n") / F.lit(limit)).cast("long")
    spread = (members.join(sizes, "key").withColumn("shards", shards)
              .withColumn("own", F.pmod(F.xxhash64("id"), F.col("shards")))
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
              .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "payload")
              .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"))

    def emit(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        a, b = [], []
        for _, group in runs(batches, 3):
            ids = group.column("id").to_pylist()
            forest = link(group.column("payload").to_pylist())
            for i, x in enumerate(ids):
                root = forest.find(i)
                if root != i:
                    a.append(x)
                    b.append(ids[root])
            if len(a) > 100_000:
                yield batch(schema, a, b)
                a, b = [], []
        yield batch(schema, a, b)

    return spread.mapInArrow(emit, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b) as (node, root), root being the smallest node.

    Each round every node moves to the neighbour with the smallest random rank, if that is below
    its own, and the edges follow; a round leaves a fraction of the nodes, whatever the shape, so
    the rounds grow with the logarithm of the largest component. Per node only a minimum is kept,
    combined before the shuffle. Rounds are written to the shared folder, which cuts the lineage.
    """
    def ordered(df):
        return (df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    edges = stage(ordered(edges.select("a", "b")), "edges")
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    turn = 0
    while not edges.isEmpty():
        rank = lambda c, turn=turn: F.xxhash64(F.col(c), F.lit(turn))
        both = edges.union(edges.select("b", "a"))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("to"))).alias("m"))
        moved = stage(best.select(F.col("a").alias("at"), F.when(F.col("m.rank") < rank("a"), F.col("m.to"))
                                  .otherwise(F.col("a")).alias("to")), "moved")
        labels = moved.select(F.col("at").alias("node"), F.col("to").alias("root")) if turn == 0 else \
            stage(labels.join(moved, labels.root == moved["at"], "left")
                  .select("node", F.coalesce("to", "root").alias("root")), "labels")
        left = moved.select(F.col("at").alias("a"), F.col("to").alias("a_to"))
        right = moved.select(F.col("at").alias("b"), F.col("to").alias("b_to"))
        edges = stage(ordered(edges.join(left, "a").join(right, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))),
                      "edges")
        turn += 1
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(least, "root").select("node", F.col("least").alias("root"))
