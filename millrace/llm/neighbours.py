"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage
from .common import batch, runs


@dataclass(frozen=True)
class Settings:
    """bits: of a code. parts: substrings, each with an index of its own. sample: most vectors that the
    rotation and the radius are learned from. quantile: share of the sample's true neighbours that lie
    within the learned radius; the neighbours among all rows are nearer than those in a sample, so the
    recall over all rows is above it. block: most indexed vectors of one bucket in a unit of work."""
    bits: int = 64
    parts: int = 8
    sample: int = 8_192
    quantile: float = 0.93
    block: int = 20_000


@dataclass
class Codes:
    """Learned map from unit vectors to codes."""
    mean: np.ndarray
    rotation: np.ndarray
    radius: int
    settings: Settings

    def of(self, unit: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes, one byte (of bits / parts bits) for each substring."""
        bits = (unit - self.mean) @ self.rotation > 0
        return pack(bits, self.settings.parts)


def pack(bits: np.ndarray, parts: int) -> np.ndarray:
    n, b = bits.shape
    weights = 1 << np.arange(b // parts)
    return (bits.reshape(n, parts, b // parts) * weights).sum(2).astype(np.uint16)


POPCOUNT = np.array([i.bit_count() for i in range(1 << 16)], np.uint8)


def fit(sample: np.ndarray, settings: Settings, k: int = 5) -> Codes:
    """Iterative quantization: principal axes, then the rotation that brings the projected vectors
    nearest to the corners of the cube, by turns of signs and a Procrustes fit. With more bits than
    dimensions, further random rotations of the axes are appended."""
    rng = np.random.default_rng(0)
    n, dims = sample.shape
    mean = sample.mean(0) if n else np.zeros(dims)
    z = sample - mean
    rotations = []
    left = settings.bits
    axes = np.linalg.svd(z.T @ z)[0] if n else np.eye(dims)
    while left > 0:
        use = min(left, dims)
        p = axes[:, :use]
        r = np.linalg.qr(rng.normal(size=(use, use)))[0]
        for _ in range(30 if n else 0):
            u, _, v = np.linalg.svd(np.sign(z @ p @ r).T @ (z @ p))
            r = (u @ v).T
        rotations.append(p @ r)
        left -= use
    codes = Codes(mean, np.concatenate(rotations, axis=1), settings.bits, settings)
    if n > k + 1:
        packed = codes.of(sample)
        ask = np.linspace(0, n - 1, min(n, 512)).astype(int)
        near = []
        for q in ask:
            score = sample @ sample[q]
            score[q] = -2
            best = np.argpartition(-score, k)[:k]
            near.append(POPCOUNT[packed[best] ^ packed[q]].sum(1, dtype=int))
        codes.radius = int(np.quantile(np.concatenate(near), settings.quantile, method="higher"))
    return codes


def vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and v, the usable vectors as doubles: not null, not zero, all components finite."""
    v = F.col(vec_col).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").filter(good)


def classes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with the k + 1 smallest ids of each: copies tie in every score, so more of them
    can't be among k neighbours. class_id is the smallest id. The limit acts before the shuffle too."""
    first = Window.partitionBy("v").orderBy("vec_id")
    return (rows.distinct().withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k + 1)
            .groupBy("v").agg(F.min("vec_id").alias("class_id"), F.array_sort(F.collect_list("vec_id")).alias("ids")))


def _matrix(column) -> np.ndarray:
    """Rows of doubles stored as binary."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1) if values else np.zeros((0, 1))


def _coded(frame: DataFrame, codes: Codes, id_name: str) -> DataFrame:
    """id, code (binary) and v (binary doubles)."""
    schema = pa.schema([(id_name, pa.int64()), ("code", pa.binary()), ("v", pa.binary())])

    def work(batches):
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(1).to_pylist(), np.float64)
                code = codes.of(x / np.linalg.norm(x, axis=1, keepdims=True))
                yield batch(schema, b.column(0), [c.tobytes() for c in code], [r.tobytes() for r in x])

    return frame.select(id_name, "v").mapInArrow(work, f"{id_name} long, code binary, v binary")


def _search(index: DataFrame, queries: DataFrame, radius: int, k: int, shards: int, settings: Settings) -> DataFrame:
    """query_id, class_id, score: the k + 1 nearest classes of each query in each unit of work, out of
    all whose code is within ``radius``.

    Two codes within the radius are within radius // parts in one of their substrings (pigeonhole). A
    code is filed under each substring's value; a query asks for all values near its own. A pair that
    meets in several substrings is taken in the first only.
    """
    parts, width = settings.parts, settings.bits // settings.parts
    reach = min(radius // parts, width)
    # when every value is near, one substring holds all pairs
    used = 1 if reach >= width else parts
    values = np.arange(1 << width)
    near = [values[POPCOUNT[values ^ v] <= reach].tolist() for v in values]

    def keys(query: bool):
        schema = pa.schema([("part", pa.int32()), ("value", pa.int32()), ("shard", pa.int32()), ("is_query", pa.int32()),
                            ("id", pa.int64()), ("code", pa.binary()), ("v", pa.binary())])

        def work(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 20 if query else 2000):
                    s = b.slice(lo, 20 if query else 2000)
                    rows = []
                    for i, code, v in zip(*(c.to_pylist() for c in s.columns)):
                        split = np.frombuffer(code, np.uint16)
                        for p in range(used):
                            if query:
                                rows += [(p, value, shard, 1, i, code, v) for value in near[split[p]] for shard in range(shards)]
                            else:
                                rows.append((p, int(split[p]), (i * 0x9E3779B97F4A7C15 >> 17) % shards, 0, i, code, v))
                    if rows:
                        yield batch(schema, *zip(*rows))
        return work

    form = "part int, value int, shard int, is_query int, id long, code binary, v binary"
    filed = index.mapInArrow(keys(False), form)
    asked = queries.mapInArrow(keys(True), form)
    units = filed.unionAll(asked).repartition("part", "value", "shard").sortWithinPartitions("part", "value", "shard", "is_query")
    schema = pa.schema([("query_id", pa.int64()), ("class_id", pa.int64()), ("score", pa.float64())])

    def match(batches):
        held = None
        for (*key, is_query), group in runs(batches, 4):
            part = key[0]
            if not is_query:
                ids, code = np.array(group.column("id").to_pylist()), np.frombuffer(b"".join(group.column("code").to_pylist()), np.uint16).reshape(-1, parts)
                x = _matrix(group.column("v"))
                norm = np.linalg.norm(x, axis=1)
                held = key
                continue
            if held != key:
                continue
            q_out, c_out, s_out = [], [], []
            for qid, qcode, qv in zip(group.column("id").to_pylist(), group.column("code").to_pylist(), group.column("v").to_pylist()):
                apart = POPCOUNT[code ^ np.frombuffer(qcode, np.uint16)]
                ok = apart.sum(1, dtype=np.int32) <= radius
                if part:
                    ok &= (apart[:, :part] > reach).all(1)
                rows = np.flatnonzero(ok)
                if len(rows):
                    y = np.frombuffer(qv, np.float64)
                    score = x[rows] @ y / (norm[rows] * np.linalg.norm(y))
                    if len(rows) > k + 1:
                        # ties at the border stay, for the smaller id to win
                        border = np.partition(score, len(rows) - k - 1)[len(rows) - k - 1]
                        best = np.flatnonzero(score >= border - 1e-12)
                        best = best[np.lexsort((ids[rows[best]], -score[best]))][:2 * k + 2]
                        rows, score = rows[best], score[best]
                    q_out += [qid] * len(rows)
                    c_out += ids[rows].tolist()
                    s_out += score.tolist()
            yield batch(schema, q_out, c_out, s_out)

    return units.mapInArrow(match, "query_id long, class_id long, score double")


def nearest(table: DataFrame, is_query, k: int = 5, settings: Settings = Settings(), id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows by cosine of every row with ``is_query`` (a
    condition on vec_id), but itself; ties go to the smaller vec_id.

    Every distinct vector is indexed, with the ids of its copies. Queries for which fewer than k rows
    lie within the learned radius are asked again with the full radius, so all get k rows if there are
    so many. Rows without id, and vectors null, zero or with a null or non-finite component take no
    part; vectors must have one length. Rows that repeat an id and vector count once.
    """
    spark = table.sparkSession
    rows = vectors(table, id_col, vec_col)
    distinct = stage(classes(rows, k), "vector-classes")
    sample = np.array([r.v for r in distinct.select("class_id", "v").orderBy(F.xxhash64("class_id"), "class_id").limit(settings.sample).collect()], np.float64)
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = fit(sample / np.linalg.norm(sample, axis=1, keepdims=True), settings, k)
    index = stage(_coded(distinct, codes, "class_id"), "vector-index")
    # a query is a class with an asked id: copies ask once
    asked = rows.filter(is_query).distinct()
    named = stage(asked.join(distinct.select(F.col("v").alias("w"), "class_id"), F.col("v") == F.col("w")).select("vec_id", "class_id"), "vector-queries")
    queries = index.join(named.select("class_id").distinct(), "class_id", "left_semi")
    shards = max(1, -(-index.count() // (settings.block << (settings.bits // settings.parts))))

    def ranked(found: DataFrame) -> DataFrame:
        top = Window.partitionBy("query_class").orderBy(F.desc("score"), "class_id")
        near = (found.withColumnRenamed("query_id", "query_class").withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k + 1)
                .join(distinct.select("class_id", "ids"), "class_id").select("query_class", F.explode("ids").alias("vec_id"), "score"))
        rows_of = named.withColumnsRenamed({"vec_id": "query_id", "class_id": "query_class"})
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return (rows_of.join(near, "query_class").filter("query_id <> vec_id").withColumn("rank", F.row_number().over(order))
                .filter(F.col("rank") <= k).select("query_id", "query_class", "rank", "vec_id", "score"))

    out = ["query_id", "rank", "vec_id", "score"]
    first = stage(ranked(_search(index, queries, codes.radius, k, shards, settings)), "neighbours")
    full = first.filter(F.col("rank") == k).select("query_id")
    few = stage(named.join(full, named.vec_id == full.query_id, "left_anti").select("class_id").distinct(), "vector-again")
    if few.isEmpty():
        return first.select(*out)
    again = ranked(_search(index, index.join(few, "class_id", "left_semi"), settings.bits, k, shards, settings))
    kept = first.join(few, first.query_class == few.class_id, "left_anti")
    return kept.select(*out).unionByName(again.select(*out))
