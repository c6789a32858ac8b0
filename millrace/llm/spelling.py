"""Spelling variants: near words by a bidirectional FM-index, the commonest near word, and chains of them."""

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .common import batch, runs, texts

END, BORDER = 0, 1  # symbols below all letters: the end of the delimited text, and what stands around each word
RUN = re.compile(r"[a-zÀ-ÿ]+")


@dataclass(frozen=True)
class Settings:
    """length and count: least code points and occurrences of a word. ratio: a form has at least so many times the
    word's occurrences. drop: one code point is left out of each run whose hash this number divides, as misspellings
    to be found; 0 leaves all as they are. shard: words of an index, and of one key in it. asked: words that
    are searched at once. held: different words that a task counts before it sends them on."""
    length: int = 6
    count: int = 5
    ratio: int = 5
    drop: int = 199
    shard: int = 20_000
    asked: int = 20_000
    held: int = 1_000_000

    def __post_init__(self):
        if self.ratio <= 1:
            raise ValueError("with a ratio of 1 forms could go round in circles")


def vocabulary(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """word and n, its occurrences in all texts, of the words that are long and frequent enough.

    Counts are summed within a task before the shuffle. Lower case covers A-Z only. A null text has no words; a
    null doc_id is hashed as an empty one; repeated rows count again.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def work(batches):
        total = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                known = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    if len(word) >= s.length:  # leaving a code point out makes none longer
                        if s.drop and (h := zlib.crc32(word.encode(), known)) % s.drop == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < s.length:
                                continue
                        total[word] += n
                if len(total) > s.held:
                    yield batch(schema, *zip(*total.items()))
                    total = Counter()
        if total:
            yield batch(schema, *zip(*total.items()))

    counts = texts(docs).mapInArrow(work, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= s.count)


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by doubling the compared length until all differ."""
    n, rank, width = len(text), text.astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        second[:max(0, n - width)] = rank[width:] + 1
        key = rank * (int(second.max()) + 1) + second
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class Ranks:
    """One direction of the index: intervals of suffix ranks over the delimited words, extended to the left."""

    def __init__(self, words: list[bytes]):
        mark = bytes([BORDER])
        text = np.frombuffer(mark + mark.join(words) + mark + bytes([END]), np.uint8)
        self.n = len(text)
        self.place = suffix_ranks(text)
        self.before = text[self.place - 1]  # the symbol in front of each suffix
        # places of each symbol in ``before``, symbols in order: an interval's borders after a symbol are found by bisection
        self.steps = np.sort(self.before.astype(np.int64) * self.n + np.arange(self.n))
        self.symbols = np.unique(self.before[self.before > BORDER])
        self.starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words[:-1]], dtype=np.int64)])

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with a symbol and go on with one of lo to hi; lo = hi if there is none."""
        at = symbol.astype(np.int64) * self.n
        return np.searchsorted(self.steps, at + lo), np.searchsorted(self.steps, at + hi)

    def choices(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the interval, letter) for the letters in front of each interval's suffixes, of small
        intervals by looking, of others all letters there are (some of which lead nowhere)."""
        size = hi - lo
        looked = size <= len(self.symbols)
        n = np.where(looked, size, len(self.symbols))
        which = np.repeat(np.arange(len(lo)), n)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        seen = self.before[np.where(looked[which], lo[which] + offset, 0)]
        letter = np.where(looked[which], seen, self.symbols[np.where(looked[which], 0, offset)]) if len(self.symbols) else seen
        pair = np.unique((which * 256 + letter)[letter > BORDER])
        return pair >> 8, pair & 0xFF

    def words_at(self, lo: np.ndarray) -> np.ndarray:
        """Numbers of the words whose leading border is the suffix of rank lo."""
        return np.searchsorted(self.starts, self.place[lo])


def near(index: Ranks, asked: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number in ``asked``, number of the index's word) of all words that share the last ``exact`` symbols with a
    word and differ from it by one inserted, deleted or replaced symbol, each once.

    The exact part is matched first, its border included; the interval is then extended to the left, and at each
    place leaves the exact path by one error, after which it must go on without. An inserted symbol differs from the
    asked one behind it in reading order, and the last of a run of equal symbols is the one deleted: so no word is found twice.
    """
    length = np.array([len(w) for w in asked], np.int64)
    base = np.concatenate([[0], np.cumsum(length + 1)])
    data = np.frombuffer(bytes([BORDER]) + bytes([BORDER]).join(asked), np.uint8)  # a border in front of each word

    def symbol(who, j):  # the j-th from the right; behind the whole word its border
        return data[base[who] + length[who] - j]

    who = np.arange(len(asked))
    lo, hi = index.extend(np.zeros(len(asked), np.int64), np.full(len(asked), index.n), np.full(len(asked), BORDER))
    empty = np.empty(0, np.int64)
    late = (empty, empty, empty, empty)  # asked word, next symbol, interval, of those that have their error
    found, j = [], 0
    while len(who) or len(late[0]):
        fresh = [late]
        free = np.flatnonzero(j >= exact[who])
        if len(free):
            w, a, b = who[free], lo[free], hi[free]
            which, letter = index.choices(a, b)
            other = letter != symbol(w[which], j)
            which, letter = which[other], letter[other]
            x, y = index.extend(a[which], b[which], letter)
            into = w[which]
            fresh.append((into, np.full(len(into), j), x, y))  # inserted
            inner = j < length[into]
            fresh.append((into[inner], np.full(int(inner.sum()), j + 1), x[inner], y[inner]))  # replaced
            gone = np.flatnonzero(j < length[w])
            gone = gone[symbol(w[gone], j) != symbol(w[gone], j + 1)]
            fresh.append((w[gone], np.full(len(gone), j + 1), a[gone], b[gone]))  # deleted
        late = tuple(np.concatenate(c) for c in zip(*fresh))
        some = late[3] > late[2]
        w, k, a, b = (c[some] for c in late)
        a, b = index.extend(a, b, symbol(w, k))
        done = (k == length[w]) & (b > a)
        found.append((w[done], index.words_at(a[done])))
        going = (k < length[w]) & (b > a)
        late = (w[going], k[going] + 1, a[going], b[going])
        on = j < length[who]
        who, lo, hi = who[on], lo[on], hi[on]
        lo, hi = index.extend(lo, hi, symbol(who, j))
        who, lo, hi = (c[hi > lo] for c in (who, lo, hi))
        j += 1
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (empty, empty)


def _halves(least: int) -> dict[int, tuple[Column, list[Column]]]:
    """For each direction, the key under which a word is indexed and the keys under which near words may be.

    Two near words share the first half of either (rounded down) or its second half. A half's length depends on
    the asked word, so a word is indexed by the shortest half that a word asking for it can have.
    """
    m = F.length("word")
    half = lambda n: F.greatest(F.expr(f"{n} div 2"), F.lit(least)).cast("int")
    first = [half("(length(word) - 2)"), half("(length(word) - 1)"), half("length(word)")]
    last = [half("(length(word) - 1)"), half("length(word)"), half("(length(word) + 1)")]
    return {0: (F.substring("word", F.lit(1), first[1]), [F.substring("word", F.lit(1), n) for n in first]),
            1: (F.substring("word", m - last[1] + 1, last[1]), [F.substring("word", m - n + 1, n) for n in last])}


def near_words(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """word, n_near, form and form_n (commonest near word, ties to the smallest) of the words that have a near one.

    ``words`` has word and n, no word twice, of at least ``length`` code points up to U+00FF. The rightward index is
    sharded by the beginnings of its words, the leftward one by their ends; a word asks the shards that can hold
    words with its own half, and gets sums and a maximum from each, never a list of pairs. A key with more words
    than ``shard`` is dealt over several parts, and its askers go to each.
    """
    n_shards = 64 + words.count() // s.shard
    held, asking = [], []
    for side, (own, others) in _halves(s.length // 2).items():
        held.append(words.select(F.lit(side).alias("side"), own.alias("key"), "word", "n"))
        asking.append(words.select(F.lit(side).alias("side"), F.explode(F.array_distinct(F.array(*others))).alias("key"), "word"))
    held, asking = (a.unionByName(b) for a, b in (held, asking))
    hot = (held.groupBy("side", "key").agg(F.count("*").alias("size")).filter(F.col("size") > s.shard)
           .select("side", "key", F.ceil(F.col("size") / s.shard).cast("long").alias("parts")))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    shard = F.pmod(F.xxhash64("side", "key", "part"), F.lit(n_shards)).alias("shard")
    held = (held.join(hot, ["side", "key"], "left").withColumn("part", F.pmod(F.xxhash64("word"), parts))
            .select("side", shard, "word", "n"))
    asking = (asking.join(hot, ["side", "key"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
              .select("side", shard, "word", F.lit(None).cast("long").alias("n")))
    # a word that asks a shard under several keys asks it once
    rows = held.unionByName(asking).groupBy("side", "shard", "word").agg(F.max("n").alias("n"), F.max(F.col("n").isNull()).alias("asks"))
    rows = rows.repartition(2 * n_shards, "side", "shard").sortWithinPartitions("side", "shard", "word")
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])

    def work(batches):
        for (side, _), group in runs(batches, 2):
            names, counts = group.column("word").to_pylist(), group.column("n").to_numpy()
            indexed, asks = np.flatnonzero(~np.isnan(counts)), np.flatnonzero(group.column("asks").to_numpy())
            if not len(indexed):
                continue
            turn = 1 if side else -1
            index = Ranks([names[i].encode("latin-1")[::turn] for i in indexed.tolist()])
            for lo in range(0, len(asks), s.asked):
                some = [names[i] for i in asks[lo:lo + s.asked].tolist()]
                half = [len(w) // 2 for w in some]
                exact = np.array([len(w) - h if side else h for w, h in zip(some, half)], np.int64)
                who, what = near(index, [w.encode("latin-1")[::turn] for w in some], exact)
                if side:  # words that share the first half as well are found from there
                    new = [not names[i].startswith(some[w][:half[w]]) for w, i in zip(who.tolist(), indexed[what].tolist())]
                    who, what = who[new], what[new]
                order = np.lexsort((what, -counts[indexed[what]], who))  # words are sorted: the smallest of a tie is first
                asker, at, n = np.unique(who[order], return_index=True, return_counts=True)
                best = indexed[what[order][at]]
                yield batch(schema, [some[w] for w in asker.tolist()], n, [names[i] for i in best.tolist()], counts[best].astype(np.int64))

    found = rows.mapInArrow(work, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
            .select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n")))


def roots(links: DataFrame) -> DataFrame:
    """word and root of every row of ``links`` (word, form), the last word that following forms leads to.

    Each round doubles the steps that a link stands for; a form's count is larger than its word's, so chains are
    short and end. Rounds are written to the shared folder.
    """
    at = stage(links.select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = at.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = stage(at.join(ahead, at.root == F.col("_at"), "left")
                      .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("on")), "links")
        if moved.filter("on").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def variants(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary of ``docs`` (doc_id, text).

    form is the commonest near word if it occurs at least ``ratio`` times as often as the word, else null; root is
    the end of the chain of forms, the word itself if it has none. No documents, no rows.
    """
    words = stage(vocabulary(docs, s), "vocabulary")
    good = F.col("form_n") >= s.ratio * F.col("n")
    linked = stage(words.join(near_words(words, s), "word", "left").select(
        "word", F.when(good, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(good, F.col("form_n")).alias("form_n")), "variants")
    ends = roots(linked.filter("form is not null"))
    return (linked.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
