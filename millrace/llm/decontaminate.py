"""Benchmark decontamination: CGK walks, repeated bit sampling over windows of the items, edit verification."""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, texts
from .words import hashed, mixed


@dataclass(frozen=True)
class Settings:
    """Parameters of the search.

    similarity: an item is found if some stretch of the text is within
    ``(1 - similarity) * words`` word edits of it, whatever its length. repeats, samples: walks from
    each window's start, and positions of a walk that make up its key. stride: words between the
    windows of a text; one for items of fewer than ``short`` words. share: agreeing keys asked for, as a
    share of those that a stretch without edits has at least, and half of it for items of fewer than ``short``
    words. gram: most words of a gram of the yardstick ``Grams``. block_items: benchmark items per
    pass over the documents. block_hits: about the most hits looked at together.
    """
    similarity: float = 0.8
    repeats: int = 5
    samples: int = 3
    stride: int = 2
    short: int = 10
    share: float = 0.14
    gram: int = 3
    block_items: int = 2000
    block_hits: int = 2_000_000


# Han, kana, Thai, Lao, Burmese and Khmer are written without spaces.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
                      "\uff66-\uff9f\U00020000-\U0003ffff])")


def words_of(texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``hashed`` with each character of a script without spaces as a word."""
    return hashed([t if t.isascii() else UNSPACED.sub(r" \1 ", t) for t in texts_])


def plan(n: int, settings: Settings) -> tuple[int, int, int]:
    """(edits, words of a gram, grams that remain at least) for an item of n words.

    An edit destroys at most q of the item's n - q + 1 grams of q words, so a stretch within k edits
    holds n - q + 1 - k * q of them or more; the longest grams of which one remains are taken.
    """
    most = int((1 - settings.similarity) * n + 1e-9)
    for q in range(min(settings.gram, n), 0, -1):
        if (least := n - q + 1 - most * q) >= 1:
            return most, q, least
    return most, 1, 1


def gram_keys(words: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q words from each place on."""
    keys = np.zeros(max(0, len(words) - q + 1), np.uint64)
    for k in range(q):
        keys = mixed(keys * np.uint64(31) + words[k:k + len(keys)])
    return keys


def walk(flat: np.ndarray, at: np.ndarray, steps: int, samples: int, turn: int) -> np.ndarray:
    """Keys of the CGK walks of a ``turn`` from the words ``at`` on; ``flat`` goes on for ``steps`` words after each.

    Step j emits the word under the pointer, then moves the pointer by a random bit of (j, word): two
    walks that meet different words fall back into step after few of them, so an edit changes few
    of the emitted words (Hamming distance). The key hashes the words emitted at ``samples`` random
    steps, one of each equal part of the walk.
    """
    rng = np.random.default_rng([turn, steps, samples])
    bits = rng.integers(0, 64, steps).astype(np.uint64)
    cuts = np.linspace(0, steps, min(samples, steps) + 1).astype(int)
    sampled = [int(rng.integers(a, b)) for a, b in zip(cuts, cuts[1:])]
    at, keys = at.copy(), np.full(len(at), mixed(np.array([turn + 1], np.uint64))[0], np.uint64)
    for j in range(sampled[-1] + 1):
        word = flat[at]
        if j in sampled:
            keys = (keys ^ word) * np.uint64(0xD6E8FEB86659FD93)
            keys ^= keys >> np.uint64(32)
        at += ((word >> bits[j]) & np.uint64(1)).view(np.int64)
    return keys


class Block:
    """Tables of the keys of a bounded set of items, sent to the tasks."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings):
        self.settings, self.items, self.tables = settings, [], []
        most, least, kinds = [], [], {}
        for item_id, text in items:
            tokens = words_of([text or ""])[0]
            if len(tokens):
                edits, kind, hits = self.plan(len(tokens))
                keys, offset = self.item_keys(tokens, kind)
                kinds.setdefault(kind, []).append((len(self.items), keys, offset))
                most.append(edits)
                least.append(hits)
                self.items.append((item_id, tokens))
        self.most, self.least = np.array(most, np.int64), np.array(least, np.int64)
        for kind, members in kinds.items():
            keys = np.concatenate([k for _, k, _ in members])
            which = np.repeat([m for m, _, _ in members], [len(k) for _, k, _ in members])
            offset = np.concatenate([o for _, _, o in members])
            order = np.argsort(keys, kind="stable")
            shift = 64 - min(24, len(keys).bit_length() + 5)
            near = np.zeros(1 << (64 - shift), bool)
            near[(keys >> np.uint64(shift)).astype(np.int64)] = True
            self.tables.append((kind, keys[order], which[order], offset[order], near, np.uint64(shift)))

    def plan(self, n: int) -> tuple[int, tuple, int]:
        """(edits, kind of keys, keys that must agree) for an item of n words."""
        raise NotImplementedError

    def item_keys(self, tokens: np.ndarray, kind: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(keys, places they start from) of an item."""
        raise NotImplementedError

    def text_keys(self, flat: np.ndarray, starts: np.ndarray, kind: tuple, near):
        """(keys, places they start from) of all texts that ``near`` lets through, in parts."""
        raise NotImplementedError

    def search(self, flat: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text number, item_id, first word, words, edits) of the best stretch for each text and
        item; ``flat`` holds the words of all texts, text i from ``starts[i]`` to ``starts[i + 1]``."""
        found: dict[tuple[int, int], list[int]] = {}
        for kind, keys, which, offset, bitmap, shift in self.tables:
            parts = list(self.text_keys(flat, starts, kind, lambda k: bitmap[(k >> shift).astype(np.int64)]))
            mine, at = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.uint64, np.int64)))
            order = np.argsort(at, kind="stable")
            mine, at = mine[order], at[order]
            owner = np.searchsorted(starts, at, "right") - 1
            left = np.searchsorted(keys, mine, "left")
            counts = np.searchsorted(keys, mine, "right") - left
            at, owner, left, counts = (x[counts > 0] for x in (at, owner, left, counts))
            lo, total = 0, np.cumsum(counts)
            while lo < len(at):  # whole texts, up to block_hits at a time
                hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + self.settings.block_hits, "right"))
                last = owner[min(max(hi, lo + 1), len(at)) - 1]
                if hi < len(at) and owner[hi] == last and owner[lo] != last:
                    last -= 1
                hi = int(np.searchsorted(owner, last, "right"))
                n = counts[lo:hi]
                entry = np.repeat(left[lo:hi] - np.cumsum(n) + n, n) + np.arange(n.sum())
                text, item = np.repeat(owner[lo:hi], n), which[entry]
                place = np.repeat(at[lo:hi] - starts[owner[lo:hi]], n) - offset[entry]
                for t, m, p in self.aligned(text, item, place):
                    found.setdefault((t, m), []).append(p)
                lo = hi
        out = []
        for (doc, m), places in sorted(found.items()):
            item_id, item = self.items[m]
            if best := verify(flat[starts[doc]:starts[doc + 1]], item, places, int(self.most[m])):
                out.append((doc, item_id, *best))
        return out

    def aligned(self, text: np.ndarray, item: np.ndarray, place: np.ndarray):
        """(text, item, place) from which on as many hits as must remain lie within the edits, as an
        edit moves the place where the item would start by one word at most."""
        bits = len(self.items).bit_length()
        pair = (text - text[0] << bits) + item
        per_pair = np.bincount(pair)
        enough = (per_pair >= np.resize(np.pad(self.least, (0, (1 << bits) - len(self.least))), len(per_pair)))[pair]
        # one number per hit: place lies in the lower 33 bits, moved up as it may be negative
        hits = np.sort((pair[enough] << 33) + place[enough] + (1 << 32))
        pair, place, first = hits >> 33, (hits & ((1 << 33) - 1)) - (1 << 32), text[0]
        item = pair & ((1 << bits) - 1)
        end = np.arange(len(hits)) + self.least[item] - 1
        ok = np.flatnonzero(end < len(hits))
        end = end[ok]
        ok = ok[(pair[ok] == pair[end]) & (place[end] - place[ok] <= self.most[item[ok]])]
        new = np.ones(len(ok), bool)
        new[1:] = np.diff(hits[ok]) != 0
        ok = ok[new]
        return zip(((pair[ok] >> bits) + first).tolist(), item[ok].tolist(), place[ok].tolist())


class Walks(Block):
    """Candidates by CGK walks and bit sampling: the search that ``leaks`` uses.

    A window is as long as the item, but no longer than the words that come with one of the edits allowed, as walks
    over more edits than one or two seldom agree; a longer item has a window from each of its words, and its keys
    add up. A walk takes as many steps as its window has words, so it never leaves an item whose
    words all have to be there.
    """

    def plan(self, n):
        s = self.settings
        most = int((1 - s.similarity) * n + 1e-9)
        steps = min(n, int(1 / max(1e-9, 1 - s.similarity) + 1e-9) + 1)
        stride = 1 if n < s.short else s.stride
        return most, (steps, stride), max(1, int(s.share * s.repeats * n / (2 if n < s.short else stride)) if most else 1)

    def item_keys(self, tokens, kind):
        steps, _ = kind
        # an item that fits its window whole has to stand there as it is: other starts tell nothing
        at = np.arange(len(tokens) if int((1 - self.settings.similarity) * len(tokens) + 1e-9) else 1)
        padded = np.concatenate([tokens, np.zeros(steps, np.uint64)])
        turns = self.settings.repeats
        return (np.concatenate([walk(padded, at, steps, self.settings.samples, t) for t in range(turns)]), np.tile(at, turns))

    def text_keys(self, flat, starts, kind, near):
        steps, stride = kind
        lengths = np.diff(starts)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        padded = np.zeros(len(flat) + steps * len(lengths), np.uint64)  # no walk goes on in the next text
        padded[np.arange(len(flat)) + steps * owner] = flat
        places = np.flatnonzero((np.arange(len(flat)) - starts[owner]) % stride == 0)
        for lo in range(0, len(places), 1 << 15):
            part = places[lo:lo + (1 << 15)]
            at = part + steps * owner[part]
            for turn in range(self.settings.repeats):
                keys = walk(padded, at, steps, self.settings.samples, turn)
                hit = np.flatnonzero(near(keys))
                yield keys[hit], part[hit]


class Grams(Block):
    """Candidates by grams that must remain: finds every stretch within the edits, so it measures what others miss."""

    def plan(self, n):
        most, q, least = plan(n, self.settings)
        return most, (q,), least

    def item_keys(self, tokens, kind):
        keys = gram_keys(tokens, kind[0])
        return keys, np.arange(len(keys))

    def text_keys(self, flat, starts, kind, near):
        q = kind[0]
        keys = gram_keys(flat, q)
        at = np.flatnonzero(near(keys))
        at = at[at + q <= starts[np.searchsorted(starts, at, "right")]]
        yield keys[at], at


def verify(text: np.ndarray, item: np.ndarray, places: list[int], most: int) -> tuple[int, int, int] | None:
    """(first word, words, edits) of the stretch nearest to the item around the places where it is
    expected to start, if it is within ``most`` word edits; the first of equals."""
    best, done = None, None
    for place in sorted(set(places)):
        if done is not None and place <= done:
            continue
        done = place + most  # the stretch below covers starts up to here
        lo, hi = max(0, place - most), min(len(text), place + len(item) + 2 * most)
        part = text[lo:hi].tolist()
        end, edits = nearest_end(part, item.tolist())
        if edits <= most and (best is None or edits < best[2]):
            back, _ = nearest_end(part[:end][::-1], item[::-1].tolist(), edits)
            best = lo + end - back, back, edits
    return best


def nearest_end(text: list, item: list, stop_at: int = 0) -> tuple[int, int]:
    """End of the stretch of ``text`` with the fewest edits to ``item``, and the edits.

    Column-wise edit distance with a free start, bit-parallel over the item: bit i of ``up``
    (``down``) tells that row i + 1 is one more (less) than row i.
    """
    masks: dict[int, int] = {}
    for i, x in enumerate(item):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score = full, 0, len(item)
    best, end = score, 0
    for j, x in enumerate(text):
        eq = masks.get(x, 0)
        diagonal = ((((eq | down) & up) + up) ^ up) | eq | down
        more = down | (full & ~(diagonal | up))
        less = up & diagonal
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 & full, less << 1 & full
        up = less | (full & ~(diagonal | more))
        down = more & diagonal
        if score < best:
            best, end = score, j + 1
            if best <= stop_at:
                break
    return end, best


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), search: type[Block] = Walks) -> DataFrame:
    """doc_id, item_id, first_word, n_words, edits: the nearest stretch of each text to each item it
    holds, within the edits that ``settings.similarity`` allows.

    Candidates are the stretches on which enough of the item's walk keys agree at nearly the same place; each is
    verified by its exact edit distance. Copies without edits are always found; with as many edits as are allowed
    the README states the recall by length. ``search=Grams`` finds every such pair: a stretch within the edits
    holds a known number of the item's grams (``plan``). Words are lower-cased runs of ASCII letters and digits and of non-ASCII characters, and
    each character of a script without spaces; items of fewer than five are found by equality. The
    benchmark is the query set: it is taken in blocks of ``block_items`` in id order, and each block
    meets all documents, so what a task holds has a fixed bound. Null and empty texts and items
    match nothing. A repeated item_id is searched once for each of its texts; repeated documents
    give their rows once each.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .filter("text is not null").distinct()
    order = items.orderBy("item_id", "text")
    result, at = None, 0
    while rows := order.offset(at).limit(settings.block_items).collect():
        block = search([(r.item_id, r.text) for r in rows], settings)
        found = _search(docs, block)
        result = found if result is None else result.unionAll(found)
        at += settings.block_items
    return result if result is not None else _search(docs, search([], settings))


def _search(docs: DataFrame, block: Block) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()),
                        ("edits", pa.int64())])
    sent = docs.sparkSession.sparkContext.broadcast(block)  # bounded by block_items

    def work(batches):
        for b in batches:
            ids, all_texts = b.column(0).to_pylist(), b.column(1)
            for lo in range(0, len(ids), 500):
                rows = [(ids[lo + r[0]], *r[1:]) for r in sent.value.search(*words_of(all_texts.slice(lo, 500).to_pylist()))]
                yield batch(schema, *(zip(*rows) if rows else [[]] * 5))

    return texts(docs).mapInArrow(work, "doc_id long, item_id long, first_word long, n_words long, edits long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that hold no item. Rows without doc_id can't be named and stay."""
    found = leaks(docs, benchmark, settings).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
