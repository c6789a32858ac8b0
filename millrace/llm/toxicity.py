"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .common import batch, texts

# Second-person pronouns of the corpus languages.
SECOND_PERSON = frozenset(("you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos "
                           "du dich dir dein deine deinen ihr euch euer usted ustedes ti tus vosotros").split())
# Characters that commonly stand for a letter.
LOOKALIKE = str.maketrans("013457@$!|", "oieastasii")
NEAR = 5  # words between a lexicon word and a pronoun

FEATURES = ["lexicon_rate", "lexicon_count", "lexicon_weight", "lexicon_strongest", "lexicon_kinds", "near_second_person", "second_person_rate",
            "hidden_rate", "hidden_lexicon", "capital_rate", "shouted_rate", "exclamation_rate", "punctuation_rate", "symbol_rate",
            "repeat_rate", "log_words"]


@dataclass(frozen=True)
class Settings:
    """sample: most labelled rows that are learned from, chosen by a hash of doc_id. lexicon: most
    words kept, with at least ``min_docs`` toxic documents and a smoothed log-odds of ``min_odds``.
    trees, depth: of the boosting. threshold: score at which a document counts as toxic."""
    sample: int = 24_000
    lexicon: int = 1_000
    min_docs: int = 8
    min_odds: float = 2.5
    trees: int = 16
    depth: int = 3
    threshold: float = 0.7


STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?[]\\^_`{|}~" + "\u00a1\u00ab\u00b7\u00bb\u00bf\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u2022\u2026"
TRIPLE = re.compile(r"([^\W\d_])\1\1")
INNER = re.compile(r"[^\W\d_][\d_@$!|*.\-]+[^\W\d_]")
LONG_NUMBER = re.compile(r"[@/:]|\d{3}")
STEMS = (4, 5, 6)  # letters that words of one stem share; longer words only


def plain(word: str) -> str:
    """A word without the marks around it, in small letters."""
    return word.strip(STRIP).lower()


def unhidden(word: str) -> str:
    """The word that an obfuscated spelling stands for: look-alikes, inner marks and stretched letters undone."""
    word = re.sub(r"[\W_]", "", word.strip(STRIP).lower().translate(LOOKALIKE))
    return re.sub(r"(.)\1{2,}", r"\1", word)


def is_hidden(bare: str) -> bool:
    """Letters with digits or marks between them, or a letter three times in a row."""
    if bare.isalpha():
        return TRIPLE.search(bare) is not None
    return INNER.search(bare) is not None and LONG_NUMBER.search(bare) is None


def forms(bare: str) -> list[str]:
    """What a lexicon can hold of a word: itself and its stems."""
    return [bare, *(bare[:n] + "*" for n in STEMS if len(bare) > n)] if bare else []


class Words(dict):
    """Word as written -> number of its kind in ``kinds``, 0 for an ordinary word. A kind is
    (lexicon weight, second person, hidden, hidden lexicon word, shouted)."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.heads = {f.rstrip("*")[:STEMS[0]] for f in lexicon}
        self.lexicon, self.kinds, self.numbers = lexicon, [(0.0, False, False, False, False)], {}

    def weight(self, bare: str) -> float:
        if bare[:STEMS[0]] not in self.heads:
            return 0.0
        return max((self.lexicon.get(f, 0.0) for f in forms(bare)), default=0.0)

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        bare = plain(word)
        weight, hidden, found = self.weight(bare), is_hidden(bare), False
        if hidden and not weight:
            weight = self.weight(unhidden(word))
            found = weight > 0
        kind = (weight, bare in SECOND_PERSON, hidden, found, word.isupper() and len(bare) > 2)
        number = 0
        if any(kind):
            number = self.numbers.setdefault(kind, len(self.kinds))
            if number == len(self.kinds):
                self.kinds.append(kind)
        self[word] = number
        return number


CAPITAL, LETTER, BANG, PUNCT, SYMBOL = (np.zeros(256, bool) for _ in range(5))
for _c in range(128):
    CAPITAL[_c], LETTER[_c] = chr(_c).isupper(), chr(_c).isalpha()
    BANG[_c], PUNCT[_c], SYMBOL[_c] = chr(_c) in "!?", chr(_c) in ".,;:!?'\"()-", chr(_c) in "#$%&*@^~_|<>+=/\\"


def features(text: str, words: Words) -> list[float]:
    """The dense features of a whole text; all zero for an empty one."""
    split = text.split()
    if not split:
        return [0.0] * len(FEATURES)
    n = len(split)
    numbers = np.fromiter(map(words.__getitem__, split), np.int32, n)
    marked = np.flatnonzero(numbers)
    seen = [words.kinds[k] for k in numbers[marked]]
    hits = [int(i) for i, s in zip(marked, seen) if s[0]]
    persons = np.array([i for i, s in zip(marked, seen) if s[1]])
    weights = [s[0] for s in seen if s[0]]
    near = 0
    if hits and len(persons):
        at = np.array(hits)
        right = np.searchsorted(persons, at)
        gap = np.minimum(np.abs(persons[np.minimum(right, len(persons) - 1)] - at), np.abs(persons[np.maximum(right - 1, 0)] - at))
        near = int((gap <= NEAR).sum())
    raw = np.frombuffer(text.encode(), np.uint8)
    triple = int(((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[2:] > 32)).sum())
    counts = np.bincount(raw, minlength=256)
    letters, size = max(1, counts[LETTER].sum()), counts.sum()
    return [len(hits) / n, math.log1p(len(hits)), sum(weights) / n, max(weights, default=0.0), float(len({plain(split[i]) for i in hits})),
            near / n, len(persons) / n, sum(s[2] for s in seen) / n, float(sum(s[3] for s in seen)), counts[CAPITAL].sum() / letters,
            sum(s[4] for s in seen) / n, counts[BANG].sum() / size, counts[PUNCT].sum() / size, counts[SYMBOL].sum() / size,
            triple / n, math.log1p(n)]


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("f", pa.list_(pa.float64()))])

    def work(batches):
        words = Words(lexicon)
        for b in batches:
            yield batch(schema, b.column(0), [features(t, words) for t in b.column(1).to_pylist()])

    return texts(docs).mapInArrow(work, "doc_id long, f array<double>")


def held_out(doc_id="doc_id"):
    """Whether a row's label must not be learned from; a null id never has one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def learn_lexicon(known: DataFrame, settings: Settings) -> dict[str, float]:
    """Words whose documents are toxic far more often than others, with their log-odds.

    ``known``: doc_id, text, toxic of the sample. Copies count once. Words are counted in tasks and
    summed before the shuffle; at most ``settings.lexicon`` come to the driver.
    """
    def count(batches):
        schema = pa.schema([("word", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])
        for b in batches:
            by = {0: Counter(), 1: Counter()}
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by[toxic].update({f for w in {plain(w) for w in text.split()} for f in forms(w)})
            words = list({*by[0], *by[1]})
            yield batch(schema, words, [by[1][w] for w in words], [by[0][w] for w in words])

    distinct = known.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))
    once = known.join(F.broadcast(distinct.select("doc_id")), "doc_id").select("text", "toxic")  # as many rows as the sample
    sizes = {r.toxic: r.n for r in known.join(F.broadcast(distinct.select("doc_id")), "doc_id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    odds = F.log((F.col("pos") + 0.5) / (sizes.get(1, 0) + 1)) - F.log((F.col("neg") + 0.5) / (sizes.get(0, 0) + 1))
    rows = (once.mapInArrow(count, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .filter(F.col("pos") >= min(settings.min_docs, max(2, sizes.get(1, 0) // 20))).withColumn("odds", odds)
            .filter(F.col("odds") >= settings.min_odds).orderBy(F.desc("odds"), "word").limit(settings.lexicon).collect())
    return {r.word: float(r.odds) for r in rows}


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: object = None
    calibration: object = None
    rate: float = 0.0
    settings: Settings = field(default_factory=Settings)

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score and predicted of every row of ``docs``, in one pass without a shuffle.

        A null text is empty and gets the score of an empty text. The calibrated value is moved by a
        thousandth towards the uncalibrated one, so that equal steps keep the trees' order.
        """
        rows = with_features(docs, self.lexicon)
        if self.trees is None:
            scored = rows.select("doc_id", F.lit(float(self.rate)).alias("score"))
        else:
            raw = _raw(self.trees.transform(rows.withColumn("v", array_to_vector("f"))))
            scored = self.calibration.transform(raw).select("doc_id", (0.999 * F.col("calibrated") + 0.001 * F.col("raw")).alias("score"))
        return scored.withColumn("predicted", (F.col("score") >= self.settings.threshold).cast("int"))


def _raw(df: DataFrame) -> DataFrame:
    return df.withColumn("raw", vector_to_array("probability")[1])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from labelled rows outside the held-out third.

    At most ``settings.sample`` of them, by a hash of doc_id, so a broadcast of their ids has that
    bound and only their texts are shuffled. Contradicting labels of a doc_id count as toxic; of rows
    that repeat a doc_id the text that is first in order is learned from; rows without doc_id or label
    are left out. Four fifths of the sample give the lexicon and grow the trees, the rest calibrates
    them. With labels of one kind only, every score is their rate.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter("doc_id is not null and toxic in (0, 1)").filter(~held_out())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    learned = texts(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0
    learned = stage(learned, "toxic-sample")
    lexicon = learn_lexicon(learned.filter(~calibrates), settings)
    rows = with_features(learned, lexicon).join(F.broadcast(sample), "doc_id").withColumn("v", array_to_vector("f"))
    rows = stage(rows.select("doc_id", "v", F.col("toxic").cast("double").alias("label"),
                             calibrates.alias("calibrates")), "toxic-features")
    kinds = {r.label: (r.n, r.c) for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("calibrates").alias("c")).collect()}
    total = sum(n for n, _ in kinds.values())
    rate = kinds.get(1.0, (0, 0))[0] / total if total else 0.0
    if len(kinds) < 2 or any(n == c for n, c in kinds.values()):
        return Model(lexicon, rate=rate, settings=settings)
    grown = rows.filter("not calibrates").coalesce(8).cache()
    trees = GBTClassifier(featuresCol="v", labelCol="label", maxIter=settings.trees, maxDepth=settings.depth, stepSize=0.3,
                          maxBins=32, minInstancesPerNode=5, seed=1).fit(grown)
    grown.unpersist()
    held = rows.filter("calibrates") if all(c for _, c in kinds.values()) else rows
    raw = _raw(trees.transform(held)).select("raw", "label")
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(raw)
    return Model(lexicon, trees, calibration, rate, settings)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic; rows without doc_id stay."""
    toxic = model.score(docs).filter("predicted = 1").select("doc_id").distinct()
    return docs.join(toxic, "doc_id", "left_anti").select(*docs.columns)
