"""Resampling, spelling variants and token files against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, resample, spelling, tokenfiles
from millrace.llm.ranking import numbered

RNG = random.Random(11)
ODD = [None, "", " ", "a", "\n\n", "Ab cd", "ß é 中", "x1_y2 [Z`{", "naïve Ñandú Ñandu ÿÿÿÿÿÿÿ", "b" * 30_000, "the word " * 20_000]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and extra columns with clashing names."""
    rows = list(enumerate(ODD)) + [(1, ""), (None, "Ab cd"), (None, None), (5, "Ab cd"), (5, "Ab cd ef")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n", "bucket", "word", "form", "rank", "score", "weight", "part", "at", "ids", "key", "side"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_rows_are_numbered_over_ranges(spark):
    rows = [(RNG.randrange(50), i) for i in range(3000)] + [(None, 5000)]
    got = numbered(spark.createDataFrame(rows, "a long, b long").repartition(7), [F.desc_nulls_last("a"), F.asc("b")], "place", 9).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted((r.place, r.a, r.b) for r in got) == [(i, *r) for i, r in enumerate(want, 1)]
    assert numbered(spark.createDataFrame([], "a long"), [F.asc("a")], "place", 3).count() == 0


# ---- resampling --------------------------------------------------------------------

def plain_resample(rows, target, s):
    def feats(text):
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % s.buckets
                            for k in range(1, s.words + 1) for i in range(len(words) - k + 1)]

    def counts(all_texts):
        out = [0] * s.buckets
        for t in all_texts:
            for b in feats(t)[1]:
                out[b] += 1
        return out, sum(out)

    (own, all_own), (goal, all_goal) = counts(t for _, t in rows), counts(target)
    gain = [math.floor(1000 * math.log((t + 1) * (all_own + s.buckets) / ((n + 1) * (all_goal + s.buckets)))) for n, t in zip(own, goal)]
    out, could = [], []
    for i, text in rows:
        n_words, f = feats(text)
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n_words >= s.least:
            could.append(out[-1])
    could.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, r in enumerate(could[:s.percent * len(could) // 100], 1):
        r[4] = place
    return out


def some_rows():
    words = ["".join(RNG.choice("abcdé") for _ in range(RNG.randrange(1, 12))) for _ in range(300)]
    return [(i, RNG.choice([" ", ", ", "\n"]).join(RNG.choice(words) for _ in range(RNG.randrange(60)))) for i in range(400)]


@pytest.mark.parametrize("s", [resample.Settings(), resample.Settings(words=3, buckets=97, percent=35, least=5, characters=500), resample.Settings(percent=100, least=1)])
def test_resampling_equals_the_plain_form(spark, s):
    rows = some_rows()
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # a group of copies
    target = [t for _, t in rows[:40]] + [None, ""]
    goal = spark.createDataFrame([(t,) for t in target], "text string").withColumn("n", F.lit(0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in resample.resample(docs, goal, s).collect())
    assert got == sorted(map(tuple, plain_resample(rows, target, s)))


def test_resampling_of_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    s = resample.Settings(least=1, percent=60)
    got = resample.resample(odd, odd.select("text"), s).collect()
    key = lambda r: (r[0] is None, *[x or 0 for x in r[:4]])
    want = plain_resample(rows, [t for _, t in rows], s)
    assert [tuple(r[:4]) for r in sorted(got, key=key)] == [tuple(r[:4]) for r in sorted(want, key=key)]
    ranked = [r.rank for r in got if r.rank]
    assert sorted(ranked) == list(range(1, 1 + sum(r[4] is not None for r in want)))
    assert all(r.rank is None for r in got if not r.n_features)
    assert resample.resample(odd.limit(0), odd, s).count() == 0
    assert resample.resample(odd, odd.limit(0), s).count() == odd.count()
    assert {r.rank for r in resample.resample(odd, odd).collect()} == {None}  # too few long texts to draw one


def test_crc_matrices_equal_zlib():
    words = [bytes(RNG.randrange(1, 256) for _ in range(n)) for n in range(1, 40) for _ in range(60)] * 2
    raw = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - np.array([len(w) for w in words])
    order = np.random.default_rng(0).permutation(len(words))
    assert resample.feature_crcs(raw, start[order], end[order]).tolist() == [zlib.crc32(words[i]) for i in order]
    assert resample.feature_crcs(raw, start[:0], end[:0]).tolist() == []


# ---- spelling ----------------------------------------------------------------------

def one_edit(a, b):
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a != b and (a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:])


def plain_variants(rows, s):
    n = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % s.drop == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] = n.get(run, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= s.length and k >= s.count}
    around = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if one_edit(a, b):
            around[a].append(b)
            around[b].append(a)
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in around.items() if x}
    form = {w: v for w, v in best.items() if n[v] >= s.ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), k, len(around[w]), n.get(form.get(w))) for w, k in n.items()}


@pytest.mark.parametrize("s", [spelling.Settings(), spelling.Settings(drop=7, shard=20, asked=30, held=50), spelling.Settings(length=1, count=1, ratio=2, drop=3),
                               spelling.Settings(length=7, ratio=2, shard=3)])
def test_variants_equal_the_plain_form(spark, s):
    stems = ["".join(RNG.choice("abcé") for _ in range(RNG.randrange(1, 9))) for _ in range(25)]
    words = stems + ["Aa" + w for w in stems] + ["straße", "STRASSE", "strasse", "ÀÈÌÒÙÝ", "àèìòùý", "aaaaaa", "aaaaaaa", "aaaaaaaa", "aabaaaa", "×÷×÷×÷×"]
    rows = []
    for i in range(200):
        row = []
        for _ in range(40):
            w = RNG.choice(words[:int(RNG.random() ** 2 * len(words)) + 1])
            if RNG.random() < 0.2:
                at = RNG.randrange(len(w) + 1)
                w = w[:at] + RNG.choice(["", "a", "ö", "Z"]) + w[at + RNG.randrange(2):]
            row.append(w)
        rows.append((i, "1 ".join(row)))
    rows += [(i, t) for i, t in enumerate(ODD)] + [(None, rows[0][1]), (0, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs, s).collect()}
    want = plain_variants(rows, s)
    assert len(got) > 20 and got == want
    assert s.length > 1 or any(v[1] not in (w, v[0]) for w, v in want.items())  # chains of several forms


def test_variants_of_odd_and_no_rows(spark, odd):
    s = spelling.Settings(length=2, count=1)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(odd, s).collect()}
    assert got == plain_variants([(r.doc_id, r.text) for r in odd.collect()], s)
    assert spelling.variants(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.Settings(ratio=1)


def test_index_intervals_hold_the_occurrences():
    words = sorted({"".join(RNG.choice("ab") for _ in range(RNG.randrange(1, 9))) for _ in range(80)})
    index = spelling.Ranks([w.encode() for w in words])
    for part in ("a", "ab", "bba", "aaaa"):
        lo, hi = np.array([0]), np.array([index.n])
        for c in reversed(part.encode()):
            lo, hi = index.extend(lo, hi, np.array([c]))
        assert hi[0] - lo[0] == sum(w.startswith(part, i) for w in words for i in range(len(w)))


# ---- token files -------------------------------------------------------------------

def library(rows):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(queries.tokenizer("MILLRACE_WORDS", "word_bpe_49k.json"))
    return [e.ids + [1] for e in model.encode_batch(rows, add_special_tokens=False)]


def test_encoder_equals_the_library():
    letters = " \n\t'<|>endoftextSTLL0123.,-_éÀß×÷ÿµªº\xad\xa0́中Σİ\x1c\x00~!"
    made_up = ["a\x85b", "x<|endoftext|> y", "<|startoftext|>", "ΑΣ Σ", "don't 'S it'LL", "ﬁ １２"]
    made_up += ["".join(RNG.choice(letters) for _ in range(RNG.randrange(40))) for _ in range(3000)]
    path = queries.tokenizer("MILLRACE_WORDS", "word_bpe_49k.json")
    for size in (10, 100_000):
        known = tokenfiles.Encoder(path, size)
        for lo in range(0, len(made_up), 100):
            ids, edges = known.encode(made_up[lo:lo + 100], 1)
            assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == library(made_up[lo:lo + 100])


def test_token_files_round_trip(spark, odd, tmp_path):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()] + [(i, t) for i, t in some_rows() if i > 20]
    RNG.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(6)
    folder, path = str(tmp_path / "ids"), queries.tokenizer("MILLRACE_WORDS", "word_bpe_49k.json")
    tokenfiles.write(docs, folder, path, s=tokenfiles.Settings(file=2000))
    want, start = [], 0
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    for (i, _), ids in zip(rows, library([t for _, t in rows])):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, tokenfiles.digests(spark, folder).collect()), key=lambda r: r[1])
    assert got == want
    held = {r.doc_id: r.ids for r in tokenfiles.documents(spark, folder, [30, 31, 10**9]).collect()}
    assert held == dict(zip((30, 31), library([dict(rows)[30], dict(rows)[31]])))
    plan = tokenfiles.documents(spark, folder, [30, 31])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id, [30,31])]" in plan
    files = [f for f in (tmp_path / "ids").iterdir() if f.suffix == ".orc"]
    assert len(files) > 20
    from pyarrow import orc
    for f in files:  # each file holds one range in order, run-length encoded without a dictionary
        ids = orc.ORCFile(f).read(["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_token_files_have_stripes_and_filters_and_may_be_empty(spark, odd, tmp_path):
    path = queries.tokenizer("MILLRACE_WORDS", "word_bpe_49k.json")
    tokenfiles.write(odd.limit(0), str(tmp_path / "none"), path)
    assert tokenfiles.digests(spark, str(tmp_path / "none")).count() == 0
    words = ["".join(RNG.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    docs = spark.createDataFrame([(2 * i, " ".join(RNG.choice(words) for _ in range(60))) for i in range(20_000)], "doc_id long, text string")
    tokenfiles.write(docs.coalesce(1), str(tmp_path / "ids"), path, s=tokenfiles.Settings(stripe=1 << 16))
    from pyarrow import orc
    files = [orc.ORCFile(f) for f in (tmp_path / "ids").iterdir() if f.suffix == ".orc"]
    assert max(f.nstripes for f in files) >= 1 and sum(f.nrows for f in files) == 20_000
    assert all(f.file_length > f.content_length > 0 and f.row_index_stride == 1000 for f in files)
    read = lambda ids: tokenfiles.documents(spark, str(tmp_path / "ids"), ids)
    assert read([20_000]).count() == 1 and read([20_001]).count() == 0


def test_blocks_of_pieces_are_the_same_in_both_readings():
    import pyarrow as pa
    from millrace.llm import pieces as P

    class Words:
        @staticmethod
        def chunks(text):
            return text.split()

    rows = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a b a", None, "c a", "", "b d e b", "f", "a f"])], names=["doc_id", "text"])
    settings = P.Settings(chunks=3)
    asked = list(P._blocks([rows], Words, "text", None, settings))
    packed = list(P._blocks([rows], Words, "text", ["doc_id"], settings))
    assert [b[:2] for b in asked] == [b[:2] for b in packed] and [b[1] for b in asked] == [["a", "b", "c"], ["b", "d", "e"], ["f", "a"]]
    assert not any(b[2] for b in asked)
    got = [[chunks[i] for i in at] for _, chunks, parts in packed for p in parts for at in P._unpacked(pa.scalar(p)).column(P.AT).to_pylist()]
    assert got == [(t or "").split() for t in rows.column(1).to_pylist()]
