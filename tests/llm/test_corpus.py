"""Corpus operators against brute force, round trips and held-out labels."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, lm, nearcopies, neighbours, passages, pieces, pii, queries, simhash, toxicity, urlfilter, warc
from millrace.llm.common import components
from millrace.session import stage

RNG = random.Random(5)


def word():
    return "".join(RNG.choice("bcdfgklmnprst") + RNG.choice("aeiou") for _ in range(RNG.randrange(1, 4)))


def prose(n):
    return " ".join(word() for _ in range(n))


ODD = [None, "", " ", "a", "\n\n", "Ab cd", "▁ x", "ß é 中", prose(3000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and extra columns with clashing names."""
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(1, "", "x"), (None, "Ab cd", "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    for name in ("fp", "root", "key", "ids", "h"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_components_are_those_of_a_union_find(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, x) for x in range(201, 230)] + [(300, 301), (301, 300), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(200, 230)} == {200} and got[301] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_passages_find_spliced_and_near_copies_and_leave_clean_texts(spark):
    shared, rows = prose(60), []
    for i in range(3):
        w = prose(100).split()
        rows.append((i, " ".join(w[:40] + [shared] + w[40:])))
    line = prose(80).split()
    rows += [(10, prose(30) + "\n" + " ".join(line)), (11, " ".join(line) + "\n" + prose(20)), (20, prose(300)), (21, None), (22, ""), (23, prose(12))]
    rows += [(23, rows[-1][1])]  # a repeated row, too short to report
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    got = found.collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 10, 11}
    # a piece at a passage's end may be cut alike in two later texts only, and stays in the first of them
    assert {r.doc_id for r in got if r.removed} == {1, 2, 11}
    left = {r.doc_id: r.text for r in passages.without_passages(spark.createDataFrame(rows[:6], "doc_id long, text string"), found).collect()}
    assert left[0] == rows[0][1] and len(left[1].split()) < 135 and left[20] == rows[5][1]


def test_identical_lines_are_found_whatever_stands_around_them(spark):
    rng, rows, shared = random.Random(12), [], {}
    for i in range(200):
        line = prose(rng.choice([20, 30, 60]))
        for side in (0, 1):
            before, behind = (prose(rng.randrange(1, 40)) for _ in range(2))
            rows.append((2 * i + side, f"{before}\n{line}\n{behind}"))
            shared[2 * i + side] = (len(before.split()), len(line.split()))
    cuts = {}
    for k, (i, t) in enumerate(rows):
        text, _, first, n, h, _, _ = passages.cut([t], passages.Settings())
        at, size = shared[i]
        inside = (first >= at) & (first < at + size)
        cuts.setdefault(i // 2, []).append((n[inside].tolist(), h[inside].tolist()))
    assert all(a == b for a, b in cuts.values())
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    assert all(set(range(at, at + size)) <= got.get(i, set()) for i, (at, size) in shared.items())
    assert {r.doc_id for r in found if r.removed} == set(range(1, 400, 2))


def test_passages_leave_no_pieces_of_unrepeated_texts_on_disk(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, prose(300)) for i in range(300)] + [(300, "a b c " * 10), (301, "a b c " * 10)], "doc_id long, text string")
    written = []
    monkeypatch.setattr("millrace.session.shared_dir", lambda s: f"file://{tmp_path}")
    monkeypatch.setattr(passages, "stage", lambda df, label: written.append(stage(df, label)) or written[-1])
    found = passages.repeated_passages(docs)
    assert [(r.doc_id, r.n_words) for r in found.collect() if r.removed] == [(301, 30)]
    left = [p for p in tmp_path.iterdir() if "pieces" in p.name or "band" in p.name]
    assert len(left) == 1 and left[0].name.startswith("clustered")
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < docs.select(F.sum(F.length("text"))).first()[0] / 10
    assert len(written) == 3 and written[2].count() < 30


def test_jaccard_forest_links_what_all_pairs_link():
    sets = []
    for _ in range(40):
        base = [RNG.randrange(1000) for _ in range(20)]
        sets += [base, base[:18] + [RNG.randrange(1000) for _ in range(RNG.randrange(3))]]
    forest = passages.jaccard_forest(0.8)([np.array(s, np.uint32).tobytes() for s in sets])
    plain = simhash.Forest(len(sets))
    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = set(sets[i]), set(sets[j])
        if len(a & b) >= 0.8 * len(a | b):
            plain.join(i, j)
    assert [forest.find(i) for i in range(len(sets))] == [plain.find(i) for i in range(len(sets))]


def test_pseudonyms_keep_format_validity_and_links(spark, odd):
    text = ('Pay 4111 1111 1111 1111 not 4111111111111112, DE89 3704 0044 0532 0130 00, 2024-02-29 not 2023-02-29, 1.2.3.4, '
            'ssn 123-45-6789, call +1 (017) 555-7713, a.b@mail7.example.com, token = "4d44c79e8b0b3c6a"')
    new, found = pii.Masker(b"k").mask(text)
    assert found == {"card": 1, "iban": 1, "date": 1, "ipv4": 1, "ssn": 1, "phone": 1, "email": 1, "secret": 1}
    assert len(new.split()) == len(text.split()) and "4111111111111112" in new and "2023-02-29" in new
    for value in ("4111 1111 1111 1111", "DE89", "2024-02-29", "1.2.3.4", "123-45-6789", "555-7713", "a.b@", "4d44c79e8b0b3c6a"):
        assert value not in new
    again, second = pii.Masker(b"k").mask(new)
    assert second == found and again != new
    assert pii.Masker(b"other").mask(text)[0] != new
    cipher = pii.Cipher(b"x")
    assert all(sorted(cipher.permute(i, n, "l") for i in range(n)) == list(range(n)) for n in (1, 2, 3, 10, 97, 500))
    assert pii.pseudonyms(odd, b"k").count() == odd.count()
    kept = {r.doc_id: r.text for r in pii.pseudonyms(odd, b"k").filter("doc_id > 1").collect()}
    assert kept[8] == ODD[8]


def test_pseudonyms_of_values_next_to_characters_of_their_class():
    masker = pii.Masker(b"k")
    for kind, value, behind in (
            ("card", "4111 1111 1111 1111", (" 12/27", " 123", " 2024-02-29", "-12", " A")),
            ("iban", "DE89 3704 0044 0532 0130 00", (" BIC COBADEFF", " I paid", " 2024-02-29", " 17", " EUR 4")),
            ("phone", "+1 (017) 555-7713", (" 2024-02-29", " 24 times", " 12 34", ".")),
            ("phone", "+49 30 901820", (" 2024-02-29 12", " x"))):
        alone, found = masker.mask(value)
        assert found == {kind: 1} and alone != value
        for more in behind:
            new, found = masker.mask(f"see {value}{more}")
            assert found[kind] == 1 and new.startswith(f"see {alone}") and found.get("date", 0) == more.startswith(" 2024-"), (value, more, new)
    assert masker.mask("4111 1111 1111 1112 12/27")[1] == {} and masker.mask("DE89 3704 0044 0532 0130 01 BIC")[1].get("iban") is None


def test_secrets_of_any_length_are_changed_throughout():
    masker, rng = pii.Masker(b"k"), random.Random(8)
    for n in (8, 31, 128, 300, 1000, 4400, 20_000):
        for letters, name in (("0123456789abcdef", "hex"), ("abcXYZ0123456789", "mixed")):
            value = "".join(rng.choice(letters) for _ in range(n - 1)) + "7"
            new, found = masker.mask("token=" + value)
            assert found == {"secret": 1} and len(new) == n + 6
            same = [a == b for a, b in zip(value, new[6:])]
            parts = [same[i:i + 100] for i in range(0, n, 100)]
            assert all(sum(p) <= 8 + len(p) / 5 for p in parts), (n, name)


def test_character_permutations_are_one_to_one():
    cipher = pii.Cipher(b"x")
    for sets in ("0", "0a", "A0a", "a-0.0", "0000"):
        classes = {"0": pii.DIGITS, "a": pii.LOWER, "A": pii.UPPER}
        texts = ["".join(t) for t in itertools.product(*(classes.get(c, c) for c in sets))]
        assert sorted(cipher.characters(t, "l") for t in texts) == sorted(texts)
    assert cipher.characters("", "l") == "" and cipher.characters("é-", "l") == "é-"


def test_spellings_of_a_phone_number_are_linked():
    masker = pii.Masker(b"k")
    for spellings in (["+1 555 123 4567", "+1-555-123-4567", "+15551234567", "+1 (555) 123-4567"], ["+442071234567", "+44 20 7123 4567"],
                      ["+351 912 345 678", "+351912345678"]):
        digits = {"".join(filter(str.isdigit, masker.mask(t)[0])) for t in spellings}
        assert len(digits) == 1 and digits != {"".join(filter(str.isdigit, spellings[0]))}
    assert [pii.calling_code(d) for d in ("15551234567", "442071234567", "351912345678", "7")] == ["1", "44", "351", "7"]


def test_masking_takes_linear_time_and_overlapping_candidates():
    import time
    masker, begun = pii.Masker(b"k"), time.time()
    for text in ("a." * 1_000_000 + " 1", "token=" * 300_000 + " 1", "1.2.3.4." * 50_000, "a@" * 300_000 + "1", "x.y@a." * 100_000 + "1"):
        assert masker.mask(text) == (text, {})
    assert time.time() - begun < 30
    new, found = masker.mask("token=password: 'abc12345', token=xx-token='abc12345' token=abcdefgh@x.com")
    assert found == {"secret": 2, "email": 1} and "abc12345" not in new and "@x.com" not in new


def test_url_intervals_and_longest_active_key(spark):
    at = lambda d: f"2024-01-{d:02} 00:00:00"
    entries = spark.createDataFrame([
        ("a.com", "block", "add", at(2)), ("a.com", "block", "add", at(3)), ("A.com", "block", "remove", at(5)), ("x.a.com", "allow", "add", at(4)),
        ("b.com", "block", "add", at(1)), ("b.com", "allow", "add", at(1)), ("c.com", "block", "remove", at(1)), (None, "block", "add", at(1))],
        "key string, verdict string, action string, at string").withColumn("at", F.to_timestamp("at"))
    caps = spark.createDataFrame([
        (1, "http://a.com/", at(1)), (2, "http://u@y.a.com:80/p?q", at(2)), (3, "https://x.A.com", at(4)), (4, "http://a.com", at(5)),
        (5, "http://b.com.", at(9)), (6, "no url", at(2)), (7, None, at(2)), (8, "http://a.com", None), (2, "http://u@y.a.com:80/p?q", at(2))],
        "page_id long, url string, t string").select("page_id", "url", F.to_timestamp("t").alias("fetched_at"), F.lit("z").alias("key"))
    got = sorted((r.page_id, r.decision, r.matched_key) for r in urlfilter.judged(caps, entries).collect())
    assert got == sorted([(1, "allow", None), (2, "block", "a.com"), (2, "block", "a.com"), (3, "allow", "x.a.com"), (4, "allow", None),
                          (5, "allow", "b.com"), (6, "allow", None), (7, "allow", None), (8, "allow", None)], key=lambda r: (r[0], r[1], r[2] or ""))


def test_pieces_equal_the_library(spark, odd):
    import sentencepiece
    path = queries.tokenizer()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = pieces.Pieces(path)
    letters = " \n\t▁aéß中　\xa0\x00😀<0x0A></s>\r.the​"
    made_up = ["".join(RNG.choice(letters) for _ in range(RNG.randrange(30))) for _ in range(300)]
    for text in made_up:
        ids = plain.segment(plain.chunks(text))
        assert sum(ids, []) == model.encode(text) and "".join(plain.decode(ids))[1:] == model.decode(sum(ids, []))
    # blocks that end at any row, and the table joined back by position
    table = spark.createDataFrame(list(enumerate(made_up)), "doc_id long, text string").repartition(3)
    for bounds in (pieces.Settings(), pieces.Settings(chunks=40), pieces.Settings(characters=1), pieces.Settings(rows=7)):
        got = {r.doc_id: (r.ids, r.decoded) for r in pieces.encode(table, path, bounds).collect()}
        assert got == {i: (model.encode(t) + [2], model.decode(model.encode(t))) for i, t in enumerate(made_up)}
    import hashlib
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in pieces.digests(table, path, pieces.Settings(chunks=40)).collect():
        ids = model.encode(made_up[r.doc_id]) + [2]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))
    assert pieces.digests(odd.limit(0), path).count() == 0
    same = spark.createDataFrame([("", 1)] * 50 + [("a b", 2)] * 50, "text string, ids int")  # repeated rows, text first
    assert sorted((r.text, r.n_tokens) for r in pieces.with_ids(same, path, pieces.Settings(rows=5)).collect()) == [("", 1)] * 50 + [("a b", 3)] * 50
    rows = {r.doc_id: r for r in pieces.encode(odd, path).filter("doc_id > 1").collect()}
    assert all(rows[i].ids == model.encode(ODD[i]) + [2] and rows[i].decoded == model.decode(rows[i].ids) for i in range(2, len(ODD)))
    assert pieces.digests(odd, path).filter("n_tokens = 1").count() == 4 and pieces.with_ids(odd, path).count() == odd.count()


def edit_distance(a, b):
    row = [0] * (len(b) + 1)  # free start
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def test_verification_is_the_edit_distance_and_search_reaches_its_recall(spark, odd):
    for _ in range(100):
        item, text = [RNG.randrange(4) for _ in range(RNG.randrange(1, 9))], [RNG.randrange(4) for _ in range(RNG.randrange(0, 15))]
        assert decontaminate.nearest_end(text, item, -1)[1] == edit_distance(item, text)
    items = [(i, prose(RNG.randrange(15, 60))) for i in range(40)] + [(40, None), (41, ""), (42, "the")]
    block = decontaminate.Grams(items, decontaminate.Settings())
    for rate, least in ((0, 1), (0.1, 0.96), (0.2, 0.9)):
        hits = 0
        for k in range(200):
            item_id, text = items[k % 40]
            w = text.split()
            for _ in range(int(rate * len(w))):
                at = RNG.randrange(len(w))
                w[at:at + RNG.randrange(2)] = ["zzz"] * RNG.randrange(2)
            around = prose(100).split()
            found = block.search(*decontaminate.hashed([" ".join(around[:k % 90] + w + around[k % 90:])]))
            hits += any(f[1] == item_id for f in found)
        assert hits >= least * 200
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.leaks(odd, bench).count() == 0
    docs = spark.createDataFrame([(1, "Xx " + items[0][1].upper() + " yy"), (2, prose(200)), (None, items[1][1])], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(docs, bench).orderBy("item_id").collect()] == [(1, 0, 0), (None, 1, 0)]
    assert sorted(r.doc_id or 0 for r in decontaminate.drop_leaks(docs, bench).collect()) == [0, 2]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def edited(words, edits, kinds="sid"):
    out = list(words)
    for at in sorted(RNG.sample(range(len(words)), edits), reverse=True):
        kind = RNG.choice(kinds)
        out[at:at + (kind != "i")] = [] if kind == "d" else ["zzz"]
    return out


def test_leaks_are_found_at_every_length_and_accepted_edit_rate():
    lengths = [*range(5, 62), 81, 122, 150, 243, 365, 400, 500]
    items = [(n, prose(4 * n).split()[:n]) for n in lengths]
    block = decontaminate.Grams([(n, " ".join(w)) for n, w in items], decontaminate.Settings())
    small = decontaminate.Grams([(n, " ".join(w)) for n, w in items], decontaminate.Settings(block_hits=3))
    for kinds in ("s", "sid"):
        for rate in (0, 0.1, 0.2):
            around = prose(60).split()
            texts = [" ".join(around[:n % 50] + edited(w, int(rate * n + 1e-9), kinds) + around[n % 50:]) for n, w in items]
            found = block.search(*decontaminate.hashed(texts))
            assert {f[1] for f in found if lengths[f[0]] == f[1]} == set(lengths)
            assert all(f[4] <= int(f[1] * 0.2 + 1e-9) for f in found) and small.search(*decontaminate.hashed(texts)) == found


def test_walks_reach_their_recall_at_every_length():
    lengths = [*range(5, 62), 81, 122, 150, 243, 365, 400, 500]
    items = [(n, prose(4 * n).split()[:n]) for n in lengths]
    known = [(n, " ".join(w)) for n, w in items]
    block, yard = decontaminate.Walks(known, decontaminate.Settings()), decontaminate.Grams(known, decontaminate.Settings())
    for kinds, rate in (("s", 0), ("s", 0.1), ("s", 0.2), ("sid", 0.2), ("d", 0.2), ("i", 0.2)):
        hits = 0
        for _ in range(6):
            around = prose(60).split()
            texts = [" ".join(around[:n % 50] + edited(w, int(rate * n + 1e-9), kinds) + around[n % 50:]) for n, w in items]
            found, every = (set(b.search(*decontaminate.hashed(texts))) for b in (block, yard))
            assert found <= every
            hits += len({f[1] for f in found if lengths[f[0]] == f[1]})
        assert hits >= (1 if rate == 0 else 0.98) * 6 * len(lengths)


def test_walks_find_evenly_edited_items_whatever_stands_beside_them():
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in range(5, 80)]
    block = decontaminate.Walks(items, decontaminate.Settings())
    texts = [" ".join("zz" if i % 5 == 2 and i // 5 < n // 5 else w for i, w in enumerate(t.split())) for n, t in items]
    found = block.search(*decontaminate.hashed(texts))
    assert len(found) >= 0.98 * len(items)
    alone = [(i, *f[1:]) for i, t in enumerate(texts) for f in block.search(*decontaminate.hashed([t]))]
    assert alone == found
    assert block.search(*decontaminate.hashed([])) == [] and block.search(*decontaminate.hashed(["", "of"])) == []


def test_leaks_of_short_items_and_of_scripts_without_spaces():
    items = [(1, "zo"), (2, "zo Za"), (3, "zu za zi ze"), (4, "床前明月光疑是地上霜"), (5, "月光")]
    block = decontaminate.Grams(items, decontaminate.Settings())
    walks = decontaminate.Walks(items, decontaminate.Settings())
    found = lambda t: {(f[1], f[2], f[3], f[4]) for b in (block, walks) for f in b.search(*decontaminate.words_of([t]))}
    assert found("x ZO za y") == {(1, 1, 1, 0), (2, 1, 2, 0)} and found("zozo zu za zi") == set()
    assert found("a zu za zi ze, b") == {(3, 1, 4, 0)}
    assert found("李白：床前明月光疑是地上霜，举头") == {(4, 3, 10, 0), (5, 6, 2, 0)} and {f[0] for f in found("床前明日光疑是山上霜")} == {4}


def test_toxicity_on_held_out_labels(spark, odd):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels, toxicity.Settings(trees=8))
    rows = model.score(docs).join(labels, "doc_id").filter(toxicity.held_out()).select("score", "toxic").collect()
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.8
    scored = model.score(odd).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    empty = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in empty.score(odd).collect()} == {0.0}


def test_warc_round_trip_by_seek_table(spark, tmp_path):
    pages = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", prose(5000)), (4, "u", ""),
             (None, "u", "<p>é</p>"), (None, None, "alone")]
    index = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha1", F.lit(1)), str(tmp_path / "w"), frame_bytes=600)
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.read(index).collect())
    assert got == [(0, 5, "response", 0), (0, 9, "revisit", 2), (1, 9, "revisit", 2), (2, 9, "response", 0), (3, 0, "revisit", 4),
                   (4, 0, "response", 0), (4, 0, "response", 0), (5, len(pages[4][2]), "response", 0)]
    path = index.first().path
    import zstandard
    reader = warc.BundleReader(path)
    whole = b"".join(reader.frame(i) for i in range(len(reader.frames)))
    with open(path, "rb") as file:  # the bundle is an ordinary multi-frame file as well
        assert zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read() == whole


def plain_fingerprint(text):
    import re
    import xxhash
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, odd):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(20 + i, prose(40)) for i in range(20)]
    base = prose(400).split()
    rows += [(100 + i, " ".join(base[:i * 7] + ["new"] + base[i * 7:])) for i in range(30)]
    got = {r.doc_id: (r.fp & simhash.MASK, r.component_id) for r in
           simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [plain_fingerprint(t) for _, t in rows]
    forest = simhash.Forest(len(rows))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            forest.join(i, j)
    assert got == {rows[i][0]: (prints[i], rows[forest.find(i)][0]) for i in range(len(rows))}
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.keep_one(odd).filter("doc_id is null").count() == 2
    values = [RNG.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.within(q, 2)) == [i for i, v in enumerate(values) if (q ^ v).bit_count() <= 2]


def five_word_jaccard(a, b):
    a, b = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_are_dropped_from_jaccard_0_8_on(spark):
    rows, alike = [], set()
    for i in range(150):
        base = prose(200).split()
        copy = list(base)
        for at in RNG.sample(range(200), 1 + i % 8):
            copy[at] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        if five_word_jaccard(base, copy) >= 0.8:
            alike.add(2 * i + 1)
    rows += [(1000, prose(3)), (1001, None), (1002, ""), (None, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in nearcopies.keep_one(docs).collect()}
    assert 40 < len(alike) < 130 and left == {i for i, _ in rows} - alike - {1002}


def test_near_dedup_stage_keeps_one_of_each_group_of_fingerprints(spark):
    import corpus_pipeline
    base = prose(300).split()
    rows = [(i, prose(60)) for i in range(40)] + [(100 + i, rows_text) for i, rows_text in enumerate([" ".join(base)] * 5)]
    rows += [(200 + i, " ".join(base[:i * 9] + ["new"] + base[i * 9:])) for i in range(20)] + [(300, None), (301, ""), (None, " ".join(base))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(r.doc_id if r.doc_id is not None else -1 for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    prints = [plain_fingerprint(t) for _, t in rows]
    forest = simhash.Forest(len(rows))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            forest.join(i, j)
    assert left == sorted([-1, *(i for k, (i, _) in enumerate(rows) if forest.find(k) == k and i is not None)])


def test_neighbours_recall_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    x[300:500] = x[299]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("code", F.lit(0))
    got = neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect()
    hit = 0
    for q in range(0, 600, 50):
        score = x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
        score[q] = -9
        best = np.lexsort((np.arange(600), -score.round(12)))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(s - score[v]) < 1e-12 for _, v, s in mine)
        hit += len({m[1] for m in mine} & set(best.tolist()))
    assert hit >= 0.9 * 60
    few = neighbours.nearest(table.filter("vec_id in (0, 7, 8)"), F.col("vec_id") == 0).collect()
    assert len(few) == 2 and neighbours.nearest(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_cross_entropy_difference_equals_plain_models(spark, odd):
    texts = [(i, " ".join(RNG.choice("abcde") for _ in range(30))) for i in range(20)] + [(20, None), (21, "")]
    target = {0, 1, 2, 3}
    got = {r.doc_id: r.score for r in lm.cross_entropy_difference(
        spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()}

    def model(ids):
        uni, bi = {}, {}
        for i in ids:
            w = ["<s>"] + (texts[i][1] or "").split()
            for a, b in zip(w, w[1:]):
                uni[b] = uni.get(b, 0) + 1
                bi[a, b] = bi.get((a, b), 0) + 1
        return uni, bi

    (ub, bb), (ut, bt) = model(range(22)), model(target)
    scale, size, prior = sum(ut.values()) / sum(ub.values()), 7, 50.0

    def p(uni, bi, s, a, b):
        spread = (uni.get(b, 0) * s + 1 / size) / (sum(uni.values()) * s + 1)
        mass = sum(n for (x, _), n in bi.items() if x == a) * s
        return (bi.get((a, b), 0) * s + prior * spread) / (mass + prior)

    for i, text in texts:
        w = ["<s>"] + (text or "").split()
        loss = [np.log(p(ub, bb, scale, a, b)) - np.log(p(ut, bt, 1, a, b)) for a, b in zip(w, w[1:])]
        assert abs(got[i] - (np.mean(loss) if loss else 0)) < 1e-5
    assert lm.cross_entropy_difference(odd, odd.select("doc_id").limit(0)).count() == odd.count()


def plain_differences(rows, target, prior=50.0):
    import collections
    import re
    split = {i: re.findall(r"[^ \t\n\r\x0b\x0c]+", (t or "").lower()) for i, t in rows}
    models = []
    for ids in (set(split), target & set(split)):
        uni, bi, mass = collections.Counter(), collections.Counter(), collections.Counter()
        for i in ids:
            uni.update(split[i])
            bi.update(zip([None, *split[i]], split[i]))
            mass.update([None, *split[i]][:len(split[i])])
        models.append((uni, bi, mass, sum(uni.values())))
    size, goal = len(models[0][0]) + 2, models[1][3]
    out = {}
    for i, words in split.items():
        loss = 0.0
        for c, w in zip([None, *words], words):
            p = []
            for uni, bi, mass, total in models:
                scale = goal / total if total else 1.0
                p.append((bi[c, w] * scale + prior * (uni[w] * scale + 1 / size) / (total * scale + 1)) / (mass[c] * scale + prior))
            loss += np.log(p[0]) - np.log(p[1])
        out[i] = (len(words), loss / max(1, len(words)))
    return out


def test_cross_entropy_of_whole_tables_keeps_every_word(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1").select("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_differences(rows, {r.doc_id for r in good.collect()})
    for s in (lm.Settings(), lm.Settings(block=20_000, bucket=50_000)):
        got = {r.doc_id: (r.n_words, r.score) for r in lm.cross_entropy_difference(docs, good, s).collect()}
        assert got.keys() == want.keys() and all(got[i][0] == n and abs(got[i][1] - x) < 1e-9 for i, (n, x) in want.items())
    assert lm.cross_entropy_difference(docs.limit(0), good).count() == 0


def test_cross_entropy_of_repeated_rows_and_one_common_word(spark):
    rows = [(i, "zo " * 300) for i in range(60)] + [(100 + i, prose(50)) for i in range(60)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").withColumn("word", F.lit("clash")).coalesce(1)
    got = [(r.doc_id, r.score) for r in lm.cross_entropy_difference(docs, docs.filter("doc_id < 130").select("doc_id"), lm.Settings(block=400)).collect()]
    want = plain_differences([(k, t) for k, (_, t) in enumerate(rows + rows[:3])], {k for k, (i, _) in enumerate(rows + rows[:3]) if i < 130})
    assert sorted(got) == sorted(((rows + rows[:3])[k][0], pytest.approx(x, abs=1e-9)) for k, (_, x) in want.items())


def test_pipeline_stages_keep_what_they_should(spark, tmp_path):
    import corpus_pipeline
    docs = corpus_pipeline.table(spark, "/root/testdata/sf0.01", "documents")
    before = docs.count()
    for name, function in corpus_pipeline.STAGES:
        function(spark, docs, "/root/testdata/sf0.01").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0.5 * before < docs.count() <= before
        before = docs.count()
    assert set(corpus_pipeline.COLUMNS) < set(docs.columns) and docs.select("doc_id").distinct().count() == before
