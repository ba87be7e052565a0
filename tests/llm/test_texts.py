"""Operators on texts against brute force: sketches, licences, secrets, token files, repeated strings."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from orderlight.llm import fingerprints, licenses, pfor, secrets, suffixes


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def low(i):
    return -(2**70) if i is None else i


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


# --- sketches


def plain_shingles(text):
    words = text.encode().lower().split()
    runs = [words[k : k + 5] for k in range(max(1, len(words) - 4))] if words else []
    return {xxhash.xxh64_intdigest(b" ".join(run), 7) for run in runs}


def plain_sketch(text):
    every = sorted(plain_shingles(text))
    return [h for h in every if h < 2**64 // 8] or every[:1]


def plain_containment(a, b):
    """By the sketches; by all shingles if one of the sketches has its only hash above the threshold."""
    one, two = set(plain_sketch(a)), set(plain_sketch(b))
    if any(len(s) == 1 and min(s) >= 2**64 // 8 for s in (one, two)):
        one, two = plain_shingles(a), plain_shingles(b)
    return len(one & two) / min(len(one), len(two)) if one and two else float(len(one) == len(two))


@pytest.mark.parametrize("table", ["edge", "small"])
def test_edit_likeness_follows_the_order_of_ids(table, request):
    docs = request.getfixturevalue(table)
    got = by_id(fingerprints.edit_likeness(docs, part_mb=0.05))
    rows = sorted(rows_of(docs), key=lambda r: -low(r[0]))
    assert sum(map(len, got.values())) == len(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 3
        changed = text[: len(text) - cut] + after[:cut]
        own = plain_sketch(text)
        for r in got[i]:
            assert r.n_chars == len(text) and bytes(r.fingerprint) == b"".join(h.to_bytes(8, "big") for h in own)
        match = [r for r in got[i] if r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()]
        assert match
        assert match[0].near_next == plain_containment(text, after)
        assert match[0].near_edited == plain_containment(text, changed)


def test_sketch_estimates_containment_and_merges():
    rng = np.random.default_rng(1)
    words = [b"w%d" % i for i in rng.integers(0, 10**9, 40_000)]
    whole, part = b" ".join(words), b" ".join(words[5000:9000])
    a, b = fingerprints.sketch(whole), fingerprints.sketch(part)
    assert fingerprints.containment(a, b) > 0.99 and abs(fingerprints.jaccard(a, b) - 0.1) < 0.02
    halves = [fingerprints.sketch(b" ".join(words[:20_004])), fingerprints.sketch(b" ".join(words[20_000:]))]
    assert (fingerprints.merged(halves) == a).all()
    assert fingerprints.containment(fingerprints.sketch(b""), fingerprints.sketch(b" ")) == 1
    assert fingerprints.containment(fingerprints.sketch(b""), a) == 0


def test_short_texts_inside_long_ones_are_contained():
    rng = np.random.default_rng(3)
    thin = 0
    for _ in range(300):
        words = [b"w%d" % i for i in rng.integers(0, 10**9, 512)]
        at = int(rng.integers(0, 500))
        long, short = b" ".join(words), b" ".join(words[at : at + 12])
        own, other = fingerprints.sketch(short), fingerprints.sketch(long)
        thin += fingerprints.thin(own)
        assert fingerprints.likeness(short, long, own, other)[0] == 1 == fingerprints.likeness(long, short, other, own)[0]
    assert thin > 50


def test_edit_likeness_of_small_tables(spark, none):
    assert fingerprints.edit_likeness(none).count() == 0
    one = fingerprints.edit_likeness(spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


# --- licences


@pytest.mark.parametrize("table", ["edge", "small"])
def test_licenses_base(table, request):
    docs = request.getfixturevalue(table)
    got = by_id(licenses.scan(docs))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, text in rows_of(docs):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = word.findall(lowered)
        places = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        r = [r for r in got[i] if r.n_words == len(words)][0]
        assert r.n_base == len(places)
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_licenses_find_notices_with_their_key_phrases(spark, none):
    texts = [
        "x y licensed under the GNU General Public License, version 3. z",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Licensed under the Apache License, Version 2.0",
        "the general public may license under the version of the software and use it in the source",
        "permission to use, copy, modify and/or distribute this software for any purpose with or without a fee",
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(5)] == ["gpl-3", "bsd-3", "apache-2", "", ""]
    assert got[3].score == 0 and got[0].score == 1
    assert licenses.scan(none).count() == 0


def labels_at_every_start(index, words):
    found = set()
    for label, notice, keys, base in index.notices:
        weight = sum(index.idf[w] for w in notice)
        for start in range(-len(notice), len(words)):
            here = sum(index.idf[w] for i, w in enumerate(notice) if 0 <= start + i < len(words) and words[start + i] == w)
            window = b" %s " % b" ".join(words[max(0, start) : start + len(notice) + 2])
            if not base and here / weight >= licenses.ENOUGH and all(b" %s " % b" ".join(key) in window for key in keys):
                found.add(label)
    return found


@pytest.mark.parametrize("documents", [0, 1000])
def test_licenses_find_all_notices_of_a_text(documents):
    import itertools
    import random

    rng = random.Random(4)
    vocabulary = sorted({w for _, t, _ in licenses.NOTICES for w in t.encode().split()})
    index = licenses.Index({w: rng.randint(0, documents) for w in vocabulary}, documents)
    every = [(label, t.encode().split()) for label, t, _ in licenses.NOTICES]
    groups = [*itertools.combinations(every, 2), *rng.sample([*itertools.combinations(every, 3)], 60), *(rng.sample(every, n) for n in range(4, len(every) + 1))]
    for group in groups:
        words = [w for _, notice in group for w in notice]
        labels = index.find(words)[1]
        assert {label for label, _ in group} <= labels and labels == labels_at_every_start(index, words)
        edited = [w if rng.random() < 0.9 else b"other" for w in words]
        assert index.find(edited)[1] == labels_at_every_start(index, edited)


# --- secrets


def base_of(text):
    out = []
    kinds = (
        (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 8),
        (r"AKIA[A-Z0-9]+", lambda m: len(m.group(0)) >= 16),
        (r"[0-9a-f]+", lambda m: len(m.group(0)) >= 32),
    )
    for k, (pattern, good) in enumerate(kinds):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, re.ASCII) if good(m)]
    return sorted(out)


@pytest.mark.parametrize("table", ["edge", "small"])
def test_secrets_base(table, request):
    docs = request.getfixturevalue(table)
    got = secrets.scan(docs.select("doc_id", "text")).collect()
    assert len(got) == docs.count()
    for r in got:
        text = r.text or ""
        base = base_of(text)
        assert [(s.start, s["rank"], s.end) for s in r.spans if s["rank"] < 3] == base
        assert all(s.hit == text[s.start : s.end] for s in r.spans)
        assert [s.start for s in r.spans] == sorted(s.start for s in r.spans)


def test_secrets_models_and_redaction(spark, none, small):
    from pyspark.sql import functions as F

    ratios = secrets.train(small)
    texts = ["key q7Zk29xPw4LmT8vB3nRy6Hd1 here", "a_perfectly_ordinary_identifier and theretherethetherethe there", "password=abcdefgh99 x password=abcdefgh99", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = secrets.scan(docs, ratios, out="found").withColumn("clean", secrets.redacted(F.col("text"), F.col("found"))).orderBy("doc_id").collect()
    assert [s["rank"] for s in got[0].found] == [3] and got[0].clean == "key [SECRET] here"
    assert got[1].found == [] and got[1].clean == texts[1]
    assert got[2].clean == "[SECRET] x [SECRET]" and got[3].found == [] and got[3].clean is None
    assert secrets.scan(none).count() == 0
    assert secrets.train(none)


def test_secrets_of_long_tokens_and_many_matches(spark):
    """The walks are linear: a token of a million characters, and more matches than a lot holds."""
    import random
    import time

    rng = random.Random(5)
    token = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP0123456789+/") for _ in range(1_000_000))
    many = " ".join(f"token=ab{k:08d}" for k in range(3000))
    docs = spark.createDataFrame([(1, token), (2, many)], "doc_id long, text string")
    ratios = secrets.train(docs)
    began = time.time()
    got = {r.doc_id: r.spans for r in secrets.scan(docs, ratios).collect()}
    assert time.time() - began < 60
    assert [(s.start, s["rank"], s.end) for s in got[2] if s["rank"] < 3] == base_of(many)
    assert all(s.hit == many[s.start : s.end] for s in got[2]) and len(got[1]) <= 1


def test_likelihood_equals_a_plain_walk(spark, small):
    from pyspark.sql import functions as F

    ratios = secrets.train(small)
    grid = [float(x) for x in ratios.split(",")]
    tokens = ["q7Zk29xPw4LmT8vB3nRy6Hd1", "a_perfectly_ordinary_identifier", "ab", "x" * 5000]
    for r in spark.createDataFrame([(t,) for t in tokens], "t string").withColumn("v", secrets.likelihood(F.col("t"), ratios)).collect():
        plain = sum(grid[ord(a) * 128 + ord(b)] for a, b in zip(r.t, r.t[1:])) / (len(r.t) - 1)
        assert abs(r.v - plain) < 1e-9


def test_secrets_stay_off_python(spark, small):
    plan = secrets.scan(small, ",".join(["0"] * 128 * 128))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


# --- token files


def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


@pytest.mark.parametrize("table", ["edge", "small"])
def test_tokens_round_trip(table, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(table)
    got = pfor.encode_documents(docs, vocabulary()).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(vocabulary())
    want = {}
    for i, text in rows_of(docs):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [low(r.doc_id) for r in got] == sorted(low(i) for i, _ in rows_of(docs))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "large"])
def test_any_vocabulary_gives_the_ids_of_the_library(name, edge, small, tmp_path):
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json" if name == "large" else name)
    if name == "large":  # more ids than 16 bits hold, and a limit of the file that must not cut texts
        tokenizer = Tokenizer.from_file(path)
        tokenizer.add_tokens([f"plain{i}" for i in range(20_000)])
        tokenizer.enable_truncation(4)
        path = str(tmp_path / "large.json")
        tokenizer.save(path)
    plain = Tokenizer.from_file(path)
    plain.no_truncation()
    encoder = pfor.Encoder(path)
    texts = [t for _, t in rows_of(edge)] + [t for _, t in rows_of(small)][:200] + ["a plain19999 word", "Two  spaces and a\nline."]
    for text in texts:
        assert np.frombuffer(encoder.ids(text), encoder.kind).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert (encoder.words is not None) == (name == "word_bpe_49k.json") and (encoder.kind == "<u4") == (name == "large")


def test_parts_found_in_arrays_are_those_of_the_pattern():
    import random

    import regex

    rng, kinds, pieces = random.Random(7), pfor._kinds(), regex.compile(pfor.PIECES)
    letters = [chr(c) for c in range(33, 0x250) if chr(c).isprintable() and c != 0x130]
    for _ in range(2000):
        text = " ".join("".join(rng.choice(letters if rng.random() < 0.3 else "'stmdrelv1.-'") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))).lower()
        parts, word = pfor.split_parts(text, kinds)
        assert list(zip(word.tolist(), parts.to_pylist())) == [(i, p) for i, w in enumerate(text.split(" ")) for p in pieces.findall(w)]
    assert "".join(letters).lower() < chr(pfor.KNOWN)


def test_batches_of_texts_look_each_word_up_once(edge, small):
    from tokenizers import Tokenizer

    encoder, plain, asked = pfor.Encoder(vocabulary()), Tokenizer.from_file(vocabulary()), []
    words = encoder.words
    encoder.words = lambda known: asked.extend(known.to_pylist()) or words(known)
    texts = [t for _, t in rows_of(edge)] + [t for _, t in rows_of(small)][:300]
    texts += ["", " ", "\x1c", "a\x1fb c", "x\u2003y\u00a0z\x85", "\u0130I \u00adsoft", "Ⱥ ſ", *map(chr, range(0x20, 0x250))]
    lots = list(pfor._lots(pa.record_batch({"text": pa.array(texts[a : a + 50])}) for a in range(0, len(texts), 50)))
    assert len(lots) == 1 and len(list(pfor._lots(iter(lots * 3), size=1))) == 3
    for end in (None, 1):
        asked.clear()
        ids, sizes = encoder.batch(lots[0].column(0), end)
        want = [plain.encode(t, add_special_tokens=False).ids + [1] * (end is not None) for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert len(asked) == len(set(asked))
    assert [len(x) for x in encoder.batch(pa.array([], pa.string()), 1)] == [0, 0]


def test_more_words_than_are_split_at_once():
    from tokenizers import Tokenizer

    n = pfor.SOME + 5000
    texts = [" ".join(f"w{chr(97 + k % 26)}{k}" for k in range(n)), " ".join(f"я{k}" for k in range(50)), " ".join(f"w{chr(97 + k % 26)}{k}" for k in range(n - 1, -1, -7))]
    ids, sizes = pfor.Encoder(vocabulary()).batch(pa.array(texts))
    want = [t.ids for t in Tokenizer.from_file(vocabulary()).encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_token_blocks_round_trip(none):
    rng = np.random.default_rng(0)
    for ids in (np.empty(0, int), np.zeros(3, int), rng.integers(0, 49408, 5000), np.where(rng.random(2000) < 0.02, 49407, rng.integers(7, 40, 2000)), rng.integers(0, 2**32, 700)):
        data = pfor.to_file([1, None], [len(ids), 0], ids.astype(np.uint32))
        doc_ids, sizes, back = pfor.from_file(data)
        assert doc_ids == [1, None] and sizes.tolist() == [len(ids), 0] and (back == ids).all()
    few = len(pfor.encode_blocks(np.where(rng.random(512) < 0.05, 40_000, 3).astype(np.uint32))[0])
    assert few < 512  # outliers don't widen the block
    assert pfor.encode_documents(none, vocabulary()).count() == 0


# --- repeated strings


def removed(rows, length=50):
    least = {}
    for i, text in rows:
        data, own = text.encode(), 2**63 if i is None else i
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            least[s] = min(least.get(s, own), own)
    for i, text in rows:
        data, own = text.encode(), 2**63 if i is None else i
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if least[data[k : k + length]] < own:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield i, len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()


@pytest.mark.parametrize("table", ["edge", "small"])
def test_repeats(table, request):
    docs = request.getfixturevalue(table)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.repeats(docs, least=5).collect()]
    want = list(removed(rows_of(docs)))
    order = lambda r: (low(r[0]), r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert any(r[2] for r in got)


def test_repeats_of_no_rows(none):
    assert suffixes.repeats(none).count() == 0


def test_merged_transforms_give_sorted_suffixes_and_prefixes():
    import random

    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    for length in (1, 4, 9):
        owners = np.array([rng.randint(0, 99) for _ in strings])
        least = {}
        for s, o in zip(strings, owners):
            for k in range(len(s) - length + 1):
                least[s[k : k + length]] = min(least.get(s[k : k + length], 10**9), o)
        got = suffixes.least_owner(strings, owners, length)
        for s, values in zip(strings, got):
            assert values.tolist() == [least[s[k : k + length]] for k in range(len(s) - length + 1)]
    parts = [strings[::2], strings[1::2]]
    texts = [np.frombuffer(b"\xff".join(p) + b"\xff", np.uint8) for p in parts]
    orders, symbols = zip(*(suffixes.transform(t) for t in texts))
    shard, common = suffixes.merge(list(symbols), 12)
    at, merged = [0, 0], []
    for s in shard:
        start = orders[s][at[s]]
        merged.append(texts[s][start : start + 12].tobytes().split(b"\xff")[0] + b"\xff")
        at[s] += 1
    short = [m[:12] for m in merged]
    assert short == sorted(short)
    for a, b, c in zip(short, short[1:], common[1:]):
        same = next((k for k in range(12) if a[k : k + 1] != b[k : k + 1] or a[k] == 255), 12)
        assert c == same


def test_transforms_ordered_by_a_depth_are_enough():
    import random

    rng = random.Random(5)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.choice([1, 7, 8, 9, 30]))) for _ in range(200)] + [b"ab" * 40, b"ab" * 40 + b"a"]
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
    raw, ends = text.tobytes(), np.flatnonzero(text == 255)

    def symbols(start):  # up to the END, which is smaller the earlier it stands
        stop = int(ends[np.searchsorted(ends, start)])
        return [(b, 0) for b in raw[start:stop]] + [(255, stop)]

    whole = sorted(range(len(text)), key=symbols)
    assert suffixes.suffix_order(text).tolist() == whole
    for depth in (1, 8, 20):
        cut = [symbols(i)[:depth] for i in suffixes.suffix_order(text, depth).tolist()]
        assert cut == sorted(cut) and len(cut) == len(text)
    # Rows of equal first symbols may stand in any order, so a merge of such transforms is that of fully sorted ones.
    texts = [np.frombuffer(b"\xff".join(strings[s::3]) + b"\xff", np.uint8) for s in range(3)]
    for depth in (1, 8, 20):
        short = suffixes.merge([suffixes.transform(t, depth)[1] for t in texts], depth)
        full = suffixes.merge([suffixes.transform(t)[1] for t in texts], depth)
        starts = np.flatnonzero(full[1] < depth)
        assert (short[1] == full[1]).all()
        assert all((np.sort(a) == np.sort(b)).all() for a, b in zip(np.split(short[0], starts), np.split(full[0], starts)))


def test_segments_are_found_by_marks_of_their_anchors():
    texts = [(("%d " % k) * 60).encode() + b"passage " * 12 for k in range(40)]
    for _, data, _, key, starts, counts in suffixes.segments(texts):
        marks = suffixes._marks(key)
        known = np.unique(marks[::7])
        at = suffixes._among(known, marks)
        assert set(key[::7].tolist()) <= set(key[at].tolist()) and len(at) < len(key)
        named = suffixes._names(data, starts, counts, 50)
        assert (suffixes._names(data, starts[at], counts[at], 50) == named[at]).all()
