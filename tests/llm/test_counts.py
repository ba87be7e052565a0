"""Operators on counts against brute force and their SQL: source divergence, collocations, quality rules."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from orderlight.llm import collocations, divergence, quality

EDGES = "edge small many".split()


@pytest.fixture(scope="session")
def many(spark):
    """Few words, many documents: frequent terms and phrases, equal counts, nulls, repeated rows, an odd language."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        lang = rng.choice(["en", "en", "de", None, "x"])
        words = [rng.choice("the The of à É zz 漢字 qq9w a_b hot hot hot".split()) for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\r", ",", "\x1c"]) for w in words)
        rows.append((rng.choice([i, i, 7, None]), rng.choice([text, text, text, None, ""]), lang, rng.choice(["s0", "s0", "s1", None, "", "b c"]), 1, 0.5, "x", 1, "y"))
    rows += [rows[0]] * 40
    from conftest import DOCS

    return spark.createDataFrame(rows, DOCS).repartition(5)


def plain(df):
    return [r.asDict() for r in df.collect()]


def by_sql(docs, sql):
    import pandas as pd

    db = duckdb.connect()
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    columns = {n: pd.array([r[n] for r in rows], dtype="Int64" if n == "doc_id" else "string") for n in ("doc_id", "text", "lang", "source")}
    db.register("documents", pd.DataFrame(columns))
    result = db.sql(sql)
    return [dict(zip(result.columns, r)) for r in result.fetchall()]


def same(a, b):
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(map(key, a)) == sorted(map(key, b))


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- source divergence


def audited(docs, least=30, top=50):
    counts, langs, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for r in docs.collect():
        lang, source = r.lang or "", r.source or ""
        groups.add((lang, source))
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered(r.text))
        counts[lang, source].update(found)
        langs[lang].update(found)
        seen[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= least]
        total = lambda c: sum(c[t] for t in kept) + 5 * len(kept)  # noqa: E731, B023
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // total(c) for t in kept}  # noqa: E731, B023
        p, q = share(counts[lang, source]), share(langs[lang])
        pairs = []
        for other in {s for g, s in groups if g == lang} - {source}:
            o = share(counts[lang, other])
            pairs.append((sum(abs(p[t] - o[t]) for t in kept), other))
        terms = [(p[t] - q[t], t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, rows, limit in (("pair", pairs, None), ("term", terms, top)):
            for rank, (value, item) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1].encode()))[:limit], 1):
                out.append({"lang": lang, "source": source, "part": part, "item": item, "value": value, "rank": rank})
    return out


@pytest.mark.parametrize("table", EDGES)
def test_divergence(table, request):
    docs = request.getfixturevalue(table)
    got = plain(divergence.audit(docs))
    same(got, audited(docs))
    same(got, by_sql(docs, divergence.OP11_SQL))


def test_divergence_of_small_buckets_and_few_ranks(many):
    from orderlight.session import stored

    counts = stored(divergence.term_counts(many, 5))
    groups = stored(divergence.groups_of(many, counts))
    got = plain(divergence.pair_ranks(counts, groups, cells=7)) + plain(divergence.term_ranks(counts, groups, top=3))
    same([{**r, "part": ""} for r in got], [{**r, "part": ""} for r in audited(many, 5, 3)])


def test_shares_stay_exact_past_64_bits(spark):
    from pyspark.sql import functions as F

    counts, total = [0, 5, 10**10, 10**13 - 1], 3 * 10**13
    want = [1 + 10**9 * (n + 5) // total for n in counts]
    assert divergence.shares(np.array(counts), total).tolist() == want
    df = spark.createDataFrame([(n, total) for n in counts], "n long, t long")
    assert [r.p for r in df.select(divergence.share(F.col("n"), F.col("t")).alias("p")).collect()] == want


# --- collocations


def collocated(docs, least=10, top=2000, share=50):
    count, size = defaultdict(Counter), Counter()
    for r in docs.collect():
        lang = "und" if r.lang is None else r.lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(r.text)):
            words = re.findall("[^\x20\x09]+", piece)
            size[lang] += len(words)
            for n in (1, 2, 3):
                count[lang].update(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(o) > len(p) and 100 * b >= share * a and any(o[k : k + len(p)] == p for k in range(len(o) - len(p) + 1)) for o, b in candidates.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append({"lang": lang, "phrase": " ".join(p), "a": a, "l": l, "r": r, "n": size[lang], "score": score})
        rows.sort(key=lambda x: (-x["score"], -x["a"], x["phrase"].encode()))
        out += [{**row, "rank": k} for k, row in enumerate(rows[:top], 1)]
    return out


@pytest.mark.parametrize("table", EDGES)
def test_collocations(table, request):
    docs = request.getfixturevalue(table)
    got = plain(collocations.collocations(docs))
    same(got, collocated(docs))
    same(got, by_sql(docs, collocations.OP12_SQL))


def test_collocations_of_hot_heads_and_few_ranks(many):
    got = plain(collocations.collocations(many, least=4, top=7, hot=20, pointers=100))
    same(got, collocated(many, 4, 7))


def test_quicksort_gives_the_counts_of_equal_prefixes():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 4, (3000, 4)) ** 2
    keys[rng.random(3000) < 0.2, 3] = -1
    weight, none = rng.integers(1, 5, 3000), np.zeros(3000, bool)
    for least, split in ((1, none), (60, none), (60, keys[:, 1] == 1)):
        want = {}
        for depth in (2, 3):
            total = Counter()
            for k, w in zip(keys.tolist(), weight.tolist()):
                if k[depth] >= 0:
                    total[tuple(k[: depth + 1])] += w
            want |= {p: n for p, n in total.items() if n >= least or (depth == 2 and split.any() and p[1] == 1)}
        got = {tuple(keys[r, : d + 1].tolist()): n for d, r, n in collocations.quicksorted(keys, weight, least, split)}
        assert got == want


def test_scores_stay_exact_past_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a b", 2, 10**13)], "lang string, phrase string, size int, n long")
    words = spark.createDataFrame([("en", "a", 3 * 10**13), ("en", "b", 2 * 10**13)], "lang string, word string, n long")
    assert collocations.scored(phrases, words).first().score == 10**6 * 10**26 // (6 * 10**26)


# --- quality rules


def quality_of(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n, repeats = len(words), len(covered)
    base = n < 10 or 100 * repeats > 20 * n
    return (n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), repeats, base)


@pytest.mark.parametrize("table", EDGES)
def test_quality(table, request):
    docs = request.getfixturevalue(table)
    rows = quality.ledger(docs)
    got = rows.withColumn("ok", ~quality.CURRENT.rejects(rows.failed)).collect()
    assert len(got) == docs.count() and set(docs.columns) < set(rows.columns)
    for r in got:
        m = r.measures
        base = bool(r.failed & (quality.bit("few_words") | quality.bit("repeated_words")))
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, base) == quality_of(r.text)
        assert not (base and r.ok)
    shown = [getattr(rows.measures, m).alias(m) for m in quality.MEASURES]
    failed = quality.Policy("base", quality.BASE).rejects(rows.failed)
    whole = rows.select("doc_id", *shown, "failed", failed.alias("base_failed"), (~quality.CURRENT.rejects(rows.failed)).alias("kept"))
    same(plain(whole), by_sql(docs, quality.OP13_SQL))


def test_policies_and_ablations(small):
    rows = quality.ledger(small)
    failed = [r.failed for r in rows.collect()]
    verdicts = quality.decided(rows).collect()
    got = {(r.policy, r["rule"]): r for r in quality.ablations(rows).collect()}
    assert len(got) == len(quality.POLICIES) * len(quality.RULES)
    for p in quality.POLICIES:
        strict, soft = p.masks()
        rejects = lambda bits: bool(bits & strict) or (bits & soft).bit_count() >= p.votes  # noqa: E731, B023
        assert Counter(r.kept[p.version] for r in verdicts) == Counter(not rejects(b) for b in failed)
        for name in quality.RULES:
            own, r = quality.bit(name), got[p.version, name]
            assert (r.documents, r.failing, r.rejected) == (len(failed), sum(bool(b & own) for b in failed), sum(map(rejects, failed)))
            assert r.saved == sum(rejects(b) and not rejects(b & ~own) for b in failed)


def test_quality_follows_the_labels(spark):
    """Labelled rows of the test tables: junk goes, clean texts that the base rules leave stay."""
    sf = "/root/testdata/sf0.01"
    rows = quality.op13_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    junk, clean = [r.kept for r in rows if not r.quality], [r.kept for r in rows if r.quality and not r.base_failed]
    assert sum(junk) <= 0.05 * len(junk) and all(clean)


def test_counts_of_no_rows(none):
    assert divergence.audit(none).count() == collocations.collocations(none).count() == quality.ledger(none).count() == 0
    assert {r.documents for r in quality.ablations(quality.ledger(none)).collect()} == set()
