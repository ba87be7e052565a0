"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlight.llm.base import smallest_hashes, table
from orderlight.session import stored

# Characters that stand for a Latin letter, and phrases in which a lexicon word is harmless.
LOOKALIKES = {
    "a": "а@4αàáâãäåā", "b": "вβ", "c": "сϲç", "e": "её3εèéêëē", "h": "һ", "i": "іι1lìíîïī", "j": "ј", "k": "кκ",
    "m": "м", "n": "ηñ", "o": "о0οσòóôõöø", "p": "рρ", "s": "ѕ5$", "t": "т7τ", "u": "υùúûüū", "v": "ν", "x": "хχ", "y": "уγýÿ",
}
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "sore loser")
FOLD = {ord(c): letter for letter, likes in LOOKALIKES.items() for c in likes}

SAMPLE = 20_000  # labelled rows that the model is fitted on, at most
LEAST = 4  # toxic texts that hold a term of the lexicon, at least
STEMS = (4, 5)  # letters at a word's start that count as a stem
CHANCE = 0.05  # how likely any term of the lexicon may be there by chance
CUT = 0.3  # score from which a document is toxic


def folded(text: str) -> list[str]:
    """Lower-cased words with look-alike characters and digits replaced; l, i and 1 are one letter."""
    return text.lower().translate(FOLD).split()


def bare(word: str) -> str:
    """A folded word without the marks around it."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def terms_of(words: list[str]) -> set[str]:
    """The bare words of a folded text, and the stems of longer ones, which end in a star."""
    every = {w for x in set(words) if (w := bare(x))}
    return every | {w[:n] + "*" for w in every for n in STEMS if len(w) > n}


@dataclass
class Model:
    """Folded words and stems with their weights, folded exception phrases, coefficients of (1, log1p sum, log1p density)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, float, float] = (-50.0, 0.0, 0.0)


def automaton(model: Model):
    found = ahocorasick.Automaton()
    entries: dict[str, list] = {}
    for term, weight in model.weights.items():
        entries.setdefault(term.rstrip("*"), []).append((weight, term.endswith("*")))
    for phrase in model.exceptions:
        entries.setdefault(phrase, []).append((None, False))
    for key, kinds in entries.items():
        found.add_word(key, (len(key), kinds))
    found.make_automaton()
    return found


def hits(words: list[str], trie) -> list[float]:
    """Weights of the lexicon's words and stems in a folded text that no exception phrase covers, the largest one for
    each word. Words match whole, stems at the start of a word."""
    if not len(trie):
        return []
    text = " ".join(words)
    some, covered = {}, []
    for end, (size, kinds) in trie.iter(text):
        start = end - size + 1
        if start and text[start - 1].isalnum():
            continue
        inside = end + 1 < len(text) and text[end + 1].isalnum()
        for weight, stem in kinds:
            if weight is None and not inside:
                covered.append((start, end))
            elif weight is not None and stem == inside:
                some[start] = max(weight, some.get(start, weight))
    return [w for s, w in some.items() if not any(a <= s <= b for a, b in covered)]


def features(text: str | None, trie) -> tuple[float, float]:
    """Sum of the matched weights, and the sum by the square root of the length in words."""
    words = folded(text or "")
    total = sum(hits(words, trie))
    return math.log1p(total), math.log1p(total / math.sqrt(max(1, len(words))))


def score_column(text: Column, model: Model) -> Column:
    """Probability of being toxic. Null and empty texts score as texts without a match."""
    base, a, b = model.coefficients

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = automaton(model)
        for texts in batches:
            found = [features(t, trie) for t in texts]
            yield pd.Series([1 / (1 + math.exp(-max(-50.0, min(50.0, base + a * x + b * y)))) for x, y in found], dtype="float64")

    return of(text)


def in_training(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2


def labelled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents outside the held-out quarter, by the smallest hash of
    their id. A document labelled twice counts as toxic if any label says so; equal texts count once."""
    chosen = labels.where(in_training(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = smallest_hashes(chosen, F.xxhash64("doc_id"), rows).withColumnRenamed("doc_id", "_id")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return stored(found.groupBy(F.xxhash64("text").alias("h")).agg(F.max_by("text", "doc_id").alias("text"), F.max("toxic").alias("toxic")), "labelled")


def _counted(sample: DataFrame, terms) -> DataFrame:
    """How many toxic and clean texts hold each term; ``terms``: text -> set."""
    schema = pa.schema([("term", pa.string()), ("bad", pa.int64()), ("good", pa.int64())])

    def count(batches):
        bad, good = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (bad if toxic else good).update(terms(text or ""))
        every = [*{**bad, **good}]
        yield pa.RecordBatch.from_pydict({"term": every, "bad": [bad[t] for t in every], "good": [good[t] for t in every]}, schema)

    each = sample.select("text", "toxic").mapInArrow(count, "term string, bad long, good long")
    return each.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, least: int = LEAST, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Learns lexicon, exception phrases and calibration from a bounded sample of labelled rows.

    A word or stem enters if it stands in at least ``least`` toxic texts, however many there are, is at least
    e^3 times as frequent there, and if chance is a bad explanation: Chernoff's bound for its share of toxic texts is
    below ``CHANCE`` by the number of terms that are looked at. Every such term stays; only the sample bounds how
    many. Its weight is the log of the ratio. A stem that stands
    in more clean texts than one of its words, but in no more toxic ones, is left out. A pair of words becomes an
    exception if it holds a lexicon word, stands in three clean texts and in no toxic one. Without toxic labels
    nothing scores. Null texts count as empty, labels other than 0 and 1 are left out, other columns are ignored.
    """
    sample = labelled(docs, labels, rows)
    sizes = dict(sample.groupBy("toxic").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model()
    ratio = F.log((F.col("bad") + 0.5) / (n1 + 1) / ((F.col("good") + 0.5) / (n0 + 1)))
    counts = stored(_counted(sample, lambda t: terms_of(folded(t))).where(F.col("bad") + F.col("good") >= least), "terms")
    part = lambda n, share: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (F.col("bad") + F.col("good")) / share)).otherwise(0.0)
    evidence = part("bad", n1 / (n1 + n0)) + part("good", n0 / (n1 + n0))
    sure = evidence >= math.log(max(1, counts.count()) / CHANCE)
    chosen = counts.where((F.col("bad") >= least) & (ratio >= 3) & sure).select("term", ratio.alias("w"), "bad", "good")
    found = {r.term: r for r in chosen.collect()}
    words = defaultdict(list)
    for term, r in found.items():
        for stem in {term[:n] + "*" for n in STEMS if len(term) >= n and not term.endswith("*")}:
            words[stem].append(r)
    loose = {t for t, r in found.items() if any(s.bad == r.bad and s.good < r.good for s in words.get(t, ()))}
    weights = {t: r.w for t, r in found.items() if t not in loose}

    def pairs(text):
        every = [bare(w) for w in folded(text)]
        return {f"{a} {b}" for a, b in zip(every, every[1:]) if (a in weights or b in weights) and a and b}

    harmless = _counted(sample, pairs).where("good >= 3 and bad = 0")
    phrases = tuple(" ".join(folded(p)) for p in exceptions) + tuple(r.term for r in harmless.collect())
    model = Model(weights, phrases)

    def measure(batches):
        trie = automaton(model)
        for batch in batches:
            found = [features(t, trie) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.float64()), pa.array([y for _, y in found], pa.float64()), batch.column(1).cast(pa.float64())], names=["x", "y", "t"])

    # At most ``rows`` rows of three numbers.
    data = np.array([tuple(r) for r in sample.select("text", "toxic").mapInArrow(measure, "x double, y double, t double").collect()])
    model.coefficients = _logistic(data[:, :2], data[:, 2])
    return model


def _logistic(x: np.ndarray, t: np.ndarray, ridge: float = 0.1, steps: int = 50) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; the constant is not shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(3), np.diag([1e-6, ridge, ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (t - p) - penalty @ w)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", out, score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
