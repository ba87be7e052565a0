"""Quality rules kept as a ledger: every rule is evaluated once, policies are applied to its failure bits afterwards."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlight.llm.base import as_bytes, table

WINDOW = 5  # words that a repeated passage has at least

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bare", "n_exclaims",
)
_TYPE = "struct<" + ",".join(f"{m}:long" for m in MEASURES) + ">"

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_NOT_CHARS = _SPACE + bytes(range(0x80, 0xC0))  # what starts no code point of a word
_SYMBOLS, _UPPER, _LOWER = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(97, 123))
_BARE = bytes(b for b in range(128) if not chr(b).isalnum())  # 0x00-0x2F, 0x3A-0x40, 0x5B-0x60, 0x7B-0x7F


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that stand in a window of ``width`` words found twice or more in the text, the first one included."""
    windows = list(zip(*(words[k:] for k in range(width))))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered, end = 0, 0
    for start, window in enumerate(windows):
        if seen[window] > 1:
            covered += start + width - max(start, end)
            end = start + width
    return covered


def measured(text: bytes) -> tuple[int, ...]:
    """MEASURES of one text. Lines count if they hold a word; a bare word has neither letter nor digit."""
    count = lambda some: len(text) - len(text.translate(None, some))
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    upper = count(_UPPER)
    return (
        len(words), len(text.translate(None, _NOT_CHARS)), count(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), upper, upper + count(_LOWER), sum(not w.strip(_BARE) for w in words), text.count(b"!"),
    )


def measures(text: Column) -> Column:
    @F.pandas_udf(_TYPE)
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measured(bytes(t)) for t in texts], columns=list(MEASURES), dtype="int64")

    return of(as_bytes(text))


# Rule: name -> when the measures fail it, in whole numbers. Its place is its bit; new rules are added at the end.
RULES: dict[str, Callable[[Column], Column]] = {
    "few_words": lambda m: m["n_words"] < 10,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"],
    "symbols": lambda m: 100 * m["n_symbols"] > 10 * m["n_words"],
    "bare_words": lambda m: 100 * m["n_bare"] > 20 * m["n_words"],
    "capitals": lambda m: (m["n_letters"] >= 20) & (100 * m["n_upper"] > 40 * m["n_letters"]),
    "exclaims": lambda m: 100 * m["n_exclaims"] > 20 * m["n_words"],
    "repeated_lines": lambda m: (m["n_lines"] >= 4) & (100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 18 * m["n_words"],
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


@dataclass(frozen=True)
class Policy:
    """A document is rejected if it fails one of ``strict``, or at least ``votes`` of ``soft``."""

    version: str
    strict: tuple[str, ...]
    soft: tuple[str, ...] = ()
    votes: int = 1

    def masks(self) -> tuple[int, int]:
        return sum(map(bit, self.strict)), sum(map(bit, self.soft))

    def rejects(self, failed: Column) -> Column:
        strict, soft = (F.lit(m).cast("long") for m in self.masks())
        return (failed.bitwiseAND(strict) != 0) | (F.bit_count(failed.bitwiseAND(soft)) >= self.votes)


BASE = ("few_words", "repeated_words")
POLICIES = (
    Policy("base-1", BASE),
    Policy("surface-1", (*BASE, "symbols", "bare_words", "capitals", "exclaims")),
    Policy("surface-2", (*BASE, "symbols", "bare_words", "capitals", "exclaims"), ("repeated_lines", "short_words", "long_words"), 1),
)
CURRENT = POLICIES[-1]


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``measures`` (struct of longs) and ``failed`` (long, one bit a rule). Columns of ``docs`` of these
    names are replaced. A null text counts as empty: no words, so it fails ``few_words`` and no share. Row by row:
    repeated rows and ids stay, an empty table stays empty."""
    rows = docs.withColumn("measures", measures(F.col(text)))
    fails = [F.when(fails(F.col("measures")), F.lit(bit(name))).otherwise(0) for name, fails in RULES.items()]
    return rows.withColumn("failed", reduce(add, fails).cast("long"))


def decided(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Ledger rows with ``kept``: a map from policy version to its verdict. No text is read again."""
    return rows.withColumn("kept", F.create_map(*[c for p in policies for c in (F.lit(p.version), ~p.rejects(F.col("failed")))]))


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Ledger -> per policy and rule: documents, ``failing`` the rule, ``rejected`` by the policy and ``saved``: those
    that the policy keeps once the rule is taken out of it. Documents are first counted by failure bits, so what is
    compared is at most one row for each set of bits that occurs (2 to the number of rules at most)."""
    sets = rows.groupBy("failed").agg(F.count("*").alias("n"))
    cases = [(p.version, name, bit(name), *p.masks(), p.votes) for p in policies for name in RULES]
    named = ("policy", "rule", "bit", "strict", "soft", "votes")
    each = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(named, case)]) for case in cases])
    told = sets.select("failed", "n", F.inline(each))
    failed, own = F.col("failed"), F.col("bit").cast("long")
    hit = lambda bits, mask: bits.bitwiseAND(F.col(mask).cast("long"))
    rejects = lambda bits: (hit(bits, "strict") != 0) | (F.bit_count(hit(bits, "soft")) >= F.col("votes"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    now, then = rejects(failed), rejects(failed.bitwiseAND(F.bitwise_not(own)))
    return told.groupBy("policy", "rule").agg(
        F.sum("n").alias("documents"), total(hit(failed, "bit") != 0).alias("failing"), total(now).alias("rejected"), total(now & ~then).alias("saved")
    )


def op13_quality(spark, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = Policy("base", BASE).rejects(F.col("failed"))
    shown = [F.col(f"measures.{m}").alias(m) for m in MEASURES]
    return rows.select("doc_id", *shown, F.col("failed"), base.alias("base_failed"), (~CURRENT.rejects(F.col("failed"))).alias("kept"))


# The same measures and the current policy by lists and windows.
OP13_SQL = """
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
words AS MATERIALIZED (
  SELECT row, generate_subscripts(w, 1) AS place, unnest(w) AS word
  FROM (SELECT row, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs)
),
counted AS (
  SELECT row, count(*) AS n_words, sum(length(word)) AS word_chars,
         count(*) FILTER (NOT regexp_matches(word, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]')) AS n_bare
  FROM words GROUP BY row
),
windows AS (
  SELECT row, place, word AS a, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c, lead(word, 3) OVER p AS d, lead(word, 4) OVER p AS e
  FROM words WINDOW p AS (PARTITION BY row ORDER BY place)
),
repeats AS MATERIALIZED (
  SELECT row, place FROM windows WHERE e IS NOT NULL QUALIFY count(*) OVER (PARTITION BY row, a, b, c, d, e) > 1
),
repeated AS (SELECT row, count(DISTINCT place + k) AS n_repeat_words FROM repeats, range(5) AS s(k) GROUP BY row),
lines AS (
  SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row
),
measures AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
         coalesce(n_bare, 0) AS n_bare, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims
  FROM docs LEFT JOIN counted USING (row) LEFT JOIN repeated USING (row) LEFT JOIN lines USING (row)
),
told AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
         + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_bare > 20 * n_words THEN 8 ELSE 0 END
         + CASE WHEN n_letters >= 20 AND 100 * n_upper > 40 * n_letters THEN 16 ELSE 0 END + CASE WHEN 100 * n_exclaims > 20 * n_words THEN 32 ELSE 0 END
         + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 64 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 128 ELSE 0 END
         + CASE WHEN word_chars > 18 * n_words THEN 256 ELSE 0 END AS failed
  FROM measures
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines, n_upper::BIGINT AS n_upper, n_letters::BIGINT AS n_letters,
       n_bare::BIGINT AS n_bare, n_exclaims::BIGINT AS n_exclaims, failed::BIGINT AS failed, base_failed, failed = 0 AS kept
FROM told
"""
