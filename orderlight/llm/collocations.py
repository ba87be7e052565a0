"""Phrase collocations: suffix pointers routed by their leading words and sorted by a multikey three-way quicksort."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlight.llm.base import table
from orderlight.session import small_side, stored

LONGEST = 3  # words of a phrase
LEAST = 10  # occurrences of a candidate
SHADOW = 50  # percent of a phrase's occurrences inside one longer candidate, from which it is dropped
TOP = 2000  # phrases of a language
LOT = 4_000_000  # bytes of texts that a task counts at once
POINTERS = 1_000_000  # suffixes that a task sorts, about
HOT = 100_000  # occurrences of both leading words, from which their suffixes are dealt out by the next word

# A-Z to lower case; what ends a piece to a line feed, a tab to a blank.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes(10 if b in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Words:
    """The words of some texts: their different ones, each word's number among them, and each word's piece."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts).translate(_FOLD), np.uint8)
        gap = (raw == 10) | (raw == 32)
        inner = np.concatenate([[True], gap, [True]])
        first, behind = np.flatnonzero(inner[:-1] & ~inner[1:]), np.flatnonzero(~inner[:-1] & inner[1:])
        offsets = np.concatenate([[0], np.cumsum(behind - first)])
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~gap])])
        coded = packed.dictionary_encode()
        self.dictionary, self.ids = coded.dictionary.cast(pa.large_string()), coded.indices.to_numpy().astype(np.int64)
        self.piece = np.cumsum(raw == 10)[first]

    def counts(self) -> tuple[pa.Array, np.ndarray]:
        return self.dictionary, np.bincount(self.ids, minlength=len(self.dictionary))

    def suffixes(self, longest: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The first ``longest`` words from each place that has a word after it in its piece: the different ones as
        texts, their counts and their words' numbers (-1 behind the end of the piece)."""
        n = len(self.ids)
        runs = np.full((n, longest), -1, np.int64)
        for k in range(longest):
            same = self.piece[k:] == self.piece[: n - k]
            runs[: n - k, k] = np.where(same, self.ids[k:], -1)
        runs = runs[runs[:, 1] >= 0] if n else runs
        code, base, found = np.zeros(len(runs), np.int64), len(self.dictionary) + 1, None
        for k in range(longest):
            if k and (code.max(initial=0) + 1) * base >= 2**63:
                code = np.unique(code, return_inverse=True)[1]
            code = code * base + runs[:, k] + 1
        found, at, many = np.unique(code, return_index=True, return_counts=True)
        runs = runs[at]
        columns = [self.dictionary.take(pa.array(runs[:, k], mask=runs[:, k] < 0)) for k in range(longest)]
        return pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()), null_handling="skip"), many, runs


def _lots(batches):
    """Rows (lang, text) -> (lang, Words) of about LOT bytes of texts of a language."""
    held: dict[str, list] = {}
    sizes: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            held.setdefault(lang, []).append(text)
            sizes[lang] += len(text) + 100
            if sizes.total() > LOT:
                most = max(sizes, key=sizes.get)
                yield most, Words(held.pop(most))
                del sizes[most]
    for lang, texts in held.items():
        yield lang, Words(texts)


def _rows(lang: str, keys: pa.Array, counts: np.ndarray, **more) -> pa.RecordBatch:
    columns = {"lang": pa.repeat(pa.scalar(lang), len(keys)), "key": keys.cast(pa.string()), "n": pa.array(counts, pa.int64())}
    return pa.RecordBatch.from_pydict(columns | more)


def _words(batches):
    for lang, words in _lots(batches):
        yield _rows(lang, *words.counts())


def salts_of(words: Words, runs: np.ndarray, fans: dict[str, int]) -> np.ndarray:
    """Per suffix 0, or 1 and more by its third word where both leading words are in ``fans``."""
    fan = np.array([fans.get(w, 0) for w in words.dictionary.to_pylist()] if fans else [0] * len(words.dictionary), np.int64)
    both = np.minimum(fan[runs[:, 0]], fan[runs[:, 1]])
    salt = np.zeros(len(runs), np.int32)
    some = np.flatnonzero(both)
    if len(some) and runs.shape[1] > 2:
        third = np.append([zlib.crc32(w.encode()) for w in words.dictionary.to_pylist()], 0)
        salt[some] = 1 + third[runs[some, 2]] % both[some]
    return salt


def quicksorted(keys: np.ndarray, weight: np.ndarray, least: int, split: np.ndarray):
    """Multikey three-way quicksort of pointers to rows of ``keys`` (column 0: language; then words, -1 behind the
    end). Yields (depth, a row, weight) of each partition of rows that are equal in language and the first ``depth``
    words, depth 2 and more.

    All open partitions take one step together: each is split by the key of its middle pointer at its own depth into
    smaller, equal and larger; the equal part goes one key deeper. A partition lighter than ``least`` is abandoned,
    unless it is not yet two words deep and holds suffixes that also lie with other tasks (``split``)."""
    last = keys.shape[1] - 1
    order, begin, depth = np.arange(len(keys)), np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(order):
        sizes = np.diff(np.append(begin, len(order)))
        of = np.repeat(np.arange(len(begin)), sizes)
        own = keys[order, depth[of]]
        side = np.sign(own - own[begin + sizes // 2][of])
        # Counting sort by (partition, side): stable, and each partition stays where it is.
        place = of * 3 + side + 1
        many = np.bincount(place, minlength=len(begin) * 3)
        at = np.empty(len(order), np.int64)
        starts = np.cumsum(many) - many
        for s in range(3):
            rows = np.flatnonzero(side == s - 1)
            first = np.cumsum(many[s::3]) - many[s::3]
            at[rows] = starts[place[rows]] + np.arange(len(rows)) - first[of[rows]]
        moved = np.empty_like(order)
        moved[at] = order
        order = moved
        live = np.flatnonzero(many)
        begin, sizes = starts[live], many[live]
        depth = np.repeat(depth, 3)[live] + (live % 3 == 1)
        deeper = live % 3 == 1
        total = np.add.reduceat(weight[order], begin)
        spread = np.logical_or.reduceat(split[order], begin)
        ended = deeper & (keys[order[begin], depth - 1] < 0)
        whole = deeper & (depth > 2) & ~ended & ((total >= least) | (spread & (depth == 3)))
        for k in np.flatnonzero(whole).tolist():
            yield int(depth[k]) - 1, int(order[begin[k]]), int(total[k])
        keep = ((total >= least) | (spread & (depth <= 2))) & ~ended & ~(deeper & (depth > last))
        order = order[np.repeat(keep, sizes)]
        sizes, depth = sizes[keep], depth[keep]
        begin = np.cumsum(sizes) - sizes


def _sorted_phrases(least: int, longest: int):
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64())])

    def of(batches):
        rows = [pa.Table.from_batches([b]) for b in batches]
        if not rows:
            return
        rows = pa.concat_tables(rows).combine_chunks()
        split = pc.split_pattern(rows.column("suffix"), " ").combine_chunks()
        lists = split.chunk(0) if isinstance(split, pa.ChunkedArray) else split
        words = lists.flatten().dictionary_encode()
        lengths = lists.value_lengths().to_numpy()
        keys = np.full((len(rows), longest + 1), -1, np.int64)
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        langs = langs.chunk(0) if isinstance(langs, pa.ChunkedArray) else langs
        keys[:, 0] = langs.indices.to_numpy()
        owner = np.repeat(np.arange(len(rows)), lengths)
        keys[owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1] = _ranks(words.dictionary)[words.indices.to_numpy()]
        found = list(quicksorted(keys, rows.column("n").to_numpy(), least, rows.column("salt").to_numpy() > 0))
        suffix, lang = rows.column("suffix"), rows.column("lang")
        out = [(lang[r].as_py(), " ".join(suffix[r].as_py().split(" ")[:depth]), depth, n) for depth, r, n in found]
        columns = zip(*out) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return of


def _ranks(dictionary: pa.Array) -> np.ndarray:
    """The place of each word in order, so that pivots cut evenly."""
    ranks = np.empty(len(dictionary), np.int64)
    ranks[pc.sort_indices(dictionary).to_numpy()] = np.arange(len(dictionary))
    return ranks


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all words of all pieces; ``docs`` has lang and text, no nulls."""
    return docs.select("lang", "text").mapInArrow(_words, "lang string, key string, n long").groupBy("lang", F.col("key").alias("word")).agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST, pointers: int = POINTERS, hot: int = HOT) -> DataFrame:
    """(lang, phrase, size, n) of every phrase of 2 to ``longest`` words that occurs ``least`` times in its language.

    Suffixes go to tasks by language and two leading words, so a task sees all of a phrase and may abandon it. Where
    both words occur more than ``hot`` times, so that the pair may, its suffixes are dealt out by the third word:
    phrases of three words still meet, counts of the pair are added up afterwards. Tasks count equal suffixes first, so
    one frequent phrase is one row a task."""
    total = words.agg(F.sum("n")).first()[0] or 0
    many = words.where((F.col("n") > hot) & (F.col("n") * 200_000 > total)).select("lang", "word", "n")
    # At most 200,000 words are that frequent.
    fans: dict[str, dict[str, int]] = {}
    for r in many.toLocalIterator():
        fans.setdefault(r.lang, {})[r.word] = -(-r.n // hot)

    def taken(batches):
        for lang, words in _lots(batches):
            keys, counts, runs = words.suffixes(longest)
            yield _rows(lang, keys, counts, salt=pa.array(salts_of(words, runs, fans.get(lang, {}))))

    found = docs.select("lang", "text").mapInArrow(taken, "lang string, key string, n long, salt int").withColumnRenamed("key", "suffix")
    routed = found.repartition(max(16, -(-total // pointers)), F.col("lang"), F.substring_index("suffix", " ", 2), F.col("salt"))
    sorted_ = routed.mapInArrow(_sorted_phrases(least, longest), "lang string, phrase string, size int, n long")
    return sorted_.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def part(phrase: Column, start: int, size: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, size), " ")


def scored(phrases: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Phrases (lang, phrase, size, n) with a, l, r and score of the lowest-scoring cut, the smallest cut among equals.
    Both parts of a phrase are frequent themselves, so their counts are at hand."""
    parts = words.select("lang", F.col("word").alias("part"), F.col("n").alias("many")).unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("many")))
    cuts = [F.struct(F.lit(k).alias("cut"), part(F.col("phrase"), 1, k).alias("left"), F.slice(F.split("phrase", " "), k + 1, longest).alias("right")) for k in range(1, longest)]
    each = phrases.select("lang", "phrase", "size", F.col("n").alias("a"), F.inline(F.array(*cuts))).where(F.col("cut") < F.col("size"))
    each = each.withColumn("right", F.array_join("right", " "))
    near = small_side(stored(parts, "parts"))
    side = lambda name, count: near.select("lang", F.col("part").alias(name), F.col("many").alias(count))
    both = each.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), wide("l") * wide("r"))
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    return lowest.select("lang", "phrase", "size", "a", "b.l", "b.r", "b.score")


def shadowed(phrases: DataFrame, share: int = SHADOW, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase) of the candidates whose words stand inside a longer one with ``share`` percent of their count."""
    inner = [F.struct(F.lit(size).alias("size"), part(F.col("phrase"), start, size).alias("inner")) for size in range(2, longest) for start in range(1, longest - size + 2)]
    longer = phrases.select("lang", F.col("size").alias("_size"), "n", F.inline(F.array(*inner)), "phrase").where((F.col("size") < F.col("_size")) & (F.size(F.split("inner", " ")) == F.col("size")))
    most = longer.groupBy("lang", F.col("inner").alias("phrase")).agg(F.max("n").alias("most"))
    return phrases.join(most, ["lang", "phrase"]).where(100 * F.col("most") >= share * F.col("n")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHADOW, top: int = TOP, pointers: int = POINTERS, hot: int = HOT) -> DataFrame:
    """Per language its ``top`` phrases: lang, rank, phrase, a, l, r, n, score. A null lang is ``und``, a null text
    empty; every row counts, repeated ids and rows included; other columns are not looked at; a language without a
    frequent phrase gives no rows, as does an empty table. Equal scores are ordered by count, then phrase."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = stored(word_counts(rows), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    phrases = stored(phrase_counts(rows, words, least, longest, pointers, hot), "phrases")
    kept = scored(phrases, frequent, longest).join(small_side(shadowed(phrases, share, longest)), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(small_side(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


# The same rows by joins of counted runs of words.
OP12_SQL = f"""
WITH pieces AS (
  SELECT row, lang, generate_subscripts(p, 1) AS piece, unnest(p) AS text
  FROM (
    SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
           regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS p
    FROM documents
  )
),
words AS MATERIALIZED (
  SELECT row, lang, piece, generate_subscripts(w, 1) AS place, unnest(w) AS word
  FROM (SELECT row, lang, piece, regexp_extract_all(text, '[^\\x20\\x09]+') AS w FROM pieces)
),
runs AS MATERIALIZED (
  SELECT lang, word AS w1, lead(word, 1) OVER piece AS w2, lead(word, 2) OVER piece AS w3
  FROM words WINDOW piece AS (PARTITION BY row, piece ORDER BY place)
),
f AS MATERIALIZED (
  SELECT lang, w1 AS phrase, count(*) AS n FROM runs GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
),
candidates AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE contains(phrase, ' ')),
cuts AS MATERIALIZED (
  SELECT lang, phrase, a, w, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k+1:], ' ') AS tail
  FROM candidates, (VALUES (1), (2)) AS cut(k) WHERE k < len(w)
),
heads AS MATERIALIZED (SELECT c.*, f.n AS l FROM cuts c JOIN f ON f.lang = c.lang AND f.phrase = c.head),
scores AS (
  SELECT c.lang, c.phrase, c.a, c.w, c.k, c.l, f.n AS r, (1000000::HUGEINT * c.a * c.a) // (c.l::HUGEINT * f.n) AS score
  FROM heads c JOIN f ON f.lang = c.lang AND f.phrase = c.tail
),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(n) AS most
  FROM (
    SELECT lang, array_to_string(w[:2], ' ') AS phrase, a AS n FROM candidates WHERE len(w) = 3
    UNION ALL SELECT lang, array_to_string(w[2:], ' '), a FROM candidates WHERE len(w) = 3
  ) GROUP BY ALL
),
ranked AS (
  SELECT s.lang, s.phrase, a, l, r, score, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
  WHERE g.most IS NULL OR 100 * g.most < {SHADOW} * a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN (SELECT lang, count(*) AS n FROM words GROUP BY ALL) USING (lang) WHERE rank <= {TOP}
"""
