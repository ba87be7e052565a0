"""How the sources of a language differ in their words: counts of kept terms, ranked by cells of equal counts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlight.llm.base import table
from orderlight.session import small_side, stored

LEAST_DOCS = 30  # documents of a language that hold a kept term, at least
PRIOR = 5
SCALE = 1_000_000_000
TOP = 50  # ranks of terms
HELD = 400_000  # counts that a task holds before it hands them on
CELLS = 500_000  # numbers of a matrix of terms by sources

# A-Z to lower case, every other byte below 0x80 but a-z to a space: terms are what split() then finds.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _counted(batches):
    """Rows (lang, source, text) -> counts of a task's terms by group, with the number of documents."""
    held: dict[tuple, list] = {}

    def handed():
        keys = [(lang, source, term.decode(), n, docs) for (lang, source), counts in held.items() for term, (n, docs) in counts.items()]
        columns = zip(*keys) if keys else ([] for _ in COUNTS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COUNTS)], schema=COUNTS)

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            counts = held.setdefault((lang, source), {})
            before = len(counts)
            for term, n in Counter(terms_of(text)).items():
                one = counts.get(term)
                if one is None:
                    counts[term] = [n, 1]
                else:
                    one[0] += n
                    one[1] += 1
            size += len(counts) - before
            if size > HELD:
                yield handed()
                held, size = {}, 0
    if held:
        yield handed()


def term_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Rows (lang, source, term, n, lang_n, first): occurrences of each kept term in a group and in its language;
    ``first`` marks one row of each (lang, term).

    Tasks count on their own first, so a hot group or term costs one row a task; one shuffle by (lang, term) then serves
    both sums."""
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    spread = clean.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    groups = spread.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")
    total = groups.withColumns({"lang_n": F.sum("n").over(of), "_docs": F.sum("docs").over(of), "_place": F.row_number().over(of.orderBy("source"))})
    return total.where(F.col("_docs") >= least).select("lang", "source", "term", "n", "lang_n", (F.col("_place") == 1).alias("first"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / total), exact: the product may pass 64 bits, so it is a decimal."""
    product = (n + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", product, total.cast("decimal(20,0)")) + 1


def shares(n: np.ndarray, total: int) -> np.ndarray:
    """The same for an array of counts. Where 64 bits would not hold the product, whole numbers of any size do."""
    if not len(n) or int(n.max()) + PRIOR < 2**63 // SCALE:
        return 1 + SCALE * (n + PRIOR) // max(total, 1)
    return np.array([1 + SCALE * (int(k) + PRIOR) // total for k in n], np.int64)


def groups_of(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Every (lang, source) that occurs, with ``total`` = its kept terms' occurrences + PRIOR * V, and of its language
    ``lang_total``, ``kept`` (V) and ``sources``. One row a group."""
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("kept"))
    both = every.join(own, ["lang", "source"], "left").na.fill(0, ["total", "kept"])
    lang = Window.partitionBy("lang")
    v = F.sum("kept").over(lang)
    return both.select(
        "lang", "source", (F.col("total") + PRIOR * v).alias("total"), (F.sum("total").over(lang) + PRIOR * v).alias("lang_total"), v.alias("kept"), F.count("*").over(lang).alias("sources")
    )


def term_ranks(counts: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """Per group its kept terms with p > q: lang, source, item, value, rank up to ``top``.

    Terms with equal counts in the group and in the language are one cell, and have one value. Cells of equal value are
    merged to levels, whose ranks follow from the multiplicities before them; only levels that start within ``top``
    are expanded to terms, in UTF-8 order. A level of any size hands on at most ``top`` terms a task."""
    cells = counts.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("many")).join(small_side(groups), ["lang", "source"])
    valued = cells.withColumn("value", share(F.col("n"), F.col("total")) - share(F.col("lang_n"), F.col("lang_total"))).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    levels = valued.groupBy("lang", "source", "value").agg(F.sum("many").alias("many")).withColumn("_level", F.row_number().over(order)).where(F.col("_level") <= top)
    before = F.coalesce(F.sum("many").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = levels.withColumn("before", before).where(F.col("before") < top).select("lang", "source", "value", "before")
    shown = stored(valued.join(levels, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value", "before"), "cells")
    terms = counts.join(small_side(shown), ["lang", "source", "n", "lang_n"])
    within = Window.partitionBy("lang", "source", "value").orderBy("term")
    placed = terms.withColumn("_place", F.row_number().over(within)).where(F.col("_place") <= top)
    ranked = placed.withColumn("rank", (F.col("before") + F.col("_place")).cast("int")).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.col("term").alias("item"), "value", "rank")


def cell_sum(a: np.ndarray, a_total: int, b: np.ndarray, b_total: int) -> int:
    """Sum of abs(p - q) over terms with the counts ``a`` and ``b``: once per cell of equal counts, times its terms."""
    some, i = np.unique(a, return_inverse=True)
    other, j = np.unique(b, return_inverse=True)
    cells, many = np.unique(i * len(other) + j, return_counts=True)
    p, q = shares(some, a_total), shares(other, b_total)
    return int((np.abs(p[cells // len(other)] - q[cells % len(other)]) * many).sum()) if len(cells) else 0


def _pair_sums(counts: pa.Table, groups: pa.Table) -> pa.Table:
    """One bucket of terms of a language, and all its groups -> a part of the sum for each pair of sources."""
    names, totals = groups.column("source").to_pylist(), groups.column("total").to_pylist()
    place = {s: i for i, s in enumerate(names)}
    terms = counts.column("term").combine_chunks().dictionary_encode()
    matrix = np.zeros((len(names), len(terms.dictionary)), np.int64)
    rows = np.array([place[s] for s in counts.column("source").to_pylist()], np.int64)
    matrix[rows, terms.indices.to_numpy()] = counts.column("n").to_numpy()
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    values = [cell_sum(matrix[i], totals[i], matrix[j], totals[j]) for i, j in pairs]
    lang = groups.column("lang")[0].as_py()
    columns = ([lang] * len(pairs), [names[i] for i, _ in pairs], [names[j] for _, j in pairs], values)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "item", "value"])


def pair_ranks(counts: DataFrame, groups: DataFrame, cells: int = CELLS) -> DataFrame:
    """Per group every other source of its language: lang, source, item, value (over all kept terms), rank. The terms
    of a language are dealt to buckets whose matrix of terms by sources has about ``cells`` numbers."""
    buckets = F.greatest(F.lit(1), F.ceil(F.col("kept") * F.col("sources") / cells)).cast("long")
    sized = groups.select("lang", "source", "total", buckets.alias("_buckets"))
    right = sized.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_buckets") - 1)))
    langs = sized.groupBy("lang").agg(F.max("_buckets").alias("_buckets"))
    left = counts.join(small_side(langs), "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("_buckets")))
    left, right = left.select("lang", "bucket", "source", "term", "n"), right.select("lang", "bucket", "source", "total")
    parts = left.groupBy("lang", "bucket").cogroup(right.groupBy("lang", "bucket")).applyInArrow(_pair_sums, "lang string, source string, item string, value long")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    one = lambda a, b: F.struct("lang", F.col(a).alias("source"), F.col(b).alias("item"), "value")
    both = sums.select(F.inline(F.array(one("source", "item"), one("item", "source"))))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of both parts. Nulls in text, lang and source are ''; every row is a
    document, repeated ids and rows included. A language without kept terms has pairs of value 0 and no terms; equal
    values are ordered by item. Other columns of ``docs`` are not looked at; an empty table gives no rows."""
    counts = stored(term_counts(docs, least), "counts")
    groups = stored(groups_of(docs, counts), "groups")
    parts = [f(counts, groups).withColumn("part", F.lit(part)) for f, part in ((pair_ranks, "pair"), (lambda c, g: term_ranks(c, g, top), "term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


# The same rows by plain joins of every group with every kept term.
OP11_SQL = f"""
WITH words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
  )
),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST_DOCS}),
groups AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
seen AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
filled AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(s.n, 0) AS n
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term
),
shared AS (
  SELECT lang, source, term, n,
         1 + ({SCALE}::HUGEINT * (n + {PRIOR})) // (sum(n) OVER g + {PRIOR} * count(*) OVER g) AS p,
         1 + ({SCALE}::HUGEINT * (lang_n + {PRIOR})) // (sum(lang_n) OVER g + {PRIOR} * count(*) OVER g) AS q
  FROM filled WINDOW g AS (PARTITION BY lang, source)
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM shared x JOIN shared y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank
  FROM shared WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
