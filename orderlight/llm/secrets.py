"""Secrets by fixed patterns and by character Markov models. Column functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlight.llm.base import smallest_hashes, table
from orderlight.session import stored

# Kind, pattern, and what a match needs. Runs of a fixed class are asked for at their least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"  # what the models judge
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_-]{5,}"  # ordinary samples
SAMPLE = 4000  # documents that the models are trained on, at most
LOT = 128  # matches that are placed together
LEAST = 0.5  # mean log-likelihood ratio per pair of characters, from which a token is a secret

_SPAN = "array<struct<start:int,rank:int,end:int,hit:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` reads it in a loop."""
    return F.transform(F.array(value), use)[0]


def spans_of(text: Column, pattern: str, rank: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, rank, end, hit) in code points. The texts between the
    matches and the matches add up to the whole, which gives the places: first where each lot of LOT matches starts,
    then inside the lots, so that no long list is copied once a match."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"))
    none = F.expr(f"cast(array() as {_SPAN})")
    size = lambda x: F.length(x["p"]) + F.coalesce(F.length(x["h"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["h"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["h"].alias("hit"))
        return F.struct(end.alias("at"), F.when(x["h"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    def lots(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / LOT).cast("int")), lambda k: F.slice(p, k * LOT + 1, F.lit(LOT)))

    def starts(some: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all"))
        more = lambda acc, lot: F.struct((acc["at"] + F.aggregate(lot, F.lit(0), lambda t, x: t + size(x))).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
        return F.aggregate(some, begin, more, lambda acc: acc["all"])

    def inside(lot: Column, start: Column) -> Column:
        return F.aggregate(lot, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    found = _let(pieces, lambda p: _let(lots(p), lambda some: F.flatten(F.zip_with(some, starts(some), inside))))
    return F.when(text.rlike(pattern), found).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, in no order."""
    assign = F.filter(spans_of(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 8)
    return F.concat(assign, spans_of(text, ACCESS, 1), spans_of(text, HEX, 2))


def _secret(span: Column) -> Column:
    return F.when(span["rank"] == 0, F.regexp_extract(span["hit"], ASSIGN, 2)).otherwise(span["hit"])


def train(docs: DataFrame, documents: int = SAMPLE, prior: float = 0.5) -> str:
    """Log-likelihood ratios of character pairs, random over ordinary, as the 128 x 128 numbers of a comma-joined
    string. The labels are the fixed patterns: their values are samples of random strings, identifiers outside
    them ordinary ones, from the ``documents`` with the smallest hashes, equal texts once. Each model is a
    first-order chain over the characters seen, smoothed by ``prior``; without any random sample the random model
    is uniform. Only hashes meet in one task; the chosen texts, of any length, stay spread."""
    hashed = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    cut = smallest_hashes(hashed.select("h"), F.col("h"), documents).agg(F.max("h")).first()[0]
    sample = stored(hashed.where(F.col("h") <= F.lit(cut).cast("long")).groupBy("h").agg(F.min("text").alias("text")), "sample")
    found = sample.select("text", base_spans(F.col("text")).alias("spans"))
    random = found.select(F.explode("spans").alias("s")).select(F.lit(1).alias("kind"), _secret(F.col("s")).alias("t"))
    words = F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))
    plain = found.where(F.size("spans") == 0).select(F.lit(0).alias("kind"), F.explode(words).alias("t"))
    pairs = random.unionByName(plain).where(F.length("t") > 1).select("kind", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring(F.col("t"), i, F.lit(2)))).alias("pair"))
    # At most 2 x 128 x 128 rows: pairs of ASCII characters.
    counts = pairs.groupBy("kind", "pair").count().collect()
    letters = sorted({c for r in counts for c in r.pair})
    models = []
    for kind in (0, 1):
        seen = {r.pair: r["count"] for r in counts if r.kind == kind}
        total = {a: sum(seen.get(a + b, 0) + prior for b in letters) for a in letters}
        models.append({a + b: math.log((seen.get(a + b, 0) + prior) / total[a]) for a in letters for b in letters})
    ratio = {(ord(p[0]), ord(p[1])): models[1][p] - models[0][p] for p in models[0]}
    return ",".join(f"{ratio.get((a, b), 0.0):.3f}" for a in range(128) for b in range(128))


def likelihood(token: Column, ratios: str) -> Column:
    """Mean log-likelihood ratio over the pairs of a token of ASCII characters, in one walk."""
    grid = F.split(F.lit(ratios), ",").cast("array<double>")

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        more = F.when(acc["before"] >= 0, F.get(grid, acc["before"] * 128 + code)).otherwise(0.0)
        return F.struct(code.alias("before"), (acc["sum"] + more).alias("sum"))

    total = F.aggregate(F.split(token, ""), F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])
    return total / (F.length(token) - 1)


def all_spans(text: Column, ratios: str, least: float = LEAST) -> Column:
    """Base spans and the models' spans that overlap none of them, by start, then kind."""
    long = F.filter(spans_of(text, TOKEN, 3), lambda s: likelihood(s["hit"], ratios) >= least)
    apart = lambda base, s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return _let(base_spans(text), lambda base: F.array_sort(F.concat(base, F.filter(long, lambda s: apart(base, s)))))


def scan(docs: DataFrame, ratios: str | None = None, least: float = LEAST, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with a column ``out``: array of (start, rank, end, hit), sorted; rank is the place of the kind in
    KINDS. A null text has no spans. Every row keeps its columns, but one named ``out`` is replaced; an empty table
    stays empty."""
    ratios = ratios if ratios is not None else train(docs.select(F.col(text).alias("text")))
    return docs.withColumn(out, all_spans(F.coalesce(F.col(text), F.lit("")), ratios, least))


def joined(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every run of overlapping spans replaced by ``mark``; ``spans`` sorted by start."""
    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
