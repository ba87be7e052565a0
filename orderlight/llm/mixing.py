"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlight.llm.base import as_bytes, table
from orderlight.operators.ordering import global_rank
from orderlight.session import small_side, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2.0  # times a source's own words
BLOCK = 4096  # documents that one flight takes


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null: 0."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(t.split())).astype("int64")

    return of(as_bytes(text))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size) rows -> (source, source_size, target): sources in code point order, null last, weigh
    ``weights`` in turn and share ``share`` times all sizes; none gets over ``most`` times its own size, and what
    is left over goes to the others by weight until none is above."""
    sums = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stored(global_rank(sums, ["source"]).withColumn("w", F.get(turn, (F.col("rank") % len(weights)).cast("int"))), "sources")
    limit = F.col("source_size") * most
    words, level = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    level, capped = (share * words / level if words else 0.0), -1
    while True:
        full = F.col("w") * level > limit
        n, held, free = ranked.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        capped, level = n, (share * words - held) / free
    return ranked.select("source", "source_size", F.least(F.col("w") * level, limit).alias("target"))


def flight(sizes: list[int], probs: list[float], rng: random.Random) -> list[float]:
    """Moves the probabilities along directions that keep the sum of probabilities and of sizes, until at most two
    are not 0 or 1. Three units at a time have a direction in closed form."""
    probs, held = list(probs), []
    for k in range(len(probs)):
        if 0.0 < probs[k] < 1.0:
            held.append(k)
        while len(held) == 3:
            a, b, c = (sizes[i] for i in held)
            way = (b - c, c - a, a - b) if (a - b or b - c) else (1, -1, 0)
            moves = [(probs[i], d) for i, d in zip(held, way) if d]
            up = min((1 - p) / d if d > 0 else p / -d for p, d in moves)
            down = min(p / d if d > 0 else (1 - p) / -d for p, d in moves)
            step = up if rng.random() * (up + down) < down else -down
            for i, d in zip(held, way):
                p = probs[i] + step * d
                probs[i] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
            held = [i for i in held if 0.0 < probs[i] < 1.0]
    return probs


def landing(sizes: list[int], probs: list[float]) -> list[float]:
    """Settles the few open units: of all ways to round them, the one whose size is nearest to the expected; the
    first of equal ones. Only ever given what a flight leaves over, two units at most."""
    left = [i for i, p in enumerate(probs) if 0.0 < p < 1.0]
    goal = sum(probs[i] * sizes[i] for i in left)
    best = min(range(2 ** len(left)), key=lambda m: (abs(sum(sizes[i] for j, i in enumerate(left) if m >> j & 1) - goal), m))
    out = list(probs)
    for j, i in enumerate(left):
        out[i] = float(best >> j & 1)
    return out


def mixed(rows: DataFrame, seed: int = 42, block: int = BLOCK, **shares) -> DataFrame:
    """``rows`` (doc_id, source, size, key) with source_size, target and ``copies``: how often the mix takes the row.

    A source's ratio of target to size is the expected number of copies of each of its documents: the whole part is
    taken, the rest is an inclusion probability, which flights over blocks of at most about ``block`` documents drive
    to 0 or 1 while the block's words and documents stay as expected. The open units of all blocks, two a block, fly
    again until one block is left a source, which lands. Blocks follow a hash of ``key``, so a source of any size is
    spread, and reruns agree; equal rows are interchangeable. Empty documents are never taken. Null sources are one
    source. An empty table gives none.
    """
    rows = stored(rows.select("doc_id", "source", "size", "key"), "sizes")
    goals = stored(targets(rows, **shares), "targets").withColumnRenamed("source", "_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-9)
    planned = rows.join(small_side(goals), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    planned = planned.withColumn("copies", F.when(F.col("size") > 0, whole).otherwise(0).cast("int"))
    planned = planned.withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), ratio - whole)).otherwise(0.0))
    planned = stored(planned.withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p"))), "plan")
    schema = planned.schema

    def fly(one: pa.Table) -> pa.Table:
        data = one.to_pydict()
        order = sorted(range(len(data["key"])), key=lambda i: (-data["size"][i], data["key"][i]))
        sizes = [data["size"][i] for i in order]
        rng = random.Random(f"{seed} {data['source'][0]!r} {data['_block'][0]} {data['_blocks'][0]} {len(order)}")
        probs = flight(sizes, [data["p"][i] for i in order], rng)
        if data["_blocks"][0] == 1:
            probs = landing(sizes, probs)
        out = dict(zip(order, probs))
        one = one.set_column(one.schema.get_field_index("p"), "p", pa.array([out[i] for i in range(len(order))], pa.float64()))
        return one.drop_columns(["_block", "_blocks"])

    done, still = planned.where("p = 0 or p = 1"), planned.where("p > 0 and p < 1")
    for turn in range(64):
        sizes = still.groupBy(F.col("source").alias("_source")).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_blocks"))
        sizes = stored(sizes, "blocks")
        most = sizes.agg(F.max("_blocks")).first()[0]
        if not most:
            break
        dealt = still.join(small_side(sizes), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("key", F.lit(turn)), F.col("_blocks")))
        flown = stored(dealt.groupBy("source", "_block").applyInArrow(fly, schema), "flown")
        done = done.unionByName(flown.where("p = 0 or p = 1"))
        still = flown.where("p > 0 and p < 1")
        if most == 1:
            break
    return done.withColumn("copies", F.col("copies") + F.col("p").cast("int")).drop("p")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "source").alias("key"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed(rows).select("doc_id", "size", "source_size", "target", taken, "source", "copies")
