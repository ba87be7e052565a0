"""SimHash near-duplicates, with candidates found by the pigeonring rule."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlight.llm.base import as_bytes, shingle_hashes, table
from orderlight.llm.components import connected, forest
from orderlight.session import small_side, stored

# Five segments on a ring, 64 bits together: (first bit, width).
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
DISTANCE = 4
HOT = 4096  # rows of one key that a task compares with each other


def simhash(text: bytes, width: int, seed: int) -> int:
    """64-bit fingerprint of lower-cased words: a bit is set if it is in over half of the shingle hashes."""
    hashes = shingle_hashes(text.lower().split(), width, seed)
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def simhash_column(text: Column, width: int = 5, seed: int = 42) -> Column:
    """The fingerprint as a long (the 64 bits, signed). Null counts as empty; no words: 0."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        found = np.array([simhash(bytes(t), width, seed) for t in texts], np.uint64)
        return pd.Series(found.view(np.int64))

    return of(as_bytes(text))


def chained(diff: np.ndarray, start: int, distance: int = DISTANCE) -> np.ndarray:
    """Whether the segments from ``start`` on around the ring stay within their shares of the distance,
    for every length of the chain; the whole ring is the full Hamming check."""
    total, ok = np.zeros(len(diff), np.int64), np.ones(len(diff), bool)
    for n in range(1, len(SEGMENTS) + 1):
        low, bits = SEGMENTS[(start + n - 1) % len(SEGMENTS)]
        total += np.bitwise_count((diff >> np.uint64(low)) & np.uint64(2**bits - 1))
        ok &= total * len(SEGMENTS) <= n * distance
    return ok


def _keys() -> Column:
    """A pair within four bits has a chain that starts with an equal segment and has at most one bit in the
    next, so also one half of the next equal: five segments times two halves."""
    of = lambda low, bits: F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(2**bits - 1))
    keys = []
    for i, (low, bits) in enumerate(SEGMENTS):
        after, wide = SEGMENTS[(i + 1) % len(SEGMENTS)]
        for half, (a, n) in enumerate(((after, wide // 2), (after + wide // 2, wide - wide // 2))):
            mark = F.lit(i * 2 + half).cast("long")
            keys.append((mark * 2**13 + of(low, bits)) * 2**13 + of(a, n))
    return F.array(*keys)


def _pairs_of_runs(key: np.ndarray, fp: np.ndarray):
    """Positions (i, j) of rows with equal keys whose chain holds; ``key`` is sorted."""
    at, step = np.arange(len(key)), 0
    start = (key >> 27).astype(np.int64)
    while True:
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            return
        for s in range(len(SEGMENTS)):
            some = at[start[at] == s]
            hit = some[chained(fp[some] ^ fp[some + step], s)]
            if len(hit):
                yield hit, hit + step


def _linked(batches):
    """Rows (key, cell, role, fp) of whole keys -> a spanning forest of the links among their fingerprints."""
    rows = [pa.Table.from_batches([b]) for b in batches]
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    if not rows:
        return
    rows = pa.concat_tables(rows)
    key, cell, role, fp = (rows.column(c).to_numpy() for c in ("key", "cell", "role", "fp"))
    ids, fp = fp, fp.view(np.uint64)
    nodes, place = np.unique(ids, return_inverse=True)
    root = np.arange(len(nodes))

    def joined(left, right):
        nonlocal root
        again = forest(len(nodes), np.concatenate([place[left], np.arange(len(nodes))]), np.concatenate([place[right], root]))
        root = again

    plain = np.flatnonzero(role == 2)
    plain = plain[np.argsort(key[plain], kind="stable")]
    for i, j in _pairs_of_runs(key[plain], fp[plain]):
        joined(plain[i], plain[j])
    hot = np.flatnonzero(role < 2)
    hot = hot[np.lexsort((cell[hot], key[hot]))]
    edges = np.flatnonzero(np.diff(key[hot]) | np.diff(cell[hot])) + 1
    for group in np.split(hot, edges) if len(hot) else []:
        one, two = group[role[group] == 0], group[role[group] == 1]
        for x in one:
            near = two[chained(fp[two] ^ fp[x], int(key[x] >> 27))]
            if len(near):
                joined(np.full(len(near), x), near)
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], schema=out)


def linked(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) that join all fingerprints of ``prints`` (fp: distinct longs) within four bits of each
    other, directly or through others.

    Ten keys a fingerprint bring candidates together. A key with more than ``hot`` fingerprints is dealt out
    as a grid of blocks, so no task compares more than ``hot`` times ``hot`` rows of one key and none is left out.
    """
    rows = stored(prints.select("fp", F.explode(_keys()).alias("key")), "keys")
    many = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    many = stored(many.select(F.col("key").alias("_key"), F.ceil(F.col("n") / hot).cast("int").alias("_cut")), "hot")
    rows = rows.join(small_side(many), F.col("key") == F.col("_key"), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("_cut")).cast("int")
    across = F.transform(F.sequence(F.lit(0), F.col("_cut") - 1), lambda j: F.struct((own * F.col("_cut") + j).alias("cell"), F.lit(0).alias("role")))
    down = F.transform(F.sequence(F.lit(0), F.col("_cut") - 1), lambda i: F.struct((i * F.col("_cut") + own).alias("cell"), F.lit(1).alias("role")))
    once = F.array(F.struct(F.lit(0).alias("cell"), F.lit(2).alias("role")))
    rows = rows.select("key", "fp", F.inline(F.when(F.col("_key").isNull(), once).otherwise(F.concat(across, down))))
    parts = max(16, -(-rows.count() // 150_000))
    dealt = rows.repartition(parts, "key", "cell").select("key", F.col("cell").cast("long").alias("cell"), "role", "fp")
    return dealt.mapInArrow(_linked, "a long, b long")


def classes(prints: DataFrame) -> DataFrame:
    """Rows with (doc_id, fp) -> the same with ``component_id``: the smallest doc_id reachable by links of at
    most four bits. Equal fingerprints are one node, so copies of any number cost one row; a null doc_id
    belongs to its class but never names it (a class without any id is null)."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    groups = connected(linked(distinct)).select(F.col("node").alias("fp"), F.col("component").alias("_group"))
    placed = distinct.join(groups, "fp", "left").withColumn("_group", F.coalesce("_group", "fp"))
    least = placed.groupBy("_group").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "_group").join(least, "_group").select("fp", "component_id")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, width: int = 5, seed: int = 42) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (long) and component_id. Null text counts as empty; texts without words
    share fingerprint 0 and are linked like any other; an empty table gives none."""
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), simhash_column(F.col("text"), width, seed).alias("fp"))
    return classes(stored(prints, "simhash"))


def first_of_each(docs: DataFrame, width: int = 5, seed: int = 42) -> DataFrame:
    """One row of ``docs``, all its columns, of each class: the one with the smallest doc_id (null last), then the
    smallest hash of the whole row. Rows equal in every column count once. Only fingerprints and the names of rows
    (doc_id and hash) are stored; the wide rows meet the names of the winners once."""
    own = docs.columns
    named = docs.toDF(*[f"c{i}" for i in range(len(own))])
    doc_id, text = (F.col(f"c{own.index(n)}") for n in ("doc_id", "text"))
    name = {"_null": doc_id.isNull(), "_id": F.coalesce(doc_id.cast("long"), F.lit(0)), "_hash": F.xxhash64(*[F.col(f"c{i}") for i in range(len(own))])}
    rank = F.struct(*[c.alias(k) for k, c in name.items()])
    prints = stored(named.select(simhash_column(text, width, seed).alias("fp"), rank.alias("r")), "simhash")
    distinct = stored(prints.groupBy("fp").agg(F.min("r").alias("r")), "prints")
    groups = connected(linked(distinct)).select(F.col("node").alias("fp"), F.col("component").alias("_group"))
    placed = distinct.join(groups, "fp", "left").withColumn("_group", F.coalesce("_group", "fp"))
    best = placed.groupBy("_group").agg(F.min("r").alias("b")).select("b.*")
    kept = named.withColumns(name).join(best, list(name), "left_semi").dropDuplicates(list(name))
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(own)])


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
