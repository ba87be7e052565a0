"""Best-fit packing of documents into bins under conflicts."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlight.llm.base import table
from orderlight.llm.mixing import word_count
from orderlight.session import stored

CAPACITY = 2048  # words in a bin
PER_SOURCE = 4  # documents of one source in a bin, at most
SHARD = 4096  # rows that one task packs together

RESULT = "rid long, piece int, start long, size long, bin_id long, bin_words long"


class Bins:
    """Open bins ordered by their residual: a bitmap of the residuals that occur gives the successor of a size.

    A bin carries a bitmap of its duplicate clusters and, for each count up to the limit, a bitmap of the sources
    that it holds so often."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.present = 0
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.fill: list[int] = []

    def _put(self, b: int) -> None:
        r = self.capacity - self.fill[b]
        self.at[r].append(b)
        self.present |= 1 << r

    def place(self, size: int, cluster: int, source: int) -> int:
        """The tightest bin that fits and holds neither the cluster's bit nor the source too often; else a new one."""
        left = self.present >> size << size
        while left:
            r = (left & -left).bit_length() - 1
            for k, b in enumerate(self.at[r]):
                if not self.clusters[b] & cluster and not self.sources[b][-1] & source:
                    self.at[r].pop(k)
                    if not self.at[r]:
                        self.present &= ~(1 << r)
                    self._add(b, size, cluster, source)
                    return b
            left &= left - 1
        self.clusters.append(0)
        self.sources.append([0] * self.per_source)
        self.fill.append(0)
        self._add(len(self.fill) - 1, size, cluster, source)
        return len(self.fill) - 1

    def _add(self, b: int, size: int, cluster: int, source: int) -> None:
        self.clusters[b] |= cluster
        levels = self.sources[b]
        for k, held in enumerate(levels):
            if not held & source:
                levels[k] |= source
                break
        self.fill[b] += size
        self._put(b)


def packed(items: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD) -> DataFrame:
    """``items`` (rid: unique long, size, source, cluster: long) -> one row per piece: rid, piece, start, size, bin_id
    and the bin's words.

    A document longer than a bin fills bins of its own with whole pieces; the rest is packed, largest first, into the
    tightest bin that has room, no other document of its cluster and fewer than ``per_source`` of its source. Null
    sources are one source, a null cluster conflicts with nothing. Documents without words take no room but obey the
    conflicts. Rows are dealt to shards of about ``shard`` rows by a hash of rid, so a hot source or cluster is spread;
    only the last bins of a shard stay unfilled.
    """
    shards = max(1, -(-items.count() // shard))
    schema = pa.schema([("rid", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("size", pa.int64()), ("bin_id", pa.int64()), ("bin_words", pa.int64())])

    def pack(one: pa.Table) -> pa.Table:
        data = one.to_pydict()
        n = len(data["rid"])
        seen = Counter(c for c in data["cluster"] if c is not None)
        cluster_bit = {c: 1 << i for i, c in enumerate(sorted(c for c, k in seen.items() if k > 1))}
        source_bit = {s: 1 << i for i, s in enumerate(sorted(set(data["source"]), key=lambda s: (s is None, s or "")))}
        bins, out, first = Bins(capacity, per_source), [], data["_shard"][0] << 32
        full = 0
        for i in sorted(range(n), key=lambda i: (-(data["size"][i] % capacity), data["rid"][i])):
            size, rid = data["size"][i], data["rid"][i]
            whole, rest = divmod(size, capacity)
            for piece in range(whole):
                full += 1
                out.append((rid, piece, piece * capacity, capacity, first + 2**31 + full, capacity))
            if rest or not whole:
                b = bins.place(rest, cluster_bit.get(data["cluster"][i], 0), source_bit[data["source"][i]])
                out.append((rid, whole, whole * capacity, rest, b, None))
        rows = [(*r[:4], first + r[4], bins.fill[r[4]]) if r[5] is None else r for r in out]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    dealt = items.select("rid", "size", "source", "cluster", F.pmod(F.xxhash64("rid"), F.lit(shards)).alias("_shard"))
    return dealt.groupBy("_shard").applyInArrow(pack, RESULT)


def pack_documents(docs: DataFrame, cluster, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, source) -> doc_id, source, piece, start, size, bin_id, bin_words. ``cluster``: a
    column of longs that duplicates share."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), cluster.alias("cluster"))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "items")
    return rows.drop("size").join(packed(rows, capacity, per_source), "rid").select("doc_id", "source", "piece", "start", "size", "bin_id", "bin_words")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All documents; texts that are equal are one cluster."""
    return pack_documents(table(spark, sf_dir, "documents"), F.xxhash64(F.coalesce("text", F.lit(""))))
