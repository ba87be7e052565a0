"""What several operators share: tables, sizing, words and shingles."""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space; bytes.split() uses the same set.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(docs: DataFrame, text: str, mb: float, least: int = 16) -> int:
    """How many parts of about ``mb`` megabytes the texts fill: follows the input, so a part stays bounded."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(least, math.ceil(size / (mb * 1e6)))


def smallest_hashes(df: DataFrame, by: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows with the smallest ``by`` (an even hash). A cut that keeps half as many more again comes
    first, so tasks hand on few rows however large the table is; the result is a sample, so a cut that happens to
    keep fewer is good enough."""
    n = df.count()
    if n > 2 * rows:
        df = df.where(by < int(-(2**63) + 1.5 * rows / n * 2**64))
    return df.orderBy(by).limit(rows)


def as_bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def shingle_hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words joined by one space, repeats included. Fewer words:
    the whole sequence is one shingle; no words: none."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(words) - width + 1)]
    ends = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())]
    return np.array(found, np.uint64)
