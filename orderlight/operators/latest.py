"""Newest row per key as an aggregate: partial results combine before the shuffle, so a key
that holds a large share of the rows costs one row per map task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], time: str, *ties: str) -> DataFrame:
    """Last row per key by (time, ties). A missing time sorts last, as in a stable ascending
    sort that keeps the final row."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(time).isNull().alias("n"), F.col(time).alias("t"), *[F.col(t) for t in ties])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("_last"))
        .select(*keys, *[F.col(f"_last.`{c}`").alias(c) for c in rest])
        .select(*df.columns)
    )


def newest(df: DataFrame, n: int, time: str, *ties: str) -> DataFrame:
    """Top ``n`` rows by time, newest first."""
    return df.orderBy(F.col(time).desc_nulls_last(), *[F.col(t).desc() for t in ties]).limit(n)
