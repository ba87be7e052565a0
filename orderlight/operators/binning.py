"""Counts of values between many edges, in one narrow pass.

Spark SQL has no binary search over a literal array, so the lookup runs on Arrow batches with
numpy. Each task returns only its counts (bounded by the number of edges), which Spark adds up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _numbers(batch: pa.RecordBatch, i: int) -> np.ndarray:
    v = batch.column(i).to_numpy(zero_copy_only=False)
    return v[~np.isnan(v)]


def cell_counts(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(feature, cell, n): cell 2i holds the values between edge i-1 and edge i, cell 2i+1 the
    values equal to edge i. Missing values are not counted."""
    columns = list(edges)
    sorted_edges = [np.asarray(edges[c], dtype=float) for c in columns]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(2 * len(e) + 1, dtype=np.int64) for e in sorted_edges]
        for batch in batches:
            for i, e in enumerate(sorted_edges):
                v = _numbers(batch, i)
                cell = np.searchsorted(e, v, "left") + np.searchsorted(e, v, "right")
                totals[i] += np.bincount(cell, minlength=len(totals[i]))
        for name, t in zip(columns, totals):
            used = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(t[used], pa.int64())],
                names=["feature", "cell", "n"],
            )

    narrow = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    return (
        narrow.mapInArrow(count, "feature STRING, cell BIGINT, n BIGINT")
        .groupBy("feature", "cell").agg(F.sum("n").alias("n"))
    )


def values_between(df: DataFrame, spans: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """(span, v): the values strictly inside each (column, low, high) span."""
    columns = list(dict.fromkeys(c for c, _, _ in spans))
    place = [columns.index(c) for c, _, _ in spans]
    lows = [-np.inf if low is None else low for _, low, _ in spans]
    highs = [np.inf if high is None else high for _, _, high in spans]
    open_low, open_high = [s[1] is None for s in spans], [s[2] is None for s in spans]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_numbers(batch, i) for i in range(len(columns))]
            for s in range(len(spans)):
                v = values[place[s]]
                keep = np.ones(len(v), dtype=bool)
                if not open_low[s]:
                    keep &= v > lows[s]
                if not open_high[s]:
                    keep &= v < highs[s]
                v = v[keep]
                if len(v):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(v), s), pa.int32()), pa.array(v, pa.float64())], names=["span", "v"])

    narrow = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    return narrow.mapInArrow(pick, "span INT, v DOUBLE")
