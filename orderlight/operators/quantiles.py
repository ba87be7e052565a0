"""Exact order statistics and linear-interpolated quantiles of very large columns.

Spark's ``percentile`` keeps every distinct value of a group in one task. Here each wanted
position is bracketed instead: a sketch proposes two data values around it, one counting pass
proves how many rows lie below and between, and the bracket shrinks until the values left
inside fit a small array. Passes are narrow scans with bounded aggregates; nothing is sorted
or shuffled.

The first sketch is a mergeable one (KLL) that also counts the values. ``quantile_sketches`` keeps it
with a table; ``merged_sketches`` combines those of several tables or parts. With kept sketches no
scan is needed to size and bracket the columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlight.operators.binning import cell_counts, values_between

# Values of one bracket that may be gathered into an array.
BRACKET_ROWS = 100_000
_SKETCH_ACCURACY = 10_000
# Size of a kept sketch, and the rank error it is trusted with; a larger error only costs one more pass.
KLL_SIZE = 4096
_KLL_MARGIN = 0.002
SKETCH_SCHEMA = "feature STRING, n BIGINT, sketch BINARY"


@dataclass
class _Bracket:
    """Open interval (low, high) known to contain the wanted position."""

    column: str
    position: int
    low: float | None
    high: float | None
    below: int
    inside: int
    value: float | None = None

    @property
    def span(self) -> tuple[str, float | None, float | None]:
        return self.column, self.low, self.high

    def narrow(self, edge: float, lt: int, le: int) -> None:
        """Use one proven edge: ``lt`` values lie below it, ``le`` at or below it."""
        end = self.below + self.inside
        if lt <= self.position < le:
            self.value = edge
        elif le <= self.position and le > self.below:
            self.low, self.below, self.inside = edge, le, end - le
        elif self.position < lt < end:
            self.high, self.inside = edge, lt - self.below


def _number(name: str) -> Column:
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


def _proposed_edges(df: DataFrame, wide: list[_Bracket]) -> dict[str, list[float]]:
    """Data values around the wanted positions: one sketch per distinct bracket."""
    margin = 2.0 / _SKETCH_ACCURACY
    spans: dict[tuple, list[float]] = {}
    for b in wide:
        q = (b.position - b.below + 0.5) / b.inside
        spans.setdefault(b.span, []).extend([max(0.0, q - margin), min(1.0, q + margin)])
    sketches = []
    for (column, low, high), points in spans.items():
        v = _number(column)
        keep = v.isNotNull()
        if low is not None:
            keep = keep & (v > F.lit(low))
        if high is not None:
            keep = keep & (v < F.lit(high))
        sketches.append(F.percentile_approx(F.when(keep, v), points, _SKETCH_ACCURACY).alias(f"s{len(sketches)}"))
    found = df.agg(*sketches).first()
    edges: dict[str, set[float]] = {}
    for (column, _, _), values in zip(spans, found):
        edges.setdefault(column, set()).update(values)
    return {c: sorted(e) for c, e in edges.items()}


def _proven_counts(df: DataFrame, edges: dict[str, list[float]]) -> dict[str, list[tuple[float, int, int]]]:
    """(edge, values below it, values at or below it) per column."""
    cells: dict[str, dict[int, int]] = {}
    for r in cell_counts(df, edges).collect():
        cells.setdefault(r["feature"], {})[r["cell"]] = r["n"]
    out = {}
    for column, e in edges.items():
        seen, running = cells.get(column, {}), 0
        out[column] = []
        for i, edge in enumerate(e):
            lt = running + seen.get(2 * i, 0)
            running = lt + seen.get(2 * i + 1, 0)
            out[column].append((edge, lt, running))
    return out


def order_statistics(
    df: DataFrame, wanted: dict[str, list[int]], counts: dict[str, int], bracket_rows: int = BRACKET_ROWS,
    proposed: dict[str, list[float]] | None = None,
) -> dict[tuple[str, int], float]:
    """Values at 0-based positions of the sorted non-missing values of each column. A final bracket
    gathers at most ``bracket_rows`` values in a task; the driver gets edges and counts, and then only
    the wanted values. ``proposed`` are sorted values to try as the first edges."""
    brackets = [
        _Bracket(c, k, None, None, 0, counts[c]) for c, ks in wanted.items() for k in sorted(set(ks))
    ]
    while wide := [b for b in brackets if b.value is None and b.inside > bracket_rows]:
        first = {b.column: proposed[b.column] for b in wide if b.column in proposed} if proposed else {}
        proven = _proven_counts(df, first or _proposed_edges(df, wide))
        proposed = None
        for b in wide:
            for edge, lt, le in proven.get(b.column, []):
                b.narrow(edge, lt, le)
                if b.value is not None:
                    break
    if open_ := [b for b in brackets if b.value is None]:
        # Positions of one column that share a bracket share its array.
        spans = list(dict.fromkeys(b.span for b in open_))
        places = {s: sorted({b.position - b.below for b in open_ if b.span == s}) for s in spans}
        wants = F.get(F.array(*[F.array(*[F.lit(k) for k in places[s]]) for s in spans]), F.col("span"))
        sorted_values = values_between(df, spans).groupBy("span").agg(F.sort_array(F.collect_list("v")).alias("vs"))
        picked = sorted_values.select("span", F.transform(wants, lambda k: F.get("vs", k)).alias("picked")).collect()
        found = {spans[r["span"]]: dict(zip(places[spans[r["span"]]], r["picked"])) for r in picked}
        for b in open_:
            b.value = found[b.span][b.position - b.below]
    return {(b.column, b.position): b.value for b in brackets}


def quantile_sketches(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, sketch) in one narrow scan: how many values a column has, and their sketch (null
    without values). To be kept beside a table or a part of one."""
    one = df.agg(*[F.count(_number(c)).alias(f"n{i}") for i, c in enumerate(columns)], *[
        F.kll_sketch_agg_double(_number(c), F.lit(KLL_SIZE)).alias(f"s{i}") for i, c in enumerate(columns)])
    cells = [F.struct(
        F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.when(F.col(f"n{i}") > 0, F.col(f"s{i}")).alias("sketch"))
        for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*cells)))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of several tables or parts as those of their union: (feature, n, sketch)."""
    merged = sketches.groupBy("feature").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double(F.col("sketch"), F.lit(KLL_SIZE)).alias("sketch"))
    return merged.withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], bracket_rows: int = BRACKET_ROWS,
    sketches: DataFrame | None = None,
) -> dict[str, list[float] | None]:
    """Linear-interpolated quantiles per column; None for a column without values. ``sketches`` are kept
    ones of exactly the rows of ``df``; without them one scan makes them. Results are the same."""
    near = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in probabilities for d in (-_KLL_MARGIN, _KLL_MARGIN)])
    known = quantile_sketches(df, columns) if sketches is None else sketches.filter(F.col("feature").isin(columns))
    guess = F.when(F.col("n") > bracket_rows, F.kll_sketch_get_quantile_double(F.col("sketch"), near))
    seen = {r["feature"]: r for r in known.select("feature", "n", guess.alias("guess")).collect()}
    sizes = {c: seen[c]["n"] for c in columns}
    proposed = {c: sorted(set(seen[c]["guess"])) for c in columns if seen[c]["guess"]}
    wanted: dict[str, list[int]] = {}
    for c in columns:
        n = sizes[c]
        if n:
            places = [(n - 1) * p for p in probabilities]
            wanted[c] = [math.floor(x) for x in places] + [math.ceil(x) for x in places]
    got = order_statistics(df, wanted, sizes, bracket_rows, proposed) if wanted else {}
    out: dict[str, list[float] | None] = {}
    for c in columns:
        n = sizes[c]
        if not n:
            out[c] = None
            continue
        row = []
        for p in probabilities:
            x = (n - 1) * p
            a, b = got[(c, math.floor(x))], got[(c, math.ceil(x))]
            row.append(a + (b - a) * (x - math.floor(x)))
        out[c] = row
    return out
