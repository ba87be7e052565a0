"""Positions and running totals over a global order, without one task seeing all rows.

The rows are range-partitioned on the whole sort key, so one hot first key (a date, a score,
a customer) is split across tasks by the rest of the key. Positions are fixed by writing the
sorted rows once; each part then only needs the totals of the parts before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlight.session import small_side, stored

# monotonically_increasing_id keeps the partition number above this many row bits.
_ROW_BITS = 33


def sorted_parts(df: DataFrame, sort: list[Column], label: str) -> DataFrame:
    """Rows with ``_part`` and ``_row`` (position inside the part), in global sort order."""
    numbered = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    return (
        stored(numbered, label)
        .withColumn("_part", F.shiftright("_pos", _ROW_BITS))
        .withColumn("_row", F.col("_pos") - F.shiftleft(F.col("_part"), _ROW_BITS))
        .drop("_pos")
    )


def global_rank(df: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """Adds the 0-based position of each row in ``keys`` order. The keys must be unique."""
    placed = sorted_parts(df, [F.col(k).asc_nulls_last() for k in keys], "rank")
    # One row per part, so the ordered window below is bounded by the partition count.
    offsets = (
        placed.groupBy("_part").agg(F.count("*").alias("_rows"))
        .select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_row"))
        .drop("_part", "_row", "_before")
    )


def running_totals(
    df: DataFrame, by: list[str], order: list[str], sums: list[str], descending: bool = False, totals: bool = False
) -> DataFrame:
    """Adds ``before_<s>``: the sum of ``s`` over the rows of the same ``by`` group that come
    earlier in ``order``; with ``totals`` also ``total_<s>`` of the whole group. Groups may be
    of any size. The carried sums hold at most (parts + groups) rows; they are counted, and broadcast
    only within the bound."""
    ordered = [F.col(k).desc_nulls_last() if descending else F.col(k).asc_nulls_last() for k in order]
    placed = sorted_parts(df, [F.col(k).asc_nulls_first() for k in by] + ordered, "totals")
    inside = Window.partitionBy("_part", *by).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        placed.groupBy("_part", *by).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
        .select(
            F.col("_part").alias("_c_part"),
            *[F.col(k).alias(f"_c_{k}") for k in by],
            *[F.sum(f"_t_{s}").over(earlier).alias(f"_c_sum_{s}") for s in sums],
            *[F.sum(f"_t_{s}").over(Window.partitionBy(*by)).alias(f"total_{s}") for s in sums if totals],
        )
    )
    local = placed.withColumns({f"_l_{s}": F.sum(s).over(inside) for s in sums})
    match = F.col("_part") == F.col("_c_part")
    for k in by:
        match = match & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    joined = local.join(small_side(stored(carried, "carried")), match)
    zero = F.lit(0)
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"_l_{s}"), zero) + F.coalesce(F.col(f"_c_sum_{s}"), zero)).alias(f"before_{s}")
            for s in sums
        ],
        *[f"total_{s}" for s in sums if totals],
    )
