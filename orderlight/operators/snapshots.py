"""Snapshot schema, cumulative merge and version lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlight.functions.cleaning import clean_id, quoted, to_number, to_time
from orderlight.operators.latest import latest_per_key
from orderlight.operators.orders import HISTORY_COLUMNS, HOT_ROWS, ORDER_COLUMNS, customer_history
from orderlight.session import small_side, stored

WHOLE_NUMBERS = {
    "is_canceled": "int", "is_cod": "int", "has_discount": "int", "day_of_week": "int", "hour": "int",
    "prev_orders": "bigint", "prev_cancellations": "bigint",
}
TEXTS = ["category_name_1", "payment_method", "status"]
SNAPSHOT_COLUMNS = ORDER_COLUMNS + HISTORY_COLUMNS


def normalize_snapshot(df: DataFrame) -> DataFrame:
    """Stable types across versions. Columns that are absent stay absent; bad values are NULL."""
    out = []
    for c in df.columns:
        if c in ("order_id", "customer_id", "increment_id", "Order ID", "item_id", "Customer ID"):
            out.append(clean_id(quoted(c)).alias(c))
        elif c in TEXTS:
            out.append(F.col(c).cast("string").alias(c))
        elif c == "created_at":
            out.append(to_time(df, c).alias(c))
        elif c in WHOLE_NUMBERS:
            out.append(to_number(df, c).try_cast(WHOLE_NUMBERS[c]).alias(c))
        elif c in SNAPSHOT_COLUMNS:
            out.append(to_number(df, c).alias(c))
        else:
            out.append(quoted(c))
    return df.select(*out)


def merged_orders(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new orders, one row per id: the later ``created_at`` wins, then the new row."""
    both = (
        normalize_snapshot(old.select(*ORDER_COLUMNS)).withColumn("_source", F.lit(0))
        .unionByName(normalize_snapshot(new.select(*ORDER_COLUMNS)).withColumn("_source", F.lit(1)))
    )
    return latest_per_key(both, ["order_id"], "created_at", "_source").drop("_source")


def cumulative_snapshot(old: DataFrame | None, new: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Merged orders with the history recomputed over all of them."""
    merged = merged_orders(old, new) if old is not None else normalize_snapshot(new.select(*ORDER_COLUMNS))
    return customer_history(merged, hot_rows).select(*SNAPSHOT_COLUMNS)


def extended_snapshot(
    old: DataFrame | None, new: DataFrame, hot_rows: int = HOT_ROWS, disjoint: bool = False
) -> DataFrame:
    """Same result as :func:`cumulative_snapshot` when ``old`` already carries its history:
    only customers with a new or replaced order are recomputed, the rest pass through without
    a shuffle. ``disjoint`` says that no id of ``new`` occurs in ``old``, so nothing has to be
    merged."""
    if old is None:
        return cumulative_snapshot(None, new, hot_rows)
    new = stored(normalize_snapshot(new.select(*ORDER_COLUMNS)), "new-orders")
    old = old.select(*SNAPSHOT_COLUMNS)
    moved = new.select("customer_id")
    if not disjoint:
        ids = small_side(new.select("order_id").distinct())
        moved = moved.unionByName(old.join(ids, "order_id", "left_semi").select("customer_id"))
    touched = stored(moved.distinct().select(F.col("customer_id").alias("_touched")), "touched")
    same = F.col("customer_id").eqNullSafe(F.col("_touched"))
    side = small_side(touched)
    untouched = old.join(side, same, "left_anti")
    affected = old.join(side, same, "left_semi")
    if disjoint:
        again = normalize_snapshot(affected.select(*ORDER_COLUMNS)).unionByName(new)
    else:
        again = merged_orders(affected, new)
    return untouched.unionByName(customer_history(again, hot_rows).select(*SNAPSHOT_COLUMNS))


def version_states(versions: DataFrame) -> DataFrame:
    """Version rows with ``active`` resolved: only the newest full version is active."""
    active = versions.filter(~F.col("sample")) if "sample" in versions.columns else versions
    newest = active.agg(F.max_by("dataset_version", F.struct("created_at", "dataset_version")).alias("_active"))
    return (
        versions.join(F.broadcast(newest), F.col("dataset_version") == F.col("_active"), "left")
        .withColumn("active", F.col("_active").isNotNull())
        .drop("_active")
    )


def active_version(versions: DataFrame) -> DataFrame:
    """The newest row flagged active, or no row."""
    rest = [c for c in versions.columns]
    return (
        versions.filter(F.col("active"))
        .agg(F.max_by(F.struct(*rest), F.struct("created_at", "dataset_version")).alias("v"))
        .filter("v IS NOT NULL")
        .select("v.*")
    )
