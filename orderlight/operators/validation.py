"""Item checks: one pass of row rules, exact-duplicate counting, reasons and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlight.contract import LEAKAGE_COLUMNS, ORDER_ID_CANDIDATES, REQUIRED_COLUMNS, VALID_STATUSES
from orderlight.functions.cleaning import (
    clean_status, first_existing, normalize_ids, quoted, to_number, to_time,
)
from orderlight.session import BROADCAST_ROWS, small_side, stored

MONEY_COLUMNS = ["price", "qty_ordered", "grand_total", "discount_amount"]
ORD = "_ord"
COPIES = "_copies"
REASON = "quarantine_reason"
REPORT_SCHEMA = "check_name STRING, status STRING, affected_rows BIGINT, details STRING"

_HASH = "_hash"

# Copies of one row that a single task writes out.
COPY_CHUNK = 100_000


def missing_columns(columns: list[str]) -> list[str]:
    return [c for c in REQUIRED_COLUMNS if c not in columns]


def row_rules(df: DataFrame) -> dict[str, Column]:
    """Rule name -> "row breaks it", in the order their reasons are written."""
    rules: dict[str, Column] = {}
    order_col = first_existing(df.columns, ORDER_ID_CANDIDATES)
    if order_col:
        rules["missing_order_id"] = quoted(order_col).isNull()
    rules["invalid_created_at"] = to_time(df, "created_at").isNull()
    for c in MONEY_COLUMNS:
        v = to_number(df, c)
        bad = v <= 0 if c == "qty_ordered" else v < 0
        rules[f"invalid_{c}"] = v.isNull() | bad
    rules["invalid_status"] = ~F.coalesce(clean_status(F.col("status")).isin(VALID_STATUSES), F.lit(False))
    return rules


def checked_rows(items: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Distinct item rows with ``_copies``, first ``_ord`` and the row-rule reasons. Later steps
    never need the copies themselves, only how many there are. ``items`` is read several times:
    hand in a stored table.

    Repeated rows are rare, so full rows are neither shuffled nor written to find them. A first
    pass counts 8-byte row hashes; equal rows always share a hash, so only rows with a repeated
    hash can have copies. Those few are grouped by all their columns, which is exact whatever
    the hash, and stored; all other rows stay a filter over the input. Map tasks collapse copies
    first, so one row repeated very often is no hot spot. With more than ``bound`` repeated
    hashes the filter would shuffle whole rows at each read, so the marked rows are then stored once.
    """
    df = normalize_ids(items)
    source = [c for c in df.columns if c != ORD]
    if ORD not in df.columns:
        df = df.withColumn(ORD, F.lit(None).cast("bigint"))
    hashed = df.withColumn(_HASH, F.xxhash64(*[quoted(c) for c in source]))
    repeated = stored(
        hashed.groupBy(_HASH).agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(F.col(_HASH).alias("_hit")),
        "repeated",
    )
    hits = repeated.count()
    if hits == 0:
        return _with_reasons(df).withColumn(COPIES, F.lit(1).cast("bigint"))
    if hits <= bound:
        match = F.col(_HASH) == F.col("_hit")
        single = hashed.join(F.broadcast(repeated), match, "left_anti")
        several = hashed.join(F.broadcast(repeated), match, "left_semi")
    else:
        # Row groups without repeated rows are skipped by their statistics.
        staged = stored(
            hashed.join(repeated, F.col(_HASH) == F.col("_hit"), "left")
            .withColumn("_again", F.col("_hit").isNotNull()).drop("_hit"),
            "checked",
        )
        single, several = staged.filter(~F.col("_again")).drop("_again"), staged.filter("_again")
    once = _with_reasons(single.drop(_HASH)).withColumn(COPIES, F.lit(1).cast("bigint"))
    again = several.groupBy(*[quoted(c) for c in source]).agg(F.min(ORD).alias(ORD), F.count("*").alias(COPIES))
    return once.unionByName(stored(_with_reasons(again), "copies"))


def _with_reasons(df: DataFrame) -> DataFrame:
    rules = row_rules(df)
    return df.withColumn(REASON, F.concat(*[F.when(bad, f"{name};").otherwise("") for name, bad in rules.items()]))


def valid_rows(checked: DataFrame) -> DataFrame:
    """Rows without a reason, typed."""
    ok = checked.filter(F.col(REASON) == "").drop(REASON, COPIES)
    return ok.withColumns({
        "created_at": to_time(ok, "created_at"),
        **{c: to_number(ok, c) for c in MONEY_COLUMNS},
        "status": clean_status(F.col("status")),
    })


def _copies_written_out(rows: DataFrame, chunk: int = COPY_CHUNK) -> DataFrame:
    """Repeat each row ``_copies`` - 1 times. Large counts are cut into chunks that are spread
    over tasks before they expand."""
    extra = F.col(COPIES) - 1
    parts = rows.filter(extra > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((extra - 1) / F.lit(chunk))))
    )
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.least(F.lit(chunk).cast("bigint"), extra - F.col("_chunk") * F.lit(chunk))
    return (
        parts.repartition(tasks, ORD, *[quoted(c) for c in REQUIRED_COLUMNS], "_chunk")
        .withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))
        .drop("_chunk", "_n")
    )


def quarantined_rows(checked: DataFrame, chunk: int = COPY_CHUNK) -> DataFrame:
    """Every row that failed: broken first copies, and all further copies of any row."""
    broken = checked.filter(F.col(REASON) != "").drop(COPIES)
    again = (
        _copies_written_out(checked, chunk)
        .withColumn(REASON, F.concat(F.col(REASON), F.lit("duplicate_row;")))
        .withColumn(ORD, F.lit(None).cast("bigint"))
        .drop(COPIES)
    )
    return broken.unionByName(again)


def row_check_counts(checked: DataFrame) -> DataFrame:
    """One row: total rows, valid rows and affected rows per rule, counted with copies."""
    n = F.col(COPIES)
    rules = row_rules(checked.drop(REASON, COPIES, ORD))
    return checked.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("raw_rows"),
        F.count_if(F.col(REASON) == "").alias("valid_rows"),
        *[F.coalesce(F.sum(F.when(F.contains(F.col(REASON), F.lit(f"{r};")), n)), F.lit(0)).alias(r) for r in rules],
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate_row"),
    )


def report_rows(counts: dict[str, int], order_column: str | None) -> list[tuple[str, str, int, str]]:
    """Row-check part of the report, from the one-row counts."""
    def graded(name: str, rule: str, details: str):
        return (name, "PASS" if counts[rule] == 0 else "WARN", int(counts[rule]), details)

    rows = [("required_columns", "PASS", 0, "No required column is absent")]
    if order_column:
        rows.append(graded("order_identifier", "missing_order_id", f"Orders are told apart by {order_column}"))
    else:
        rows.append((
            "order_identifier", "WARN", 0,
            f"None of {ORDER_ID_CANDIDATES} is there; each row becomes an order",
        ))
    rows.append(graded("date_parsing", "invalid_created_at", "Rows without a readable created_at"))
    rows += [graded(f"range_{c}", f"invalid_{c}", f"Rows whose {c} is no number or out of range") for c in MONEY_COLUMNS]
    rows.append(graded("target_status", "invalid_status", "Rows whose status is neither complete nor canceled"))
    rows.append(graded("duplicate_rows", "duplicate_row", "Rows equal to an earlier row"))
    rows.append((
        "leakage_guard", "PASS", 0,
        f"Never used as features: {LEAKAGE_COLUMNS}",
    ))
    return rows


def missing_column_report(missing: list[str]) -> list[tuple[str, str, int, str]]:
    return [("required_columns", "FAIL", len(missing), f"Absent: {missing}")]


@dataclass
class ItemCheck:
    """Outcome of the row checks of one batch. ``fatal`` batches carry no rows."""

    fatal: bool
    report: list[tuple[str, str, int, str]]
    counts: dict[str, int]
    valid: DataFrame | None = None
    quarantine: DataFrame | None = None

    def report_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.report, REPORT_SCHEMA)


def check_items(items: DataFrame) -> ItemCheck:
    """Required columns, row rules and duplicates. The counts, the valid side and the
    quarantine all read the checked rows, so ``items`` should be a stored table."""
    missing = missing_columns(items.columns)
    if missing:
        return ItemCheck(True, missing_column_report(missing), {"raw_rows": items.count(), "valid_rows": 0})
    checked = checked_rows(items)
    counts = row_check_counts(checked).first().asDict()
    return ItemCheck(
        False, report_rows(counts, first_existing(items.columns, ORDER_ID_CANDIDATES)), counts,
        valid_rows(checked), quarantined_rows(checked),
    )


def inconsistent_orders(valid: DataFrame, order_column: str) -> DataFrame:
    """Order ids whose valid items disagree on the status. Min and max combine on the map
    side; a distinct count would not."""
    return (
        valid.groupBy(quoted(order_column).alias("order_id"))
        .agg(F.min("status").alias("low"), F.max("status").alias("high"))
        .filter(F.col("low") != F.col("high"))
        .select("order_id")
    )


def existing_orders(valid: DataFrame, order_column: str, snapshot: DataFrame) -> DataFrame:
    """Order ids of the batch that an earlier snapshot already holds. The history is the side that
    streams: while the batch's ids are within the broadcast bound, it is neither shuffled nor sorted,
    and only its matches are made distinct."""
    ids = valid.select(quoted(order_column).alias("_batch_id")).filter("_batch_id IS NOT NULL").distinct()
    known = snapshot.select(F.col("order_id").cast("string").alias("order_id"))
    return known.join(small_side(stored(ids, "batch_ids")), F.col("order_id") == F.col("_batch_id"), "left_semi").distinct()
