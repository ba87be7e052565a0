"""Item batches: CSV reading, raw copies, file keys and a generator for trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlight.functions.cleaning import quoted


def read_items(spark: SparkSession, path: str | list[str], line_breaks: bool = False) -> DataFrame:
    """CSV batch as text columns plus ``_ord``, the row order of the source. Fully blank
    lines are not records. Types are decided later, by the checks.

    ``line_breaks``: quoted fields may hold line breaks. A file is then read by one task, so it
    is for batches that come as many files; without it files are split at any line."""
    raw = (
        spark.read.option("header", True).option("inferSchema", False)
        .option("multiLine", line_breaks).option("quote", '"').option("escape", '"').csv(path)
    )
    return with_order(without_blank_rows(raw))


def without_blank_rows(df: DataFrame) -> DataFrame:
    filled = F.lit(False)
    for c in df.columns:
        filled = filled | quoted(c).isNotNull()
    return df.filter(filled)


def with_order(df: DataFrame) -> DataFrame:
    return df if "_ord" in df.columns else df.withColumn("_ord", F.monotonically_increasing_id())


def batch_key(spark: SparkSession, path: str, run_mode: str = "full", sample_orders: int = 5000) -> str:
    """SHA-256 key of a batch and its processing mode.

    Each file is hashed in its own task; the file hashes, in order, and the mode are hashed
    once more. The same bytes in another mode are another batch. Deliver a very large batch
    as many part files: one file is read whole by one task.
    """
    mode = f"|mode={run_mode}|sample_orders={sample_orders if run_mode == 'demo' else 'all'}"
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select(F.sha2("content", 256).alias("h"))
    )
    return files.agg(
        F.sha2(F.concat(F.concat_ws("", F.sort_array(F.collect_list("h"))), F.lit(mode)), 256).alias("k")
    ).first()["k"]


def generated_items(spark: SparkSession, rows: int, customers: int = 700, seed: int = 42) -> DataFrame:
    """Trial batch of one-item orders whose status depends on payment, total and discount."""
    def u(k: int):
        return F.rand(seed * 1000 + k)

    base = spark.range(rows).withColumns({
        "_pay": u(1), "_cat": u(2), "_has": u(3), "_disc": u(4), "_st": u(5),
        "price": F.round(F.exp(F.randn(seed * 1000 + 6) * 0.75 + 7.0), 2),
        "qty_ordered": (F.floor(u(7) * 4) + 1).cast("double"),
        "customer": F.floor(u(8) * (customers - 1)) + 1,
    })
    # Shares and category names of the generator.
    payment = (
        F.when(F.col("_pay") < 0.48, "cod").when(F.col("_pay") < 0.66, "easypay_voucher")
        .when(F.col("_pay") < 0.84, "Payaxis").otherwise("jazzwallet")
    )
    categories = F.array(*[F.lit(c) for c in (
        "Mobiles & Tablets", "Men's Fashion", "Women's Fashion", "Appliances", "Beauty & Grooming")])
    discount = F.round(F.when(F.col("_has") < 0.35, F.col("_disc") * 800).otherwise(0.0), 2)
    full = base.withColumns({
        "payment_method": payment,
        "category_name_1": F.element_at(categories, (F.floor(F.col("_cat") * 5) + 1).cast("int")),
        "discount_amount": discount,
    }).withColumn("grand_total", F.round(F.greatest(F.col("price") * F.col("qty_ordered") - F.col("discount_amount"), F.lit(0.0)), 2))
    z = (
        -1.2 + 0.7 * (F.col("payment_method") == "cod").cast("int") + 0.00004 * F.col("grand_total")
        + 0.3 * (F.col("discount_amount") > 500).cast("int")
    )
    return full.select(
        F.concat(F.lit("ORD"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("increment_id"),
        (F.col("id") + 1).cast("string").alias("item_id"),
        F.col("customer").cast("string").alias("Customer ID"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 10800).alias("created_at"),
        "price", "qty_ordered", "grand_total", "discount_amount", "payment_method", "category_name_1",
        F.when(F.col("_st") < 1.0 / (1.0 + F.exp(-z)), "canceled").otherwise("complete").alias("status"),
    )
