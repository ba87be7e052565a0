"""Items -> one row per order, and customer history over orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlight.contract import CUSTOMER_ID_CANDIDATES, ORDER_ID_CANDIDATES
from orderlight.functions.cleaning import first_existing, normalize_ids, quoted
from orderlight.functions.features import row_features
from orderlight.operators.ordering import running_totals
from orderlight.session import small_side, stored

ORDER_COLUMNS = [
    "order_id", "created_at", "customer_id", "price", "qty_ordered", "grand_total", "discount_amount",
    "is_canceled", "category_name_1", "payment_method", "status", "discount_ratio", "is_cod",
    "has_discount", "day_of_week", "hour",
]
HISTORY_COLUMNS = ["prev_orders", "prev_cancellations", "customer_cancel_rate"]

# Orders of one customer that a single task sorts. Customers above it are handled by
# range-partitioned running totals.
HOT_ROWS = 2_000_000


def smallest_mode(c: Column) -> Column:
    """Most frequent text; ties go to the smallest, missing counts as "unknown"."""
    return F.mode(F.coalesce(c.cast("string"), F.lit("unknown")), True)


def aggregate_to_orders(items: DataFrame) -> DataFrame:
    """Valid typed items -> order rows without history, in one shuffle.

    All aggregates combine on the map side, so an order with very many items does not load
    one reducer. The mode buffers hold the distinct categories of an order, not its rows.
    """
    df = normalize_ids(items)
    order_col = first_existing(df.columns, ORDER_ID_CANDIDATES)
    customer_col = first_existing(df.columns, CUSTOMER_ID_CANDIDATES)
    order_id = quoted(order_col) if order_col else F.col("_ord").cast("string")
    customer = quoted(customer_col) if customer_col else F.lit("unknown")
    first_seen = [F.col("created_at")] + ([F.col("_ord")] if "_ord" in df.columns else [])
    grouped = df.select(
        order_id.alias("order_id"),
        customer.alias("_customer"),
        F.when(customer.isNotNull(), F.struct(*first_seen)).alias("_seen"),
        "created_at", "price", "qty_ordered", "grand_total", "discount_amount",
        "category_name_1", "payment_method",
        (F.col("status") == "canceled").cast("int").alias("_canceled"),
    ).groupBy("order_id").agg(
        F.min("created_at").alias("created_at"),
        F.min_by("_customer", "_seen").alias("customer_id"),
        F.avg("price").alias("price"),
        F.sum("qty_ordered").alias("qty_ordered"),
        F.max("grand_total").alias("grand_total"),
        F.sum("discount_amount").alias("discount_amount"),
        smallest_mode(F.col("category_name_1")).alias("category_name_1"),
        smallest_mode(F.col("payment_method")).alias("payment_method"),
        F.when(F.max("_canceled") == 1, "canceled").otherwise("complete").alias("status"),
    )
    return row_features(grouped).select(*ORDER_COLUMNS)


def hot_customers(orders: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Customers with more than ``hot_rows`` orders (the missing customer included), as a stored table."""
    big = orders.groupBy("customer_id").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows)
    return stored(big.select(F.col("customer_id").alias("_hot")), "hot")


def history_rate() -> Column:
    return F.when(
        F.col("prev_orders") > 0, F.col("prev_cancellations") / F.col("prev_orders")
    ).otherwise(F.lit(0.0))


def customer_history(orders: DataFrame, hot_rows: int = HOT_ROWS, prepared: bool = False) -> DataFrame:
    """Adds each order's earlier orders and cancellations of the same customer.

    "Earlier" is (created_at, order_id) order and never includes the order itself. Orders
    without a customer form one group. ``orders`` is read twice, so it is written once first
    unless the caller hands over a stored table (``prepared``).
    """
    base = orders.drop(*HISTORY_COLUMNS)
    if not prepared:
        base = stored(base, "orders")
    hot = hot_customers(base, hot_rows)
    split = not hot.isEmpty()
    side, match = small_side(hot), F.col("customer_id").eqNullSafe(F.col("_hot"))

    order = Window.partitionBy("customer_id").orderBy(F.col("created_at").asc_nulls_last(), "order_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = (base.join(side, match, "left_anti") if split else base).withColumns({
        "prev_orders": (F.row_number().over(order) - 1).cast("bigint"),
        "prev_cancellations": F.coalesce(F.sum("is_canceled").over(before), F.lit(0)).cast("bigint"),
    })
    if split:
        heavy = running_totals(
            base.join(side, match, "left_semi").withColumn("_one", F.lit(1).cast("bigint")),
            ["customer_id"], ["created_at", "order_id"], ["_one", "is_canceled"],
        )
        out = out.unionByName(
            heavy.drop("_one")
            .withColumn("prev_orders", F.col("before__one").cast("bigint"))
            .withColumn("prev_cancellations", F.col("before_is_canceled").cast("bigint"))
            .drop("before__one", "before_is_canceled")
        )
    return out.withColumn("customer_cancel_rate", history_rate())
