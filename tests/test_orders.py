"""Order aggregation and customer history."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from orderlight.operators import snapshots
from orderlight.operators.orders import aggregate_to_orders, customer_history
from tests.conftest import rows

ITEM = "increment_id STRING, `Customer ID` STRING, created_at TIMESTAMP, price DOUBLE, qty_ordered DOUBLE, grand_total DOUBLE, discount_amount DOUBLE, payment_method STRING, category_name_1 STRING, status STRING, _ord BIGINT"


def items(spark, *data):
    return spark.createDataFrame([(*d, i) for i, d in enumerate(data)], ITEM)


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


def test_items_become_one_order(spark):
    df = items(
        spark,
        ("o1", None, at(2, 5), 10.0, 1.0, 30.0, 1.0, "COD", "B", "complete"),
        ("o1", "c2", at(3), 20.0, 2.0, 35.0, 0.5, "COD", "A", "complete"),
        ("o1", "c1", at(2, 6), 30.0, 1.0, 20.0, 0.0, None, None, "canceled"),
    )
    o = aggregate_to_orders(df).first().asDict()
    assert (o["price"], o["qty_ordered"], o["grand_total"], o["discount_amount"]) == (20.0, 4.0, 35.0, 1.5)
    assert o["created_at"] == at(2, 5) and o["customer_id"] == "c1"
    assert (o["is_canceled"], o["status"], o["payment_method"], o["is_cod"]) == (1, "canceled", "COD", 1)
    assert o["category_name_1"] == "A"
    assert (o["day_of_week"], o["hour"], o["has_discount"]) == (1, 5, 1)
    assert abs(o["discount_ratio"] - 1.5 / 35.00001) < 1e-12


def test_customer_ties_follow_the_row_order(spark):
    df = items(
        spark,
        ("o1", "second", at(1), 1.0, 1.0, 1.0, 0.0, "a", "A", "complete"),
        ("o1", "first", at(1), 2.0, 1.0, 1.0, 0.0, "a", "A", "complete"),
    )
    assert aggregate_to_orders(df).first()["customer_id"] == "second"


def test_all_missing_texts_are_unknown(spark):
    df = items(spark, ("o1", None, at(1), 1.0, 1.0, 1.0, 0.0, None, None, "complete"))
    assert rows(aggregate_to_orders(df), "customer_id", "payment_method", "category_name_1") == [(None, "unknown", "unknown")]


def test_numeric_looking_ids_stay_text(spark):
    df = items(
        spark,
        (" 100252830 ", "143.0", at(1), 1.0, 1.0, 1.0, 0.0, "a", "A", "complete"),
        ("100252831", "143.0", at(2), 1.0, 1.0, 1.0, 0.0, "a", "A", "complete"),
    )
    out = customer_history(aggregate_to_orders(df))
    assert sorted(rows(out, "order_id", "prev_orders")) == [("100252830", 0), ("100252831", 1)]


def orders(spark, data):
    return spark.createDataFrame(data, "order_id STRING, customer_id STRING, created_at TIMESTAMP, is_canceled INT")


def test_history_uses_only_earlier_orders(spark):
    out = customer_history(orders(spark, [("a", "c", at(1), 1), ("b", "c", at(2), 0), ("x", "d", at(2), 1)]))
    assert sorted(rows(out, "order_id", "prev_orders", "prev_cancellations", "customer_cancel_rate")) == [
        ("a", 0, 0, 0.0), ("b", 1, 1, 1.0), ("x", 0, 0, 0.0)]


def test_same_time_orders_go_by_id_and_missing_customers_are_one_group(spark):
    out = customer_history(orders(spark, [("b", None, at(1), 0), ("a", None, at(1), 1), ("c", None, at(1), 0)]))
    assert sorted(rows(out, "order_id", "prev_orders", "prev_cancellations")) == [("a", 0, 0), ("b", 1, 1), ("c", 2, 1)]


def brute_history(data):
    out, seen = {}, {}
    for oid, cust, created, y in sorted(data, key=lambda r: (r[2], r[0])):
        n, c = seen.get(cust, (0, 0))
        out[oid] = (n, c)
        seen[cust] = (n + 1, c + y)
    return out


def test_hot_customers_match_brute_force(spark):
    """A third of the rows without a customer, a hot customer with one timestamp, small ones."""
    rng = random.Random(7)
    data = []
    for i in range(3000):
        kind = i % 3
        cust = None if kind == 0 else "hot" if kind == 1 else f"c{rng.randrange(400)}"
        created = at(1) if kind == 1 else at(1) + timedelta(hours=rng.randrange(500))
        data.append((f"o{i:05d}", cust, created, rng.randrange(2)))
    rng.shuffle(data)
    want = brute_history(data)
    for limit in (10**9, 500, 3):
        got = {r["order_id"]: (r["prev_orders"], r["prev_cancellations"]) for r in customer_history(orders(spark, data), hot_rows=limit).collect()}
        assert got == want, limit


def snapshot(spark, data):
    filler = {
        "price": F.lit(1.0), "qty_ordered": F.lit(1.0), "grand_total": F.lit(1.0), "discount_amount": F.lit(0.0),
        "category_name_1": F.lit("A"), "payment_method": F.lit("cod"), "status": F.lit("complete"), "discount_ratio": F.lit(0.0),
        "is_cod": F.lit(1), "has_discount": F.lit(0), "day_of_week": F.lit(0), "hour": F.lit(0),
    }
    return orders(spark, data).withColumns(filler)


def test_history_across_batches(spark):
    old = snapshots.cumulative_snapshot(None, snapshot(spark, [("old", "c1", at(1), 1)]))
    new = snapshots.cumulative_snapshot(old, snapshot(spark, [("new", "c1", at(2), 0)]))
    assert sorted(rows(new, "order_id", "customer_cancel_rate")) == [("new", 1.0), ("old", 0.0)]


def test_incremental_merge_equals_full_recomputation(spark):
    rng = random.Random(3)

    def some(prefix, n, lo, hi):
        return [(f"{prefix}{i}", rng.choice([None, "a", "b", "c", "d", "e"]), at(1) + timedelta(hours=rng.randrange(lo, hi)), rng.randrange(2)) for i in range(n)]

    first = some("o", 60, 0, 300)
    # Late orders, restated orders with another customer, and restatements older than the original.
    second = some("n", 20, 0, 600) + [(oid, "z", t + timedelta(hours=5), y) for oid, _, t, y in first[:5]] + [
        (oid, "y", t - timedelta(hours=5), y) for oid, _, t, y in first[5:8]]
    old = snapshots.cumulative_snapshot(None, snapshot(spark, first))
    full = snapshots.cumulative_snapshot(old, snapshot(spark, second))
    step = snapshots.extended_snapshot(old, snapshot(spark, second))
    assert sorted(map(repr, full.collect())) == sorted(map(repr, step.collect()))
    only_new = snapshot(spark, [d for d in second if d[0].startswith("n")])
    full = snapshots.cumulative_snapshot(old, only_new)
    step = snapshots.extended_snapshot(old, only_new, disjoint=True)
    assert sorted(map(repr, full.collect())) == sorted(map(repr, step.collect()))


def test_old_integer_ids_join_new_text_ids(spark):
    a = spark.createDataFrame([(1, "5")], "order_id BIGINT, price STRING")
    b = spark.createDataFrame([("1", 5.0)], "order_id STRING, price DOUBLE")
    assert snapshots.normalize_snapshot(a).dtypes == snapshots.normalize_snapshot(b).dtypes
