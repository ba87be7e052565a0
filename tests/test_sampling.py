"""Samples and splits."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orderlight.operators import sampling as s
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


def scored(spark, *bands):
    data = [(f"{p}-{i}", p) for p, n in bands for i in range(n)]
    return spark.createDataFrame(data, "order_id STRING, p DOUBLE")


def test_quotas():
    assert s.band_quotas(200) == [70, 60, 70]
    assert sum(s.band_quotas(101)) == 101
    with pytest.raises(ValueError):
        s.band_quotas(10, (0.5, -0.1, 0.6))


def test_stratified_queue(spark):
    out = s.stratified_sample(scored(spark, (0.1, 100), (0.5, 100), (0.9, 100)), "order_id", "p", 200)
    mix = s.queue_mix(out).first().asDict()
    assert out.count() == 200 and mix == {"LOW": 0.35, "MEDIUM": 0.30, "HIGH": 0.35}
    again = s.stratified_sample(scored(spark, (0.1, 100), (0.5, 100), (0.9, 100)).repartition(7), "order_id", "p", 200)
    assert sorted(rows(out, "order_id", "queue_position")) == sorted(rows(again, "order_id", "queue_position"))


def test_short_band_is_filled_from_the_others(spark):
    out = s.stratified_sample(scored(spark, (0.1, 100), (0.5, 5), (0.9, 100)), "order_id", "p", 100)
    counts = {r["simulation_risk_band"]: r["count"] for r in out.groupBy("simulation_risk_band").count().collect()}
    assert counts["MEDIUM"] == 5 and sum(counts.values()) == 100
    assert out.select("order_id").distinct().count() == 100


def test_queue_of_nothing(spark):
    empty = scored(spark, (0.1, 0))
    assert s.stratified_sample(empty, "order_id", "p").count() == 0
    assert s.queue_mix(empty.withColumn("simulation_risk_band", F.lit("LOW"))).first().asDict() == {"LOW": 0.0, "MEDIUM": 0.0, "HIGH": 0.0}


def test_hash_sample_is_the_exact_top(spark):
    ids = [f"k{i}" for i in range(5000)]
    want = sorted(ids, key=lambda k: hashlib.md5(f"{k}#42".encode()).hexdigest())[:25]
    df = spark.createDataFrame([(k,) for k in ids], "id STRING")
    assert sorted(r["id"] for r in s.first_by_hash(df, "id", 25).collect()) == sorted(want)


def test_sampled_orders_are_complete(spark):
    items = spark.createDataFrame([(f"o{i % 50}", i) for i in range(500)] + [(None, 1), (" ", 2)], "order_id STRING, n INT")
    out = s.sample_orders(items, "order_id", 7)
    assert {r["count"] for r in out.groupBy("order_id").count().collect()} == {10}
    assert out.count() == 70


def test_time_spanning_sample(spark):
    df = spark.createDataFrame([(f"o{i:03d}", T0 + timedelta(days=i)) for i in range(100)], "order_id STRING, created_at TIMESTAMP")
    got = sorted(r["order_id"] for r in s.time_spanning_sample(df, 20).collect())
    want = sorted({f"o{(i * 99) // 19:03d}" for i in range(20)})
    assert got == want and len(got) == 20 and got[0] == "o000" and got[-1] == "o099"
    assert s.time_spanning_sample(df, 100).count() == 100


@pytest.mark.parametrize("rows_n,n", [(7, 3), (101, 100), (64, 2), (50, 49)])
def test_time_spanning_positions(spark, rows_n, n):
    df = spark.createDataFrame([(f"o{i:03d}", T0 + timedelta(days=i)) for i in range(rows_n)], "order_id STRING, created_at TIMESTAMP")
    got = sorted(r["order_id"] for r in s.time_spanning_sample(df, n).collect())
    assert got == sorted({f"o{(i * (rows_n - 1)) // (n - 1):03d}" for i in range(n)})


def test_split_with_ties_and_missing_times(spark):
    rng = random.Random(5)
    data = [(f"o{i:03d}", None if i % 11 == 0 else T0 + timedelta(days=rng.choice([1, 1, 1, 2, 3, 40]))) for i in range(203)]
    rng.shuffle(data)
    out = s.temporal_split(spark.createDataFrame(data, "order_id STRING, created_at TIMESTAMP"))
    order = sorted(data, key=lambda r: (r[1] is None, r[1] or T0, r[0]))
    i, j = int(203 * 0.70), int(203 * 0.85)
    want = {oid: "train" if n < i else "validation" if n < j else "test" for n, (oid, _) in enumerate(order)}
    assert dict(rows(out, "order_id", "split")) == want
