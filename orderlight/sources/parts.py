"""Dataset versions as lists of parts: orders lie in buckets of customers, and a new version only writes what it changes.

A version's manifest names the parts of each bucket. A batch adds a part to the buckets of its customers; a bucket is
rewritten only if one of its older orders changes, or if it has gathered ``MAX_PARTS`` parts. Parts of earlier versions
are never touched, so every version stays readable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from orderlight.operators.orders import HOT_ROWS, ORDER_COLUMNS, customer_history, history_rate
from orderlight.operators.snapshots import SNAPSHOT_COLUMNS, extended_snapshot, normalize_snapshot
from orderlight.session import small_side, stored
from orderlight.sources.schemas import SNAPSHOT

MANIFEST = "bucket INT, buckets INT, part STRING, row_count BIGINT"
BUCKET_ROWS = 2_000_000  # orders of a bucket when buckets are cut
LEAST_BUCKETS, MOST_BUCKETS = 16, 65_536
MAX_PARTS = 8


def buckets_for(rows: int) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS)))


def bucket_of(customer: Column, buckets: int) -> Column:
    """Bucket of a customer; orders without one share a bucket."""
    return F.pmod(F.xxhash64(F.coalesce(customer, F.lit(""))), F.lit(buckets)).cast("int")


def read_manifest(spark: SparkSession, path: str) -> list[Row]:
    """One row a part: at most MOST_BUCKETS times MAX_PARTS."""
    return spark.read.schema(MANIFEST).parquet(path).orderBy("bucket", "part").collect()


def read_parts(spark: SparkSession, parts: list[str]) -> DataFrame:
    return spark.read.schema(SNAPSHOT).parquet(*parts) if parts else spark.createDataFrame([], SNAPSHOT)


def write_parts(spark: SparkSession, orders: DataFrame, buckets: int, path: str) -> list[tuple]:
    """Write ``orders`` by bucket under ``path``: manifest rows. A hot bucket is split over tasks and files."""
    types = {f.split()[0]: f.split()[1] for f in SNAPSHOT.split(",")}
    rows = orders.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()], bucket_of(F.col("customer_id"), buckets).alias("bucket"))
    rows.hint("rebalance", F.col("bucket")).write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    written = spark.read.schema(f"{SNAPSHOT}, bucket INT").parquet(path) if _any_parts(spark, path) else None
    counts = written.groupBy("bucket").count().collect() if written is not None else []
    return [(r["bucket"], buckets, f"{path}/bucket={r['bucket']}", r["count"]) for r in counts]


def _any_parts(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(f"{path}/bucket=*")
    return bool(found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found))


def _place() -> Column:
    """Place of an order in its customer's history: the order of :func:`customer_history`."""
    return F.struct(F.col("created_at").isNull().alias("n"), F.col("created_at").alias("t"), F.col("order_id").alias("i"))


def customer_totals(old: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders, cancellations and last place of the given customers (``_customer``). Combines before the shuffle, so a
    customer with very many orders costs one row a task."""
    same = F.col("customer_id").eqNullSafe(F.col("_customer"))
    own = old.select("customer_id", "created_at", "order_id", "is_canceled").join(small_side(customers), same, "left_semi")
    return own.groupBy("customer_id").agg(
        F.count("*").alias("_orders"), F.coalesce(F.sum("is_canceled"), F.lit(0)).alias("_canceled"), F.max(_place()).alias("_last")
    ).withColumnRenamed("customer_id", "_customer")


def continued_history(new: DataFrame, totals: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """New orders that all come after their customers' older ones, with their history: that inside the batch on top of
    the customers' totals."""
    inside = customer_history(new, hot_rows, prepared=True)
    both = inside.join(small_side(totals), F.col("customer_id").eqNullSafe(F.col("_customer")), "left")
    add = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).cast("bigint")
    counted = both.withColumns({"prev_orders": add("prev_orders", "_orders"), "prev_cancellations": add("prev_cancellations", "_canceled")})
    return counted.withColumn("customer_cancel_rate", history_rate()).select(*SNAPSHOT_COLUMNS)


def extend_parts(
    spark: SparkSession, manifest: list[Row], new: DataFrame, path: str, disjoint: bool = False,
    hot_rows: int = HOT_ROWS, max_parts: int = MAX_PARTS,
) -> list[tuple]:
    """Manifest rows of the version that adds the orders ``new`` to ``manifest``; what is new lies under ``path``.

    The rows of the version equal :func:`cumulative_snapshot` of both. ``disjoint``: no id of ``new`` is known already;
    otherwise every bucket that holds a replaced order is rewritten as well."""
    new = stored(normalize_snapshot(new.select(*ORDER_COLUMNS)), "new-orders")
    buckets, total = manifest[0]["buckets"], sum(r["row_count"] for r in manifest) + new.count()
    by_bucket: dict[int, list[Row]] = {}
    for r in manifest:
        by_bucket.setdefault(r["bucket"], []).append(r)
    of = lambda some: read_parts(spark, [r["part"] for b in sorted(some) for r in by_bucket.get(b, [])])
    if buckets_for(total) >= 4 * buckets:
        whole = extended_snapshot(of(by_bucket), new, hot_rows, disjoint)
        return write_parts(spark, whole, buckets_for(total), path)

    bucket = bucket_of(F.col("customer_id"), buckets)
    touched = _values(new.select(bucket.alias("b")))
    totals = None
    if disjoint:
        customers = stored(new.select(F.col("customer_id").alias("_customer")).distinct(), "customers")
        totals = stored(customer_totals(of(touched), customers), "totals")
        first = new.groupBy("customer_id").agg(F.min(_place()).alias("_first"))
        late = first.join(totals, F.col("customer_id").eqNullSafe(F.col("_customer"))).where(F.col("_first") < F.col("_last"))
        again = _values(late.select(bucket.alias("b"))) | {b for b in touched if len(by_bucket.get(b, [])) >= max_parts}
    else:
        ids = small_side(new.select("order_id").distinct())
        again = touched | _values(of(by_bucket).select("order_id", "customer_id").join(ids, "order_id", "left_semi").select(bucket.alias("b")))
    inside = lambda some: bucket.isin(sorted(some))
    pieces = []
    if again:
        pieces.append(extended_snapshot(of(again), new.where(inside(again)), hot_rows, disjoint))
    if touched - again:
        pieces.append(continued_history(stored(new.where(inside(touched - again)), "later"), totals, hot_rows))
    kept = [tuple(r) for r in manifest if r["bucket"] not in again]
    return kept + (write_parts(spark, reduce(DataFrame.unionByName, pieces), buckets, path) if pieces else [])


def _values(numbers: DataFrame) -> set[int]:
    """Distinct bucket numbers."""
    return {r["b"] for r in numbers.distinct().collect()}
