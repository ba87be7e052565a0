"""Maps the test tables onto the domain: item batches, orders, scored traffic, ledgers.

Every derived table covers its whole source table. Faults (bad dates, missing ids, copies,
conflicting statuses) are derived from column values, so they appear at every scale.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlight.contract import APPROVE, FEATURES, HOLD
from orderlight.functions.economics import economics, policy_columns
from orderlight.functions.features import discount_ratio, feature_payload
from orderlight.operators.orders import aggregate_to_orders, customer_history
from orderlight.operators.validation import checked_rows, inconsistent_orders, valid_rows
from orderlight.plans.scoring import softsign_score
from orderlight.session import BROADCAST_ROWS, small_side, stored

# Payment names of the test domain.
PAYMENTS = {
    "1-URGENT": "cod", "2-HIGH": "Payaxis", "3-MEDIUM": "easypay_voucher", "4-NOT SPECIFIED": None, "5-LOW": "jazzwallet",
}
MODES = {"view": "manual", "click": " Batch ", "purchase": "api", "signup": "simulation_live"}
EVENT_TYPES = {
    "view": "BATCH_SCORING", "click": "MODEL_CANDIDATE", "purchase": "MODEL_PROMOTION",
    "signup": "DATA_INGESTION", "error": "MODEL_RETRAINING",
}


def _mapped(c: Column, pairs: dict) -> Column:
    out = F
    for k, v in pairs.items():
        out = out.when(c == k, F.lit(v))
    return out


SPREAD_ROWS = 1_000_000


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})

    def spread(self, df: DataFrame) -> DataFrame:
        """A table of one file with one row group is scanned by one task; hand its rows to all
        cores. Tables of many files, or so large that their joins deal them out, are left as they are: that would only
        move them once more."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if len(df.inputFiles()) < cores and df.count() <= SPREAD_ROWS else df

    @cached_property
    def orders_table(self) -> DataFrame:
        return self.read("orders")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))

    # ---- items and orders ----

    @cached_property
    def raw_items(self) -> DataFrame:
        c = F.col
        # Only what the items need is moved by the joins, tests as their outcomes.
        lines = self.spread(self.read("lineitem").select(
            "l_orderkey", "l_partkey", "l_extendedprice", "l_discount", c("l_quantity").cast("int").alias("_qty"),
            ((c("l_returnflag") == "R") & (c("l_linenumber") == 7) & (c("l_tax") == 0.07)).alias("_no_id"),
            (c("l_tax") == 0.08).alias("_tax_8"), (c("l_tax") == 0.0).alias("_tax_0"),
            (c("l_linenumber") == 2).alias("_second"),
            ((c("l_linenumber") == 1) & (c("l_tax") == 0.01) & (c("l_linestatus") == "F")).alias("_flip"),
        ))
        parts = self.read("part").select(
            "p_partkey", (c("p_brand") == "Brand#13").alias("_brand"), (c("p_brand") == "Brand#7").alias("_brand_7"),
            F.when(c("p_size") < 50, c("p_type")).alias("category_name_1"))
        orders = self.orders_table.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
        if parts.count() <= BROADCAST_ROWS:
            lines = lines.join(F.broadcast(parts), c("l_partkey") == c("p_partkey"))
        else:
            # Written once, so that the shuffles of both joins never lie side by side.
            lines = stored(lines.join(parts, c("l_partkey") == c("p_partkey")), "lines")
        joined = lines.join(orders, c("l_orderkey") == c("o_orderkey"))
        bad_day = (F.month("o_orderdate") == 1) & (F.dayofmonth("o_orderdate") == 1)
        created = c("o_orderdate") + F.make_dt_interval(hours=(c("o_orderkey") % 24).cast("int"))
        plain = (
            F.when(c("o_orderstatus") == "P", "canceled").when(c("o_orderstatus") == "F", "Complete ")
            .when(c("o_orderpriority") == "1-URGENT", "received").otherwise("complete")
        )
        flip = c("_flip")
        base = joined.select(
            F.when(~c("_no_id"), c("l_orderkey").cast("string")).alias("increment_id"),
            F.when(c("o_totalprice") >= 20000, c("o_custkey").cast("string")).alias("Customer ID"),
            F.when(bad_day, "not a date").otherwise(F.date_format(created, "yyyy-MM-dd HH:mm:ss")).alias("created_at"),
            c("l_partkey").cast("string").alias("sku"),
            c("l_extendedprice").alias("price"),
            F.when(c("_brand") & c("_tax_8"), "0").when(c("_brand") & c("_tax_0"), "two")
            .otherwise(c("_qty").cast("string")).alias("qty_ordered"),
            F.when(c("o_totalprice") < 2500, -c("o_totalprice")).otherwise(c("o_totalprice")).alias("grand_total"),
            (c("l_extendedprice") * c("l_discount") + 0.0).alias("discount_amount"),
            _mapped(c("o_orderpriority"), PAYMENTS).alias("payment_method"),
            "category_name_1",
            F.when(flip & (c("o_orderstatus") == "P"), "complete").when(flip, "canceled").otherwise(plain).alias("status"),
            (c("_brand_7") & c("_second")).alias("_twice"),
        )
        return base.withColumn("_n", F.explode(F.when(c("_twice"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_twice", "_n")

    @cached_property
    def checked(self) -> DataFrame:
        return checked_rows(stored(self.raw_items, "items"))

    @cached_property
    def valid(self) -> DataFrame:
        return valid_rows(self.checked)

    @cached_property
    def inconsistent(self) -> DataFrame:
        return stored(inconsistent_orders(self.valid, "increment_id"), "inconsistent")

    @cached_property
    def kept(self) -> DataFrame:
        ids = small_side(self.inconsistent)
        return self.valid.join(ids, F.col("increment_id") == F.col("order_id"), "left_anti")

    @cached_property
    def orders(self) -> DataFrame:
        return stored(aggregate_to_orders(self.kept), "orders")

    @cached_property
    def history(self) -> DataFrame:
        return customer_history(self.orders, prepared=True)

    @cached_property
    def probability(self) -> Column:
        return softsign_score({c: F.col(c) for c in FEATURES})

    # ---- labeled holdout, straight from the orders table ----

    @cached_property
    def labeled(self) -> DataFrame:
        c = F.col
        urgent = (c("o_orderpriority") == "1-URGENT").cast("int")
        z = F.lit(-2.0) + F.lit(2.5) * urgent + F.lit(0.00001) * (F.floor(c("o_totalprice") / 1000.0) * 1000.0)
        y = (c("o_orderstatus") == "P") | ((c("o_orderpriority") == "1-URGENT") & (c("o_totalprice") > 300000))
        return self.orders_table.select(
            c("o_orderkey").cast("string").alias("order_id"), c("o_orderdate").alias("created_at"),
            y.cast("int").alias("is_canceled"),
            (F.lit(0.5) * (F.lit(1.0) + z / (F.lit(1.0) + F.abs(z)))).alias("probability"),
        )

    @cached_property
    def reference(self) -> DataFrame:
        """Feature frame of the orders table, as drift reference."""
        c = F.col
        day = F.dayofmonth("o_orderdate")
        names = {"1-URGENT": "view", "2-HIGH": "click", "3-MEDIUM": "purchase", "4-NOT SPECIFIED": None, "5-LOW": "error"}
        df = self.orders_table.select(
            (c("o_totalprice") / 1000.0).alias("price"),
            (F.lit(1.0) + (c("o_custkey") % 5)).alias("qty_ordered"),
            day.cast("double").alias("discount_amount"),
            (c("o_orderpriority") == "1-URGENT").cast("int").alias("is_cod"),
            (day > 15).cast("int").alias("has_discount"),
            F.weekday("o_orderdate").alias("day_of_week"),
            (c("o_orderkey") % 24).cast("int").alias("hour"),
            ((c("o_custkey") % 100) / 100.0).alias("customer_cancel_rate"),
            F.concat(F.lit("C"), (c("o_custkey") % 7).cast("string")).alias("category_name_1"),
            _mapped(c("o_orderpriority"), names).alias("payment_method"),
            (c("o_orderstatus") == "P").cast("int").alias("is_canceled"),
            c("o_orderkey").cast("string").alias("order_id"), c("o_orderdate").alias("created_at"),
        ).withColumn("grand_total", c("price") * c("qty_ordered"))
        return df.withColumn("discount_ratio", discount_ratio(c("discount_amount"), c("grand_total")))

    # ---- scored traffic ----

    def as_predictions(self, events: DataFrame) -> DataFrame:
        c = F.col
        mode = F.when(c("event_type") == "error", F.when(c("value") >= 20, "simulation_historical")).otherwise(
            _mapped(c("event_type"), MODES))
        outcome = (
            F.when(c("k") < 30, "Canceled").when(c("k") < 35, " CANCELLED").when(c("k") < 60, "complete")
            .when(c("k") < 70, "Completed").when(c("k") < 75, "returned")
        )
        qty = F.lit(1.0) + (c("k") % 5)
        discount = c("k") * F.lit(0.5)
        df = events.withColumns({
            "prediction_id": c("event_id").cast("string"),
            "order_id": F.when(~((c("event_type") == "error") & (c("value") < 5)), c("user_id").cast("string")),
            "predicted_at": c("ts"),
            "model_name": F.lit("scorecard"),
            "model_version": F.when(c("k") < 50, "m1").otherwise("m2"),
            "dataset_version": F.lit("v1"),
            "probability": F.least(c("value") / 200.0, F.lit(1.0)),
            "threshold": F.when(c("event_type") == "click", 0.40).otherwise(0.45),
            "actual_outcome": outcome,
            "latency_ms": c("value"),
            "scoring_mode": mode,
            "price": c("value"), "qty_ordered": qty, "grand_total": c("value") * qty, "discount_amount": discount,
            "discount_ratio": discount_ratio(discount, c("value") * qty),
            "is_cod": (c("event_type") == "click").cast("int"),
            "has_discount": (discount > 0).cast("int"),
            "day_of_week": F.weekday("ts"), "hour": F.hour("ts"),
            "customer_cancel_rate": c("k") / 100.0,
            "category_name_1": F.when(c("k") < 99, F.concat(F.lit("C"), (c("k") % 7).cast("string"))),
            "payment_method": c("event_type"),
            **policy_columns(),
        })
        unreadable = (c("event_type") == "error") & (c("value") < 10)
        return df.withColumns(economics(c("probability"))).withColumn(
            "feature_json", F.when(unreadable, "{broken").otherwise(feature_payload()))

    @cached_property
    def predictions(self) -> DataFrame:
        return self.as_predictions(self.events)

    @cached_property
    def decisions(self) -> DataFrame:
        c = F.col
        hold = c("value") >= 40

        def made(tag: str, hours: int, when_hold: str, otherwise: str, limit: int) -> DataFrame:
            return self.events.filter(c("k") < limit).select(
                F.concat(F.lit(tag), c("event_id").cast("string")).alias("decision_id"),
                c("event_id").cast("string").alias("prediction_id"),
                (c("ts") + F.make_dt_interval(hours=F.lit(hours))).alias("decided_at"),
                F.when(hold, when_hold).otherwise(otherwise).alias("manager_decision"),
            )

        return made("d1_", 1, HOLD, APPROVE, 40).unionByName(made("d2_", 2, APPROVE, HOLD, 15))

    @cached_property
    def feedback(self) -> DataFrame:
        c = F.col
        return self.events.filter(c("event_type").isin("purchase", "view")).select(
            c("user_id").cast("string").alias("order_id"), c("event_id").alias("seq"),
            F.when(c("k") < 30, "Canceled").when(c("k") < 50, "cancelled ").when(c("k") < 80, "COMPLETE")
            .when(c("k") < 95, "completed").otherwise("returned").alias("final_outcome"),
        )

    # ---- ledgers ----

    @cached_property
    def monthly(self) -> DataFrame:
        return self.orders_table.groupBy(F.date_format("o_orderdate", "yyyyMM").alias("ym")).agg(
            F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"),
            F.count("*").alias("rows"), F.count_if(F.col("o_orderstatus") != "O").alias("good"),
            F.count_distinct("o_custkey").alias("customers"),
        ).withColumn("month", F.substring("ym", 5, 2).cast("int")).withColumn(
            "final", F.when(F.col("month") == 3, "FAILED").when(F.col("month") == 7, "NO_NEW_DATA")
            .when(F.col("month") == 1, "SEED").otherwise("SUCCESS"))

    @cached_property
    def batch_log(self) -> DataFrame:
        """Append-only batch states: one PROCESSING row and one closing row per month."""
        c = F.col

        def state(at: str, status: Column, rows: Column, good: Column) -> DataFrame:
            return self.monthly.select(
                F.concat(F.lit("batch_"), c("ym")).alias("batch_id"), F.md5(F.concat(F.lit("file"), c("ym"))).alias("file_hash"),
                c(at).alias("uploaded_at"), rows.alias("raw_rows"), good.alias("valid_rows"), status.alias("status"))

        zero = F.lit(0).cast("bigint")
        return state("first_day", F.lit("PROCESSING"), zero, zero).unionByName(
            state("last_day", c("final"), c("rows"), c("good")))

    @cached_property
    def version_log(self) -> DataFrame:
        c = F.col
        return self.monthly.filter(c("final").isin("SUCCESS", "SEED")).select(
            F.concat(F.lit("v"), c("ym")).alias("dataset_version"),
            (c("last_day") + F.make_dt_interval(days=F.lit(1))).alias("created_at"),
            F.concat(F.lit("batch_"), c("ym")).alias("source_batch_id"),
            c("rows").alias("row_count"), c("customers").alias("order_count"),
            (c("month") >= 7).alias("sample"),
        )

    @cached_property
    def system_events(self) -> DataFrame:
        c = F.col
        return self.events.select(
            F.concat(F.lit("e"), c("event_id").cast("string")).alias("event_id"), c("ts").alias("created_at"),
            _mapped(c("event_type"), EVENT_TYPES).alias("event_type"),
            F.when(c("value") >= 20, "SUCCESS").otherwise("FAILED").alias("status"), c("props").alias("message"))

    @cached_property
    def nations(self) -> DataFrame:
        return self.orders_table.join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn(
            "model_id", F.concat(F.lit("m"), F.col("c_nationkey").cast("string")))

    @cached_property
    def models(self) -> DataFrame:
        """One model record per customer nation, with figures computed from its orders."""
        c = F.col

        def share(test: Column) -> Column:
            return F.count_if(test) / F.count("*")

        f, p, o = (share(c("o_orderstatus") == s) for s in "FPO")
        urgent = share(c("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        return self.nations.groupBy("model_id").agg(
            (0.70 + 0.35 * f).alias("val_roc_auc"), (0.55 + 0.5 * p).alias("val_pr_auc"),
            (0.12 + 0.3 * o).alias("val_brier"), (0.5 * urgent).alias("val_recall_at_90_precision"),
            (1000.0 * (p - 0.30)).alias("val_net_savings_per_1000_orders"),
            (0.75 + 0.4 * p).alias("test_roc_auc"), (0.60 + 0.5 * f).alias("test_pr_auc"),
            (0.05 + 0.3 * o).alias("test_brier"), (0.6 * urgent).alias("test_recall_at_90_precision"),
            (900.0 * (f - 0.30)).alias("test_net_savings_per_1000_orders"),
        )

    @cached_property
    def model_events(self) -> DataFrame:
        c = F.col

        def rows(df: DataFrame, kind: str) -> DataFrame:
            return df.select("model_id", F.lit(kind).alias("event"), c("o_orderdate").alias("at"))

        first = self.nations.groupBy("model_id").agg(F.min("o_orderdate").alias("o_orderdate"))
        return (
            rows(first, "REGISTER")
            .unionByName(rows(self.nations.filter(c("o_totalprice") > 400000), "CANDIDATE"))
            .unionByName(rows(self.nations.filter(c("o_totalprice") < 1500), "PROMOTE"))
        )

    @cached_property
    def request_log(self) -> DataFrame:
        c = F.col
        states = {
            "view": "RETRAINING_REQUIRED", "click": "RUNNING", "purchase": "CANDIDATE_READY",
            "signup": "COMPLETED_NO_CANDIDATE", "error": "FAILED",
        }
        user = c("user_id")
        return self.events.select(
            F.concat(F.lit("r"), user.cast("string")).alias("request_id"),
            F.concat(F.lit("m"), (user % 10).cast("string")).alias("model_version"),
            F.concat(F.lit("v"), (user % 3).cast("string")).alias("dataset_version"),
            F.when(user % 2 == 0, "SUSTAINED_DATA_DRIFT").otherwise("NEW_DATA_VERSION").alias("trigger_type"),
            _mapped(c("event_type"), states).alias("status"), c("ts").alias("updated_at"))

    @cached_property
    def health_checks(self) -> DataFrame:
        return self.events.select(
            F.col("event_type").alias("model_version"), F.col("ts").alias("checked_at"),
            (F.col("value") >= 20).alias("severe_drift"))

    @cached_property
    def signals(self) -> DataFrame:
        c = F.col
        return self.events.groupBy(c("event_type").alias("model_version")).agg(
            (F.avg((c("k") >= 50).cast("double")) * 0.5).alias("prediction_psi"),
            F.count_if(c("value") > 300).alias("severe_feature_drift_count"),
            F.count("*").alias("eligible_runtime_predictions"),
            F.count_if(c("k") < 75).alias("labeled_observations"),
            (0.6 + 0.4 * F.avg((c("k") < 50).cast("double"))).alias("roc_auc"),
            (0.3 * F.avg((c("value") >= 20).cast("double"))).alias("brier"),
            (F.count_if(c("value") > 100) - F.count_if(c("k") < 10)).cast("double").alias("net_savings_per_1000_orders"),
            (0.6 + 0.45 * F.avg((c("k") < 60).cast("double"))).alias("base_roc_auc"),
            (0.3 * F.avg((c("value") >= 40).cast("double"))).alias("base_brier"),
        ).withColumn("dataset_version", F.lit("v1"))
