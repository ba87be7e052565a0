"""One query per operator, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.tables import Tables
from orderlight.contract import NUMERIC_FEATURES, TARGET
from orderlight.functions import currency, economics, features, labels
from orderlight.functions.cleaning import normalize_ids
from orderlight.operators import (
    backtest, curves, decisions, drift, explain, latest, monitoring, quantiles, retraining, sampling, selection,
    snapshots, validation,
)
from orderlight.operators.orders import customer_history, smallest_mode
from orderlight.plans import ingest, registry, retrain, scoring, training
from orderlight.session import scratch_path, stored
from orderlight.sources import items as item_files
from orderlight.sources import models as model_files
from orderlight.sources.workspace import Workspace, read_snapshot, write_support_table
from orderlight.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
AS_OF = datetime(2002, 1, 1)
SUMMED = ["price", "discount_amount", "discount_ratio"]  # whose last bits depend on the order of addition
RATE = 0.00361


def query(build: Callable[[Tables], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


def shown(df: DataFrame, digits: int | None = None, *only: str) -> DataFrame:
    """Naive timestamps; doubles rounded where sums may differ in the last bits."""
    cols = []
    for c, t in df.dtypes:
        col = F.col(f"`{c}`")
        if t == "timestamp":
            col = col.cast("timestamp_ntz")
        elif t == "double" and digits is not None and (not only or c in only):
            col = F.round(col, digits) + F.lit(0.0)
        elif t.startswith("decimal"):
            col = col.cast("double")
        cols.append(col.alias(c))
    return df.select(*cols)


# ---- sources and sinks ----

@query
def read_items(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "items-csv")
    t.raw_items.write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    return _numbers_back(item_files.read_items(t.spark, path).drop("_ord")).withColumnRenamed("Customer ID", "customer_id")


def _numbers_back(items: DataFrame) -> DataFrame:
    """Numbers kept as text, as numbers: engines print doubles differently."""
    return items.withColumns({c: F.col(c).cast("double") for c in ("price", "grand_total", "discount_amount")})


@query
def read_snapshot_files(t: Tables) -> DataFrame:
    base = stored(t.history, "history")
    parquet, csv = scratch_path(t.spark, "snapshot") + ".parquet", scratch_path(t.spark, "snapshot") + ".csv.gz"
    base.write.parquet(parquet)
    base.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).write.option("header", True).option("compression", "gzip").csv(csv)
    both = read_snapshot(t.spark, parquet, base.columns).withColumn("kind", F.lit("parquet")).unionByName(
        read_snapshot(t.spark, csv, base.columns).withColumn("kind", F.lit("csv")))
    return shown(both, 9, *SUMMED)


def _workspace(t: Tables) -> Workspace:
    return Workspace(t.spark, scratch_path(t.spark, "workspace"))


def _raw_with_order(t: Tables) -> DataFrame:
    return stored(item_files.with_order(t.raw_items), "batch")


@query
def ingest_batch(t: Tables) -> DataFrame:
    """Two uploads: the items up to 1999, then everything (the earlier orders are existing)."""
    ws, rows = _workspace(t), _raw_with_order(t)
    ingest.ingest_items(ws, rows.filter(F.col("created_at") < "2000"), "b1", "first.csv", "k1", datetime(2002, 1, 1), prepared=True)
    ingest.ingest_items(ws, rows, "b2", "second.csv", "k2", datetime(2002, 1, 2), prepared=True)
    return shown(ws.snapshot().select(
        "order_id", "created_at", "customer_id", "grand_total", "is_canceled", "prev_orders", "prev_cancellations", "customer_cancel_rate"))


@query
def write_version(t: Tables) -> DataFrame:
    ws = _workspace(t)
    report = t.spark.createDataFrame([("required_columns", "PASS", 0, "All required columns present")], validation.REPORT_SCHEMA)
    rejected = ingest.appended_quarantine([validation.quarantined_rows(t.checked)])
    ws.write_version("v001", t.history, rejected, report, "b1", datetime(2002, 1, 1))
    ws.write_version("v002", t.history, rejected, report, "b2", datetime(2002, 1, 2))
    return shown(ws.versions().select("dataset_version", "created_at", "source_batch_id", "row_count", "order_count", "active"))


def _two_versions(t: Tables) -> Workspace:
    """The earlier orders as one version, then all of them."""
    ws = _workspace(t)
    orders = stored(t.history, "history")
    report = t.spark.createDataFrame([("required_columns", "PASS", 0, "Nothing is absent")], validation.REPORT_SCHEMA)
    rejected = ingest.appended_quarantine([validation.quarantined_rows(t.checked)])
    ws.write_version("v001", orders.filter(F.col("created_at") < "2000"), rejected.limit(0), report, "b1", datetime(2002, 1, 1), prepared=True)
    ws.write_version("v002", orders, rejected, report, "b2", datetime(2002, 1, 2), prepared=True)
    return ws


@query
def version_snapshot(t: Tables) -> DataFrame:
    """Both versions read back with all their columns: the older one stays as it was written."""
    ws = _two_versions(t)
    both = ws.snapshot("v001").withColumn("version", F.lit("v001")).unionByName(ws.snapshot().withColumn("version", F.lit("active")))
    return shown(both, 9, *SUMMED)


@query
def version_quarantine(t: Tables) -> DataFrame:
    """The rejected rows of a version, read back from its file."""
    ws = _two_versions(t)
    path = ws.versions().filter(F.col("dataset_version") == "v002").first()["quarantine_path"]
    rows = t.spark.read.option("header", True).csv(path)
    return _numbers_back(rows).select("increment_id", "sku", "created_at", "price", "grand_total", "discount_amount", "qty_ordered", "status", validation.REASON)


@query
def version_report(t: Tables) -> DataFrame:
    """The report of each version, read back from its file."""
    paths = [(r["dataset_version"], r["report_path"]) for r in _two_versions(t).versions().collect()]
    parts = [t.spark.read.schema(validation.REPORT_SCHEMA).json(p).withColumn("version", F.lit(v)) for v, p in sorted(paths)]
    return parts[0].unionByName(parts[1])


@query
def bronze(t: Tables) -> DataFrame:
    """The untouched copy under its original names."""
    kept = _workspace(t).write_raw(t.raw_items, "b1")
    return _numbers_back(kept).withColumnRenamed("Customer ID", "customer_id")


@query
def file_hash(t: Tables) -> DataFrame:
    path = f"{t.sf_dir}/orders.parquet"
    keys = [(m, item_files.batch_key(t.spark, path, m)) for m in ("full", "demo")]
    return t.spark.createDataFrame(keys, "run_mode STRING, file_hash STRING")


@query
def batch_dedupe(t: Tables) -> DataFrame:
    """Every order is an upload of its customer's file; customers with a balance are on record."""
    c = F.col
    incoming = t.orders_table.select(
        F.md5(c("o_custkey").cast("string")).alias("file_hash"), c("o_orderkey").cast("string").alias("filename"),
        c("o_orderdate").alias("uploaded_at"))
    ledger = t.read("customer").filter(c("c_acctbal") > 2000).select(
        F.md5(c("c_custkey").cast("string")).alias("file_hash"),
        F.when(c("c_mktsegment") == "BUILDING", "FAILED").otherwise("SUCCESS").alias("status"))
    return shown(ingest.reserve_batches(incoming, ledger))


@query
def batch_status(t: Tables) -> DataFrame:
    return shown(latest.latest_per_key(t.batch_log, ["batch_id"], "uploaded_at", "status"))


@query
def prediction_log(t: Tables) -> DataFrame:
    ws = _workspace(t)
    ws.append("predictions", t.predictions)
    ws.append("predictions", t.predictions.filter(F.col("event_type") == "click"))
    return shown(ws.predictions().select("prediction_id", "order_id", "predicted_at", "probability", "recommendation", "scoring_mode"))


@query
def support_tables(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "support")
    write_support_table(t.labeled.select("order_id", "is_canceled", "probability"), path)
    return t.spark.read.schema("order_id STRING, is_canceled INT, probability DOUBLE").option("header", True).csv(path)


def _summary_text(t: Tables) -> DataFrame:
    c = F.col
    val, test = ["roc_auc", "pr_auc", "brier", "recall_at_90_precision"], ["roc_auc", "pr_auc", "brier", "recall_at_90_precision"]
    money = "net_savings_per_1000_orders"
    record = F.struct(
        c("model_id"), F.upper("model_id").alias("display_name"), F.lit("scorecard").alias("model_family"),
        F.struct(*[c(f"val_{k}").alias(k) for k in val]).alias("val_metrics"),
        F.struct(*[c(f"test_{k}").alias(k) for k in test]).alias("test_metrics"),
        F.struct(c(f"val_{money}").alias(money)).alias("val_business_metrics"),
        F.struct(c(f"test_{money}").alias(money)).alias("business_metrics"),
        F.struct(c("qualified").alias("passed")).alias("qualification"),
    )
    # One record per model: the array is as long as the number of models.
    return selection.score_models(t.models).agg(
        F.to_json(F.struct(
            F.max(F.when(c("selected_candidate"), c("model_id"))).alias("candidate_model_id"),
            F.collect_list(record).alias("models"))).alias("text"))


@query
def benchmark_rows(t: Tables) -> DataFrame:
    return shown(model_files.benchmark_rows(model_files.parse_summaries(_summary_text(t), "text")).select(
        "model_id", "model", "qualified_on_validation", "selected_candidate", "validation_roc_auc", "validation_brier",
        "validation_net_savings_per_1000_orders", "test_roc_auc", "test_f1", "test_net_savings_per_1000_orders"))


@query
def seed_version(t: Tables) -> DataFrame:
    """Register the order snapshot once; the second call adds nothing."""
    ws, path = _workspace(t), scratch_path(t.spark, "seed") + ".parquet"
    t.history.write.parquet(path)
    added = [ingest.register_seed(ws, path, "seed_v1", datetime(2002, 1, 1)) for _ in range(2)]
    return ws.versions().select("dataset_version", "row_count", "order_count", "active").withColumn("added", F.lit(added == [True, False]))


@query
def scored_export(t: Tables) -> DataFrame:
    amount = F.col("o_totalprice")
    money = t.orders_table.select(
        F.col("o_orderkey").cast("string").alias("_id"), (amount / 8).alias("price"), amount.alias("grand_total"), (-amount / 16).alias("discount_amount"))
    scored = t.labeled.select("order_id", F.col("probability")).withColumns(economics.economics(F.col("probability")))
    scored = scored.join(money, F.col("order_id") == F.col("_id")).drop("_id")
    return shown(currency.scored_export(scored, RATE))


# ---- projections and scalar functions ----

@query
def normalize_identifiers(t: Tables) -> DataFrame:
    c = F.col
    key = c("o_orderkey").cast("string")
    messy = (
        F.when(c("o_orderpriority") == "1-URGENT", F.concat(F.lit(" "), key, F.lit("\t")))
        .when(c("o_orderpriority") == "2-HIGH", "nan").when(c("o_orderpriority") == "3-MEDIUM", "  ")
        .when(c("o_orderpriority") == "4-NOT SPECIFIED", "<NA>").otherwise(key)
    )
    df = t.orders_table.select(c("o_orderkey"), messy.alias("increment_id"), F.concat(c("o_custkey").cast("string"), F.lit(" ")).alias("Customer ID"))
    return normalize_ids(df).withColumnRenamed("Customer ID", "customer_id")


def _as_text_orders(t: Tables) -> DataFrame:
    c = F.col
    return t.orders_table.select(
        F.concat(F.lit(" "), c("o_orderkey").cast("string")).alias("order_id"),
        F.when(c("o_orderstatus") == "O", "soon").otherwise(F.date_format("o_orderdate", "M/d/yyyy")).alias("created_at"),
        F.when(c("o_custkey") > 10, c("o_custkey").cast("string")).otherwise("None").alias("customer_id"),
        F.when(c("o_orderpriority") == "5-LOW", "n/a").when(c("o_orderpriority") == "2-HIGH", "NaN")
        .otherwise(c("o_totalprice").cast("string")).alias("price"),
        F.when(c("o_orderstatus") == "P", "1").when(c("o_orderstatus") == "F", "0").otherwise("x").alias("is_canceled"),
        F.lit("3").alias("prev_orders"), c("o_orderstatus").alias("status"),
    )


@query
def normalize_schema(t: Tables) -> DataFrame:
    return shown(snapshots.normalize_snapshot(_as_text_orders(t)))


@query
def required_columns(t: Tables) -> DataFrame:
    """A batch without two required columns fails as a whole; its rows are all counted."""
    result = validation.check_items(t.raw_items.drop("price", "status"))
    return result.report_table(t.spark).withColumn("quarantined_rows", F.lit(result.counts["raw_rows"]).cast("bigint"))


@query
def validate_items(t: Tables) -> DataFrame:
    return t.checked.select(
        "increment_id", "sku", "created_at", "qty_ordered", "price", "status", validation.REASON, validation.COPIES
    ).withColumnRenamed(validation.COPIES, "copies")


@query
def quarantine_rows(t: Tables) -> DataFrame:
    _, odd = ingest.split_by_ids(t.valid, "increment_id", t.inconsistent, "inconsistent_order_status;")
    rows = ingest.appended_quarantine([validation.quarantined_rows(t.checked), odd])
    return rows.select("increment_id", "sku", "created_at", "payment_method", "category_name_1", validation.REASON)


@query
def valid_items(t: Tables) -> DataFrame:
    return shown(t.valid.drop("_ord").withColumnRenamed("Customer ID", "customer_id"))


@query
def row_features(t: Tables) -> DataFrame:
    return shown(features.row_features(t.valid).select(
        "increment_id", "sku", "price", "day_of_week", "hour", "discount_ratio", "is_cod", "has_discount", "is_canceled"))


@query
def inference_features(t: Tables) -> DataFrame:
    c = F.col
    raw = t.orders_table.select(
        c("o_orderkey").alias("order_id"),
        F.when(c("o_orderstatus") != "O", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("created_at"),
        c("o_totalprice").cast("string").alias("price"), F.lit("2").alias("qty_ordered"),
        (c("o_totalprice") * 2.0).alias("grand_total"), (c("o_custkey") % 3).cast("string").alias("discount_amount"),
        F.when(c("o_orderpriority") == "1-URGENT", "COD").when(c("o_orderpriority") != "5-LOW", "Payaxis").alias("payment_method"),
        F.when(c("o_orderstatus") == "F", "Beauty").alias("category_name_1"),
        F.when(c("o_orderpriority") == "2-HIGH", "unknown").otherwise((c("o_custkey") / 1000.0).cast("string")).alias("customer_cancel_rate"),
    )
    return shown(features.inference_features(raw, "2002-01-01 05:00:00"))


@query
def model_frame(t: Tables) -> DataFrame:
    return shown(features.model_frame(t.history, ["order_id"]), 9)


@query
def economic_decision(t: Tables) -> DataFrame:
    return t.labeled.select("order_id", "probability").withColumns(economics.economics(F.col("probability")))


@query
def policy_effective(t: Tables) -> DataFrame:
    """Stored policy texts per order: some partial, some with foreign keys, some unreadable."""
    c = F.col
    text = (
        F.when(c("o_orderpriority") == "1-URGENT", F.concat(F.lit('{"intervention_cost": '), c("o_custkey").cast("string"), F.lit("}")))
        .when(c("o_orderpriority") == "2-HIGH", '{"intervention_effectiveness": 0.25, "color": "red"}')
        .when(c("o_orderpriority") == "3-MEDIUM", "not json")
        .when(c("o_orderpriority") == "4-NOT SPECIFIED", '{"intervention_cost": "free", "false_positive_friction_cost": 1}')
        .otherwise("{}")
    )
    return economics.effective_policy(t.orders_table.select("o_orderkey", text.alias("policy_json"))).drop("policy_json")


@query
def score_batch(t: Tables) -> DataFrame:
    scored = scoring.scored_orders(t.history, scoring.by_expression(scoring.softsign_score), 0.41)
    return shown(scored.select(
        "order_id", "cancellation_probability", "risk_level", "expected_avoidable_cost", "expected_false_positive_cost",
        "net_expected_savings", "recommendation"))


@query
def risk_band(t: Tables) -> DataFrame:
    return t.labeled.select("order_id", labels.risk_band(F.col("probability")).alias("risk_band"))


@query
def monitoring_population(t: Tables) -> DataFrame:
    return monitoring.with_population(t.predictions).select("prediction_id", "monitoring_mode", "eligible")


@query
def outcome_norm(t: Tables) -> DataFrame:
    return t.predictions.select(
        "prediction_id", labels.outcome_flag(F.col("actual_outcome")).alias("label"),
        labels.outcome_text(F.col("actual_outcome")).alias("outcome"))


@query
def currency_convert(t: Tables) -> DataFrame:
    c = F.col
    amount = F.when(c("o_orderstatus") == "P", -c("o_totalprice")).otherwise(c("o_totalprice"))
    usd = currency.to_usd(amount, RATE)
    return t.orders_table.select(
        "o_orderkey", usd.alias("usd"), currency.to_pkr(usd, RATE).alias("pkr"), currency.usd_text(amount, RATE).alias("text"))


@query
def order_lifecycle(t: Tables) -> DataFrame:
    return shown(decisions.order_lifecycle(t.predictions, t.decisions))


@query
def feature_payload(t: Tables) -> DataFrame:
    return features.read_payload(t.predictions, keep=["prediction_id"])


@query
def model_health(t: Tables) -> DataFrame:
    return selection.with_health(t.models).select("model_id", "health")


@query
def whatif_scenarios(t: Tables) -> DataFrame:
    return shown(backtest.whatif_scenarios(t.labeled, "is_canceled", "probability"), 6)


@query
def traffic_population(t: Tables) -> DataFrame:
    return monitoring.traffic_population(t.predictions)


# ---- joins ----

@query
def order_snapshot(t: Tables) -> DataFrame:
    return shown(t.orders, 9)


@query
def business_impact(t: Tables) -> DataFrame:
    return shown(monitoring.business_impact(t.predictions, t.decisions), 4)


@query
def review_queue(t: Tables) -> DataFrame:
    return shown(decisions.review_queue(decisions.order_lifecycle(t.predictions, t.decisions), t.predictions))


def _earlier_orders(t: Tables) -> DataFrame:
    return t.orders_table.filter(F.col("o_orderdate") < "1998-01-01").select(F.col("o_orderkey").cast("string").alias("order_id"))


@query
def quarantine_existing(t: Tables) -> DataFrame:
    seen = stored(validation.existing_orders(t.kept, "increment_id", _earlier_orders(t)), "existing")
    _, out = ingest.split_by_ids(t.kept, "increment_id", seen, "existing_order_id;")
    return out.select("increment_id", "sku", validation.REASON)


@query
def new_orders_only(t: Tables) -> DataFrame:
    seen = stored(validation.existing_orders(t.kept, "increment_id", _earlier_orders(t)), "existing")
    new, _ = ingest.split_by_ids(t.kept, "increment_id", seen, "existing_order_id;")
    return new.select("increment_id", "sku", "price")


@query
def apply_outcomes(t: Tables) -> DataFrame:
    return monitoring.apply_outcomes(t.predictions, t.feedback, "seq").select("prediction_id", "order_id", "actual_outcome")


@query
def sensitivity_grid(t: Tables) -> DataFrame:
    return shown(backtest.sensitivity_grid(
        t.labeled, "is_canceled", "probability", [1000, 2000, 4000], [0.25, 0.55, 0.85], [75, 150, 1500]), 6)


@query
def categorical_tv(t: Tables) -> DataFrame:
    return shown(drift.total_variation_table(t.reference, t.predictions, ["category_name_1", "payment_method"]), 9)


@query
def lookup(t: Tables) -> DataFrame:
    """The production model's record, found by id from its lifecycle."""
    return selection.production_record(t.models, t.model_events).select("model_id", "val_roc_auc", "test_roc_auc")


# ---- aggregations ----

@query
def group_mode(t: Tables) -> DataFrame:
    return t.kept.groupBy(F.col("increment_id").alias("order_id")).agg(
        smallest_mode(F.col("category_name_1")).alias("category_mode"), smallest_mode(F.col("payment_method")).alias("payment_mode"))


@query
def validation_report(t: Tables) -> DataFrame:
    counts = validation.row_check_counts(t.checked).first().asDict()
    odd = t.inconsistent.count()
    rows = validation.report_rows(counts, "increment_id") + [(
        "order_status_consistency", "WARN" if odd else "PASS", odd, "Orders whose items end in different statuses")]
    return t.spark.createDataFrame(rows, validation.REPORT_SCHEMA)


@query
def inconsistent_orders(t: Tables) -> DataFrame:
    return t.inconsistent


@query
def queue_counts(t: Tables) -> DataFrame:
    return decisions.queue_counts(decisions.order_lifecycle(t.predictions, t.decisions))


@query
def policy_backtest(t: Tables) -> DataFrame:
    return shown(backtest.policy_backtest(t.labeled, "is_canceled", "probability"), 6)


@query
def business_actions(t: Tables) -> DataFrame:
    return monitoring.business_actions(t.predictions, t.decisions).select(
        "prediction_id", "order_id", "monitoring_mode", "manager_decision", "business_action")


@query
def mode_counts(t: Tables) -> DataFrame:
    return monitoring.mode_counts(t.predictions)


@query
def raw_mode_counts(t: Tables) -> DataFrame:
    return monitoring.raw_mode_counts(t.predictions)


@query
def runtime_summary(t: Tables) -> DataFrame:
    return shown(monitoring.runtime_summary(t.predictions), 4)


@query
def pipeline_reliability(t: Tables) -> DataFrame:
    batches = latest.latest_per_key(t.batch_log, ["batch_id"], "uploaded_at", "status")
    return monitoring.pipeline_reliability(batches, t.system_events)


PSI_FEATURES = ["price", "qty_ordered", "grand_total", "discount_amount", "hour", "is_cod", "customer_cancel_rate"]


@query
def psi(t: Tables) -> DataFrame:
    return shown(drift.psi_table(t.reference, t.predictions, PSI_FEATURES), 9)


@query
def feature_drift(t: Tables) -> DataFrame:
    current = features.read_payload(monitoring.production_traffic(t.predictions))
    return shown(drift.feature_drift(t.reference, current), 9)


@query
def profile_drift(t: Tables) -> DataFrame:
    """Drift against a profile that was written once, made with kept sketches of two parts."""
    columns = [c for c in NUMERIC_FEATURES if c in t.reference.columns]
    cheap = F.coalesce(F.col("price") < 150, F.lit(False))
    parts = [quantiles.quantile_sketches(t.reference.filter(p), columns) for p in (cheap, ~cheap)]
    sketches = stored(quantiles.merged_sketches(stored(parts[0].unionByName(parts[1]), "sketches")), "merged")
    profile = stored(drift.reference_profile(t.reference, sketches=sketches), "profile")
    current = features.read_payload(monitoring.production_traffic(t.predictions))
    return shown(drift.profile_drift(profile, current), 9)


@query
def kept_checks(t: Tables) -> DataFrame:
    return shown(retraining.kept_history(retraining.recorded_checks(t.health_checks)))


@query
def severe_drift(t: Tables) -> DataFrame:
    traffic = monitoring.production_traffic(t.predictions)
    p = drift.psi_table(
        t.labeled.select("probability"), traffic.select("probability"), ["probability"]).first()["psi"]
    table = drift.feature_drift(t.reference, features.read_payload(traffic))
    return drift.severe_drift(table, F.lit(traffic.count()), F.lit(p))


@query
def point_metrics(t: Tables) -> DataFrame:
    return shown(curves.point_metrics(t.labeled, "is_canceled", "probability", 0.41), 9)


def _points(t: Tables) -> DataFrame:
    return curves.curve_points(t.labeled, "is_canceled", "probability")


@query
def average_precision(t: Tables) -> DataFrame:
    return shown(curves.average_precision(_points(t)), 9)


@query
def roc_auc(t: Tables) -> DataFrame:
    return shown(curves.roc_auc(_points(t)), 9)


@query
def classification_metrics(t: Tables) -> DataFrame:
    return shown(curves.classification_metrics(_points(t), F.lit(0.41)), 9)


@query
def best_f1_threshold(t: Tables) -> DataFrame:
    return shown(curves.best_f1_threshold(t.labeled, "is_canceled", "probability"), 9)


@query
def recall_at_precision(t: Tables) -> DataFrame:
    return shown(curves.recall_at_precision(_points(t), (0.40, 0.80, 0.90, 0.999)), 9)


@query
def roc_curve(t: Tables) -> DataFrame:
    return shown(curves.roc_points(_points(t)), 9, "fpr", "tpr")


@query
def pr_curve(t: Tables) -> DataFrame:
    return shown(curves.pr_points(_points(t)), 9, "precision", "recall")


@query
def calibration_bins(t: Tables) -> DataFrame:
    return shown(curves.calibration_bins(t.labeled, "is_canceled", "probability"), 9)


@query
def split_stats(t: Tables) -> DataFrame:
    return shown(training.split_stats(sampling.temporal_split(t.labeled)), 9)


@query
def prediction_summary(t: Tables) -> DataFrame:
    return shown(curves.prediction_summary(t.labeled, "probability"), 9)


@query
def feature_baseline(t: Tables) -> DataFrame:
    return shown(explain.baseline_table(t.history), 9)


@query
def labeled_performance(t: Tables) -> DataFrame:
    return shown(monitoring.labeled_performance(t.predictions), 6)


@query
def seed_report(t: Tables) -> DataFrame:
    return ingest.seed_report(validation.row_check_counts(t.checked), t.orders)


@query
def dataset_fingerprint(t: Tables) -> DataFrame:
    """Digest of the snapshot, also when its rows are shuffled."""
    a = training.dataset_fingerprint(t.history)
    b = training.dataset_fingerprint(t.history.repartition(7, "price"))
    return t.spark.createDataFrame([(a, a == b)], "fingerprint STRING, stable BOOLEAN")


@query
def queue_mix(t: Tables) -> DataFrame:
    return shown(sampling.queue_mix(t.labeled.withColumn("simulation_risk_band", labels.risk_band(F.col("probability")))), 9)


@query
def feature_domains(t: Tables) -> DataFrame:
    return explain.feature_domains(t.kept, ["category_name_1", "payment_method"])


# ---- cumulative and latest-wins ----

@query
def customer_history_rows(t: Tables) -> DataFrame:
    return t.history.select("order_id", "customer_id", "prev_orders", "prev_cancellations", "customer_cancel_rate")


@query
def customer_history_hot(t: Tables) -> DataFrame:
    """Same result with the range-partitioned path forced for customers above five orders."""
    return customer_history(t.orders, hot_rows=5, prepared=True).select(
        "order_id", "customer_id", "prev_orders", "prev_cancellations", "customer_cancel_rate")


@query
def duplicate_rows(t: Tables) -> DataFrame:
    return t.checked.filter(F.col(validation.COPIES) > 1).select(
        "increment_id", "sku", "created_at", (F.col(validation.COPIES) - 1).alias("extra_copies"))


@query
def latest_per_order(t: Tables) -> DataFrame:
    return shown(monitoring.latest_predictions(t.predictions).select("prediction_id", "order_id", "predicted_at", "probability"))


@query
def latest_decision(t: Tables) -> DataFrame:
    return shown(monitoring.latest_decisions(t.decisions))


def _old_and_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders up to 1999, and the rest plus restated card orders of the first part."""
    old = t.orders.filter(F.col("created_at") < "2000-01-01")
    again = old.filter(F.col("payment_method") == "Payaxis").withColumns({
        "created_at": F.col("created_at") + F.make_dt_interval(days=F.lit(400)),
        "is_canceled": 1 - F.col("is_canceled"),
        "status": F.when(F.col("is_canceled") == 0, "canceled").otherwise("complete"),
    })
    return old, t.orders.filter(F.col("created_at") >= "2000-01-01").unionByName(again)


CUMULATIVE = ["order_id", "created_at", "customer_id", "is_canceled", "status", "prev_orders", "prev_cancellations", "customer_cancel_rate"]


@query
def cumulative_snapshot(t: Tables) -> DataFrame:
    return shown(snapshots.cumulative_snapshot(*_old_and_new(t)).select(*CUMULATIVE))


@query
def extended_snapshot(t: Tables) -> DataFrame:
    """The incremental merge; compared with the full recomputation."""
    old, new = _old_and_new(t)
    return shown(snapshots.extended_snapshot(stored(customer_history(old), "old"), new).select(*CUMULATIVE))


@query
def active_version(t: Tables) -> DataFrame:
    return shown(snapshots.active_version(snapshots.version_states(t.version_log)).drop("sample"))


@query
def temporal_split(t: Tables) -> DataFrame:
    return sampling.temporal_split(t.labeled).select("order_id", "split")


@query
def quick_sample(t: Tables) -> DataFrame:
    return shown(sampling.time_spanning_sample(t.labeled, 1000).select("order_id", "created_at"))


@query
def health_checks(t: Tables) -> DataFrame:
    return shown(retraining.recorded_checks(t.health_checks))


@query
def sustained_drift(t: Tables) -> DataFrame:
    return retraining.sustained_drift(retraining.recorded_checks(t.health_checks))


@query
def open_request(t: Tables) -> DataFrame:
    return shown(retraining.open_requests(retraining.request_status(t.request_log)))


@query
def select_candidate(t: Tables) -> DataFrame:
    return shown(selection.score_models(t.models).select("model_id", "qualified", "selection_score", "selected_candidate"), 9)


# ---- newest first ----

@query
def decision_history(t: Tables) -> DataFrame:
    return shown(decisions.decision_history(decisions.decision_log(t.decisions, t.predictions)))


@query
def recent_events(t: Tables) -> DataFrame:
    return shown(latest.newest(t.system_events, 10, "created_at", "event_id"))


@query
def version_history(t: Tables) -> DataFrame:
    return shown(snapshots.version_states(t.version_log).orderBy(F.col("created_at").desc()))


@query
def risk_trend(t: Tables) -> DataFrame:
    return shown(monitoring.risk_trend(t.predictions), 9)


# ---- samples ----

@query
def sample_orders(t: Tables) -> DataFrame:
    return sampling.sample_orders(t.raw_items, "increment_id", 500).select("increment_id", "sku", "price")


@query
def reference_sample(t: Tables) -> DataFrame:
    train = sampling.temporal_split(t.labeled).filter(F.col("split") == "train")
    return sampling.sample_rows(train, "order_id", 2000).select("order_id", "is_canceled")


@query
def stratified_sample(t: Tables) -> DataFrame:
    return sampling.stratified_sample(t.labeled, "order_id", "probability").select(
        "order_id", "simulation_risk_band", "queue_position")


# ---- explanations and decisions ----

@query
def risk_drivers(t: Tables) -> DataFrame:
    orders = stored(t.history, "history")
    base = explain.feature_baseline(orders)
    found = explain.risk_drivers(orders, scoring.softsign_score, base)
    return shown(found.select("order_id", F.posexplode("drivers").alias("place", "d")).select(
        "order_id", "place", "d.feature", "d.impact"), 9)


@query
def decision_log(t: Tables) -> DataFrame:
    return shown(decisions.decision_log(t.decisions, t.predictions))


# ---- models and retraining ----

@query
def split_check(t: Tables) -> DataFrame:
    return training.split_check(sampling.temporal_split(t.labeled))


@query
def split_manifest(t: Tables) -> DataFrame:
    return training.split_manifest(sampling.temporal_split(t.labeled))


@query
def qualify_models(t: Tables) -> DataFrame:
    return selection.qualify_models(t.models).select("model_id", *selection.GATE_COLUMNS, "qualified")


@query
def legacy_score(t: Tables) -> DataFrame:
    c = F.col
    return shown(t.models.select("model_id", selection.earlier_selection_score(
        c("test_roc_auc"), c("test_pr_auc"), c("test_brier")).alias("score")), 9)


@query
def model_comparison(t: Tables) -> DataFrame:
    status = selection.current_status(t.model_events).select("model_id", "status")
    return selection.model_comparison(t.models.join(F.broadcast(status), "model_id"))


@query
def model_lifecycle(t: Tables) -> DataFrame:
    return shown(selection.current_status(t.model_events))


@query
def confirmed_degradation(t: Tables) -> DataFrame:
    c = F.col
    return t.signals.select("model_version", F.concat_ws(",", retraining.degradation_reasons(
        c("labeled_observations"), c("roc_auc"), c("brier"), c("net_savings_per_1000_orders"),
        c("base_roc_auc"), c("base_brier"))).alias("reasons"))


@query
def retraining_trigger(t: Tables) -> DataFrame:
    sustained = retraining.sustained_drift(retraining.recorded_checks(t.health_checks))
    return retraining.evaluated_policy(t.signals, sustained).select(
        "model_version", "severe_drift", "sustained_drift", "trigger_type", "triggered")


@query
def new_data_request(t: Tables) -> DataFrame:
    return shown(retraining.new_data_requests(t.version_log, "m1"))


@query
def needed_requests(t: Tables) -> DataFrame:
    """Trigger signals that no open request covers: those logged, and a manual one for each logged model and data set."""
    logged = t.request_log.select("model_version", "dataset_version", "trigger_type")
    wanted = logged.unionByName(logged.withColumn("trigger_type", F.lit("MANUAL_REQUEST"))).distinct()
    return retraining.needed_requests(wanted, retraining.request_status(t.request_log))


@query
def request_status(t: Tables) -> DataFrame:
    return shown(retraining.request_status(t.request_log))


@query
def training_snapshot(t: Tables) -> DataFrame:
    """The rows of the time-spanning sample."""
    data = retrain.training_snapshot(t.labeled, {"training_scope": "fast_prototype", "max_training_rows": 6000})
    return shown(data.select("order_id", "created_at", "is_canceled"))


def _training_orders(t: Tables) -> DataFrame:
    """Orders whose label follows their features, so models have something to learn."""
    c = F.col
    return t.reference.withColumn(
        TARGET, ((c("customer_cancel_rate") > 0.55) | ((c("is_cod") == 1) & (c("price") > 200))).cast("int"))


METRICS = ["model_family", "threshold", "val_roc_auc", "val_pr_auc", "val_brier", "test_roc_auc", "test_pr_auc", "qualified", "selected_candidate"]


def _one_family(t: Tables, family: str) -> DataFrame:
    return training.train_suite(_training_orders(t), "v1", [family]).records.select(*METRICS)


@query
def preprocess(t: Tables) -> DataFrame:
    """Encoded training rows: one vector of numbers and one-hot texts per order."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    p = training.prepared_snapshot(_training_orders(t))
    rows = training.imputed(p.table, p.fill)
    model = Pipeline(stages=training.encoder_stages(scaled=True)).fit(rows.filter(F.col("split") == "train"))
    return model.transform(rows).select("order_id", "split", F.size(vector_to_array("features")).alias("width"))


@query
def train_lr(t: Tables) -> DataFrame:
    return _one_family(t, "logistic_regression")


@query
def train_rf(t: Tables) -> DataFrame:
    return _one_family(t, "random_forest")


@query
def train_gbt(t: Tables) -> DataFrame:
    return _one_family(t, "boosted_trees")


@query
def train_suite(t: Tables) -> DataFrame:
    return training.train_suite(_training_orders(t), "v1").records.select(*METRICS)


@query
def tuned_run(t: Tables) -> DataFrame:
    return training.tuned_run(_training_orders(t), "v1", "random_forest", {"max_depth": 10, "min_samples_leaf": 5}).records.select(*METRICS)


@query
def cross_validate(t: Tables) -> DataFrame:
    space = {"max_iter": [200, 600], "C": [0.03, 0.1, 0.3, 1.0, 3.0]}
    return training.cross_validate(_training_orders(t), "logistic_regression", training.random_parameters(space, 5))


@query
def feature_importance(t: Tables) -> DataFrame:
    p = training.prepared_snapshot(_training_orders(t))
    model = training.fit_family(p, "random_forest")
    return t.spark.createDataFrame(training.feature_importance(model), "feature STRING, importance DOUBLE")


@query
def top_importances(t: Tables) -> DataFrame:
    """The 15 levels of the text features that go with cancellation most: importance is how far a level's canceled
    orders, times all orders, lie from its share of all canceled ones (whole numbers, so exact)."""
    levels = [F.concat(F.lit(f"{c}="), F.col(c)).alias("feature") for c in ("category_name_1", "payment_method")]
    rows = t.history.select("is_canceled", F.explode(F.array(*levels)).alias("feature"))
    counts = rows.groupBy("feature").agg(F.count("*").alias("n"), F.sum("is_canceled").alias("c"))
    total = t.history.agg(F.count("*").alias("all_n"), F.sum("is_canceled").alias("all_c")).first()
    found = counts.select("feature", F.abs(F.col("c") * F.lit(total["all_n"]) - F.col("n") * F.lit(total["all_c"])).cast("double").alias("importance"))
    return selection.top_importances(found)


@query
def model_risk_drivers(t: Tables) -> DataFrame:
    p = training.prepared_snapshot(_training_orders(t))
    model = training.fit_family(p, "logistic_regression")
    test = p.table.filter(F.col("split") == "test")
    return explain.model_risk_drivers(test, lambda df: training.predicted(model, df, p.fill), p.fill)


def _trained_workspace(t: Tables) -> Workspace:
    ws = _workspace(t)
    orders = _training_orders(t).withColumns({
        "customer_id": F.lit("c"), "status": F.when(F.col(TARGET) == 1, "canceled").otherwise("complete"),
        "prev_orders": F.lit(0), "prev_cancellations": F.lit(0),
    })
    report = t.spark.createDataFrame([], validation.REPORT_SCHEMA)
    ws.write_version("v001", orders.select(*snapshots.SNAPSHOT_COLUMNS), t.spark.createDataFrame([], "quarantine_reason STRING"), report, "b1", datetime(2002, 1, 1))
    return ws


@query
def retraining_run(t: Tables) -> DataFrame:
    """Request, training and candidate on a stored version; production is untouched."""
    ws = _trained_workspace(t)
    request = retrain.create_request(ws, "m0", "v001", "NEW_DATA_VERSION", datetime(2002, 1, 2))
    retrain.run_retraining(ws, request, datetime(2002, 1, 3), datetime(2002, 1, 4))
    status = retrain.current_requests(ws).first()["status"]
    return selection.current_status(ws.ledger("model_events")).select("model_id", "status", F.lit(status).alias("request_status"))


@query
def support_set(t: Tables) -> DataFrame:
    """The four support tables of a split by the writer of the suite, read back: rows, orders, and rows outside their part."""
    table = stored(sampling.temporal_split(t.labeled), "support-split")
    test = table.filter(F.col("split") == "test").select("order_id", "is_canceled", "probability")
    paths = training.support_tables(table.drop("probability"), test, scratch_path(t.spark, "support-set"))
    parts = table.select(F.col("order_id").alias("_id"), "split")
    found = None
    for name, path in paths.items():
        part = "train" if name == "reference_orders" else "test"
        rows = t.spark.read.option("header", True).csv(path).select("order_id").join(parts, F.col("order_id") == F.col("_id"), "left")
        one = rows.agg(F.count("*").alias("n_rows"), F.count_distinct("order_id").alias("n_orders"),
                       F.count_if(~F.col("split").eqNullSafe(F.lit(part))).alias("n_outside")).select(F.lit(name).alias("support_table"), "*")
        found = one if found is None else found.unionByName(one)
    return found


@query
def imported_model(t: Tables) -> DataFrame:
    """A model packaged in one workspace, imported as candidate into another and promoted there: status and support."""
    result = training.train_suite(_training_orders(t), "v1", ["logistic_regression"], {"logistic_regression": {"max_iter": 50}})
    ws, model_id = _workspace(t), "logistic_regression__run"
    path = registry.package_model(result, model_id, scratch_path(t.spark, "package"))
    registry.import_candidate(ws, path, datetime(2002, 1, 1))
    status = registry.promote(ws, model_id, datetime(2002, 1, 2)).select("model_id", "status")
    support = registry.production_support(ws).select("model_id", "rebuilt", "holdout_rows", "train_rate", "validation_rate", "test_rate")
    return shown(status.join(F.broadcast(support), "model_id"), 9)


@query
def final_benchmark(t: Tables) -> DataFrame:
    records, flags = retrain.final_benchmark(_training_orders(t), "v1")
    return records.select(*METRICS).withColumns({k: F.lit(v) for k, v in flags.items()})


# ---- streams (each drains its input once) ----

def _event_stream(t: Tables) -> DataFrame:
    schema = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))


def _finish(query_) -> None:
    query_.awaitTermination()
    if query_.exception() is not None:
        raise query_.exception()


@query
def stream_score(t: Tables) -> DataFrame:
    schema = t.spark.read.parquet(f"{t.sf_dir}/orders.parquet").schema
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(t.sf_dir)
    c = F.col
    rows = features.inference_features(raw.select(
        c("o_orderkey").cast("string").alias("order_id"), c("o_orderdate").cast("timestamp").alias("created_at"),
        c("o_totalprice").alias("price"), F.lit(1.0).alias("qty_ordered"), c("o_totalprice").alias("grand_total"),
        F.lit(0.0).alias("discount_amount"),
        F.when(c("o_orderpriority") == "1-URGENT", "cod").otherwise("Payaxis").alias("payment_method"),
        F.lit("all").alias("category_name_1"), ((c("o_custkey") % 100) / 100.0).alias("customer_cancel_rate"),
    ), "2002-01-01 00:00:00", strict=False)
    path = scratch_path(t.spark, "scores")
    _finish(jobs.start_scoring(
        rows, scoring.by_expression(scoring.softsign_score), path, scratch_path(t.spark, "cp"), 0.41,
        "2002-01-01 00:00:00", "scorecard", "m1"))
    return t.spark.read.parquet(path).select("order_id", "probability", "recommendation", "scoring_mode")


@query
def stream_lifecycle(t: Tables) -> DataFrame:
    stream = _event_stream(t)
    live = Tables(t.spark, t.sf_dir)
    live.events = stream
    path = scratch_path(t.spark, "decisions")
    _finish(jobs.start_decisions(live.decisions, path, scratch_path(t.spark, "cp")))
    return shown(jobs.lifecycle_view(t.predictions, t.spark.read.parquet(path)))


@query
def stream_risk_trend(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "trend")
    _finish(jobs.start_risk_trend(t.as_predictions(_event_stream(t)), path, scratch_path(t.spark, "cp")))
    return shown(jobs.current_trend(t.spark.read.parquet(path)), 9)


@query
def stream_ingest(t: Tables) -> DataFrame:
    """The item batch arrives as files; each micro-batch is one upload."""
    ws, source = _workspace(t), scratch_path(t.spark, "drop")
    item_files.with_order(t.raw_items).write.parquet(source)
    stream = t.spark.readStream.schema(t.spark.read.parquet(source).schema).parquet(source)
    _finish(jobs.start_ingest(stream, ws, scratch_path(t.spark, "cp"), lambda n: datetime(2002, 1, 1 + n)))
    return shown(ws.snapshot().select("order_id", "created_at", "is_canceled", "prev_orders", "prev_cancellations"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected net savings of verifying, by category, on the order snapshot with history."""
    t = Tables(spark, sf_dir)
    scored = scoring.scored_orders(t.history, scoring.by_expression(scoring.softsign_score), 0.41)
    return shown(scored.groupBy("category_name_1", "recommendation").agg(
        F.count("*").alias("orders"), F.avg("cancellation_probability").alias("average_risk"),
        F.sum("net_expected_savings").alias("net_expected_savings")), 4)


@query
def savings_by_category(t: Tables) -> DataFrame:
    return flagship(t.spark, t.sf_dir)
