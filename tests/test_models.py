"""Qualification, selection, lifecycle, training and retraining."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orderlight.contract import FEATURES, TARGET
from orderlight.operators import explain, retraining, selection
from orderlight.operators.orders import aggregate_to_orders, customer_history
from orderlight.operators.validation import check_items
from orderlight.plans import registry, retrain, training
from orderlight.sources import models as model_files
from orderlight.sources.items import generated_items, with_order
from orderlight.sources.schemas import SUITE_SUMMARY
from tests.conftest import rows

MODEL = """model_id STRING, val_roc_auc DOUBLE, val_pr_auc DOUBLE, val_brier DOUBLE, val_recall_at_90_precision DOUBLE,
val_net_savings_per_1000_orders DOUBLE, test_roc_auc DOUBLE"""
T0 = datetime(2024, 1, 1)


def models(spark, *data):
    return spark.createDataFrame(list(data), MODEL)


def test_selection_ignores_test_metrics(spark):
    df = models(spark, ("A", .82, .80, .15, .3, 100.0, .99), ("B", .93, .90, .10, .5, 100.0, .80))
    assert rows(selection.select_candidate(df), "model_id") == [("B",)]


def test_gates_come_before_the_score(spark):
    df = models(spark, ("weak", .70, .99, .01, .9, 9e9, .9), ("good", .85, .80, .15, .3, 50.0, .9), ("better", .90, .88, .12, .5, 60.0, .9))
    out = {r["model_id"]: r for r in selection.score_models(df).collect()}
    assert not out["weak"]["qualified"] and out["weak"]["selection_score"] is None
    assert out["better"]["selected_candidate"]
    assert out["better"]["selection_score"] == pytest.approx(.25 * .90 + .25 * .88 + .20 * .88 + .15 * .5 + .15)


def test_equal_savings_and_missing_evidence(spark):
    df = models(spark, ("a", .85, .80, .15, .3, 10.0, .9), ("b", .85, .80, .15, None, 10.0, .9))
    out = {r["model_id"]: r for r in selection.score_models(df).collect()}
    assert out["a"]["selection_score"] == pytest.approx(.25 * .85 + .25 * .80 + .20 * .85 + .15 * .3 + .15)
    assert not out["b"]["qualified"]
    assert selection.select_candidate(df.filter("model_id = 'b'")).count() == 0


def events(spark, *data):
    return spark.createDataFrame([(m, e, T0 + timedelta(days=d)) for m, e, d in data], "model_id STRING, event STRING, at TIMESTAMP")


def status(spark, *data):
    return dict(rows(selection.current_status(events(spark, *data)), "model_id", "status"))


def test_one_candidate_and_one_production(spark):
    base = [("a", "REGISTER", 0), ("b", "REGISTER", 0), ("c", "REGISTER", 0)]
    assert status(spark, *base) == {"a": "READY", "b": "READY", "c": "READY"}
    assert status(spark, *base, ("a", "CANDIDATE", 1), ("b", "CANDIDATE", 2)) == {"a": "READY", "b": "CANDIDATE", "c": "READY"}
    promoted = [*base, ("b", "CANDIDATE", 2), ("b", "PROMOTE", 3)]
    assert status(spark, *promoted) == {"a": "READY", "b": "PRODUCTION", "c": "READY"}
    assert status(spark, *promoted, ("c", "CANDIDATE", 4)) == {"a": "READY", "b": "PRODUCTION", "c": "CANDIDATE"}
    assert status(spark, *promoted, ("c", "CANDIDATE", 4), ("c", "PROMOTE", 5)) == {"a": "READY", "b": "READY", "c": "PRODUCTION"}
    # Marking the production model as candidate leaves it in production.
    assert status(spark, *promoted, ("b", "CANDIDATE", 4))["b"] == "PRODUCTION"


def test_settings():
    assert retraining.normalized_settings({"training_scope": "fast_prototype", "max_training_rows": 10}) == {
        **retraining.DEFAULT_SETTINGS, "training_scope": "quick_sample", "max_training_rows": 5000}
    assert retraining.normalized_settings({"training_scope": "other", "deployment_policy": "x"})["training_scope"] == "full_dataset"


def checks(spark, *data):
    return spark.createDataFrame([(m, T0 + timedelta(minutes=t), s) for m, t, s in data], "model_version STRING, checked_at TIMESTAMP, severe_drift BOOLEAN")


def test_checks_closer_than_thirty_minutes_are_dropped(spark):
    out = retraining.recorded_checks(checks(
        spark, ("m", 0, False), ("m", 29, True), ("m", 30, True), ("m", 45, False), ("m", 59, False), ("m", 61, True), ("n", 10, True), ("m", 0, False)))
    minutes = sorted((r["model_version"], int((r["checked_at"] - T0).total_seconds() // 60)) for r in out.collect())
    assert minutes == [("m", 0), ("m", 30), ("m", 61), ("n", 10)]
    assert dict(rows(retraining.sustained_drift(out), "model_version", "sustained_drift")) == {"m": True, "n": False}


def test_triggers(spark):
    schema = """model_version STRING, prediction_psi DOUBLE, severe_feature_drift_count BIGINT, eligible_runtime_predictions BIGINT,
    labeled_observations BIGINT, roc_auc DOUBLE, brier DOUBLE, net_savings_per_1000_orders DOUBLE, base_roc_auc DOUBLE, base_brier DOUBLE"""
    df = spark.createDataFrame([
        ("few", 0.9, 5, 500, 99, .5, .5, -1.0, .9, .1),
        ("roc", None, 0, 500, 100, .84, .1, 5.0, .9, .1),
        ("money", 0.0, 0, 50, 100, .9, .1, 0.0, .9, .1),
        ("unknown", 0.0, 0, 500, 100, None, None, None, .9, .1),
        ("drift", 0.3, 0, 500, 0, None, None, None, .9, .1),
    ], schema)
    sustained = spark.createDataFrame([("drift", True), ("roc", True), ("few", False)], "model_version STRING, sustained_drift BOOLEAN")
    out = {r["model_version"]: r for r in retraining.evaluated_policy(df, sustained).collect()}
    assert {k: v["trigger_type"] for k, v in out.items()} == {
        "few": None, "roc": "CONFIRMED_PERFORMANCE_DEGRADATION", "money": "CONFIRMED_PERFORMANCE_DEGRADATION",
        "unknown": None, "drift": "SUSTAINED_DATA_DRIFT"}
    assert out["roc"]["confirmed_degradation"] == ["roc_auc_declined"]
    assert out["few"]["severe_drift"] and not out["money"]["severe_drift"]


def test_open_requests_are_reused(workspace):
    first = retrain.create_request(workspace, "m", "v1", "NEW_DATA_VERSION", T0)
    again = retrain.create_request(workspace, "m", "v1", "NEW_DATA_VERSION", T0 + timedelta(hours=1))
    other = retrain.create_request(workspace, "m", "v1", "MANUAL_RETRAIN", T0 + timedelta(hours=2))
    forced = retrain.create_request(workspace, "m", "v1", "NEW_DATA_VERSION", T0 + timedelta(hours=3), force_new=True)
    assert first["request_id"] == again["request_id"]
    assert len({first["request_id"], other["request_id"], forced["request_id"]}) == 3


def test_unknown_families_and_parameters_are_refused():
    with pytest.raises(ValueError):
        training.model_parameters("extra")
    with pytest.raises(ValueError):
        training.model_parameters("random_forest", {"depth": 3})
    assert training.model_parameters("random_forest", {"max_depth": 3})["max_depth"] == 3
    assert len(training.random_parameters({"a": [1, 2], "b": [3, 4]}, 10)) == 4


def snapshot(spark, n=900):
    items = with_order(generated_items(spark, n, customers=60))
    orders = aggregate_to_orders(check_items(items).valid)
    # A clear rule, so that a model can pass the gates.
    label = (F.col("is_cod") == 1) | (F.col("price") > 2500)
    return customer_history(orders.withColumn(TARGET, label.cast("int"))).withColumn("status", F.when(F.col(TARGET) == 1, "canceled").otherwise("complete"))


SMALL = {"logistic_regression": {"max_iter": 30}, "random_forest": {"n_estimators": 12, "max_depth": 6, "min_samples_leaf": 3}}


def test_retraining_from_request_to_promotion(spark, workspace):
    from orderlight.operators.validation import REPORT_SCHEMA

    data = snapshot(spark)
    workspace.write_version("v001", data, spark.createDataFrame([], "quarantine_reason STRING"), spark.createDataFrame([], REPORT_SCHEMA), "b", T0)
    request = retrain.create_request(workspace, "old", "v001", "NEW_DATA_VERSION", T0)
    done, result = retrain.run_retraining(
        workspace, request, T0 + timedelta(days=1), T0 + timedelta(days=2), overrides=SMALL, families=list(SMALL))
    assert done["status"] == "CANDIDATE_READY" and done["model_count"] == 2
    assert dict(rows(retrain.current_requests(workspace), "request_id", "status")) == {request["request_id"]: "CANDIDATE_READY"}
    state = dict(rows(selection.current_status(workspace.ledger("model_events")), "model_id", "status"))
    assert state[done["candidate_model_id"]] == "CANDIDATE" and "PRODUCTION" not in state.values()
    after = dict(rows(registry.promote(workspace, done["candidate_model_id"], T0 + timedelta(days=3)), "model_id", "status"))
    assert after[done["candidate_model_id"]] == "PRODUCTION" and "CANDIDATE" not in after.values()
    with pytest.raises(LookupError):
        registry.promote(workspace, "nobody", T0)
    support = registry.production_support(workspace).first()
    assert support["model_id"] == done["candidate_model_id"] and not support["rebuilt"] and support["holdout_rows"] == 135

    # Every stored model record agrees with a direct look at its predictions.
    record = {r["model_id"]: r for r in result.records.collect()}[done["candidate_model_id"]]
    test = result.scored.filter((F.col("model_id") == record["model_id"]) & (F.col("split") == "test"))
    brier = test.agg(F.avg(F.pow(F.col("probability") - F.col(TARGET), 2.0))).first()[0]
    assert record["test_brier"] == pytest.approx(brier, abs=1e-12)

    paths = training.write_support_tables(result, record["model_id"], workspace.path("support"))
    queue = spark.read.option("header", True).csv(paths["queue_orders"])
    assert queue.count() == test.count()

    model = result.models[record["model_id"]]
    some = result.prepared.table.filter(F.col("split") == "test")
    found = explain.model_risk_drivers(some, lambda df: training.predicted(model, df, result.prepared.fill), result.prepared.fill)
    row = found.orderBy(F.col("probability").desc()).first()
    impacts = [d["impact"] for d in row["drivers"]]
    assert impacts == sorted(impacts, reverse=True) and all(i > 0 for i in impacts) and len(impacts) <= 3

    names = [n for n, _ in training.feature_importance(model)]
    width = len(model.transform(training.imputed(some.withColumn("weight", F.lit(1.0)), result.prepared.fill)).first()["features"])
    assert len(names) == width and {"price", "hour"} <= set(names)


def test_no_model_qualifies_without_signal(spark):
    data = snapshot(spark, 600).withColumn(TARGET, (F.pmod(F.xxhash64("order_id"), F.lit(2))).cast("int"))
    out = training.train_suite(data, "v1", ["logistic_regression"], SMALL)
    assert out.candidate_id is None
    assert rows(out.records, "qualified", "selected_candidate") == [(False, False)]


def test_one_class_splits_are_refused(spark):
    with pytest.raises(ValueError):
        training.prepared_snapshot(snapshot(spark, 100).withColumn(TARGET, F.lit(1)))


def test_fingerprint_sees_content_not_order(spark):
    data = snapshot(spark, 200).cache()
    base = training.dataset_fingerprint(data)
    assert training.dataset_fingerprint(data.repartition(5, "price")) == base
    assert training.dataset_fingerprint(data.withColumn("price", F.col("price") + F.when(F.col("order_id").endswith("7"), 1).otherwise(0))) != base
    assert training.dataset_fingerprint(data.unionByName(data.limit(1))) != base


def test_expression_drivers(spark):
    df = spark.createDataFrame([("o", *[1.0] * 10, "A", "cod")], ", ".join(["order_id STRING"] + [f"{c} DOUBLE" if c not in ("category_name_1", "payment_method") else f"{c} STRING" for c in FEATURES]))
    base = {**{c: 0.0 for c in FEATURES}, "category_name_1": "A", "payment_method": "x"}
    out = explain.risk_drivers(df, lambda f: 0.5 * f["price"] + 0.1 * f["hour"] - 0.2 * f["is_cod"] + 0.3 * f["qty_ordered"] + 0.05 * f["discount_amount"], base).first()
    assert [d["feature"] for d in out["drivers"]] == ["price", "qty_ordered", "hour"]
    assert [round(d["impact"], 9) for d in out["drivers"]] == [0.5, 0.3, 0.1]


def test_benchmark_rows_from_nested_json(spark, tmp_path):
    summary = {
        "candidate_model_id": "b",
        "models": [
            {"model_id": "a", "display_name": "A", "val_metrics": {"roc_auc": 0.8}, "test_metrics": {"f1": 0.5}, "business_metrics": {"net_savings_per_1000_orders": 3.0}, "trained_at": "t"},
            {"model_id": "b", "display_name": "B", "qualification": {"passed": True}, "test_business_metrics": {"net_savings_per_1000_orders": 7}, "status": "CANDIDATE"},
        ],
    }
    (tmp_path / "s.json").write_text(json.dumps(summary, indent=1))
    df = model_files.read_summary(spark, str(tmp_path / "s.json"))
    assert sorted(rows(model_files.benchmark_rows(df), "model_id", "qualified_on_validation", "selected_candidate", "test_net_savings_per_1000_orders", "validation_roc_auc")) == [
        ("a", False, False, 3.0, 0.8), ("b", True, True, 7.0, None)]
    assert sorted(rows(model_files.registry_runs(df), "run_name", "role", "status")) == [
        ("a", "suite / packaged", "READY"), ("b", "suite / packaged", "CANDIDATE")]
    assert "models" in SUITE_SUMMARY


def test_packages_from_elsewhere_become_candidate_and_production(spark, workspace, tmp_path):
    from orderlight.operators.validation import REPORT_SCHEMA

    data = snapshot(spark, 400)
    result = training.train_suite(data, "v9", ["logistic_regression"], SMALL, stamp="far")
    model_id, path = "logistic_regression__far", str(tmp_path / "package")
    registry.package_model(result, model_id, path)
    status = lambda: dict(rows(selection.current_status(workspace.ledger("model_events")), "model_id", "status"))
    assert registry.production_support(workspace).isEmpty()
    record = registry.import_candidate(workspace, path, T0)
    assert record["dataset_version"] == "v9" and status() == {model_id: "CANDIDATE"}
    registry.promote(workspace, model_id, T0 + timedelta(days=1))
    assert status() == {model_id: "PRODUCTION"}

    held = {r.order_id: r.probability for r in result.scored.filter("split = 'test'").collect()}
    first = registry.production_support(workspace).first()
    assert first["path"].startswith(path) and not first["rebuilt"]
    assert first["holdout_rows"] == len(held) and first["mean_probability"] == pytest.approx(sum(held.values()) / len(held))
    rates = {s["split"]: s["cancellation_rate"] for s in result.prepared.stats}
    assert [first[f"{s}_rate"] for s in ("train", "validation", "test")] == [rates[s] for s in ("train", "validation", "test")]

    # A package without support tables: made anew from the active version, scored by the model.
    bare = str(tmp_path / "bare")
    training.save_model(spark, result.models[model_id], result.prepared.fill, bare)
    spark.read.parquet(f"{path}/record").write.parquet(f"{bare}/record")
    registry.register(workspace, bare, T0 + timedelta(days=2), "import")
    with pytest.raises(ValueError):
        registry.promote(workspace, model_id, T0 + timedelta(days=3))
    assert registry.production_support(workspace).first()["path"] == first["path"]
    workspace.write_version("v001", data, spark.createDataFrame([], "quarantine_reason STRING"), spark.createDataFrame([], REPORT_SCHEMA), "b", T0)
    registry.promote(workspace, model_id, T0 + timedelta(days=4))
    second = registry.production_support(workspace).first()
    assert second["rebuilt"] and second["holdout_rows"] == len(held)
    again = spark.read.schema(registry.PREDICTIONS).option("header", True).csv(f"{second['path']}/test_predictions")
    assert {r.order_id: r.probability for r in again.collect()} == pytest.approx(held)


def test_unfinished_and_foreign_packages_are_refused(spark, workspace, tmp_path):
    with pytest.raises(ValueError, match="lacks its fill"):
        registry.import_candidate(workspace, str(tmp_path / "nothing"), T0)
    prepared = training.prepared_snapshot(snapshot(spark, 300))
    model = training.fit_family(prepared, "logistic_regression", {"max_iter": 5})
    path = str(tmp_path / "half")
    training.save_model(spark, model, prepared.fill, path)
    with pytest.raises(ValueError, match="lacks its record"):
        registry.import_candidate(workspace, path, T0)
    about = "model_id STRING, feature_schema_version STRING, dataset_version STRING, threshold DOUBLE, split_rates STRING"
    spark.createDataFrame([("m", "of another release", "v1", 0.5, "{}")], about).write.parquet(f"{path}/record")
    with pytest.raises(ValueError, match="feature schema"):
        registry.import_candidate(workspace, path, T0)
    assert workspace.ledger("model_events").isEmpty() and workspace.ledger("model_records").isEmpty()
