"""Population, business impact, runtime summary, lifecycle, feedback."""

from datetime import datetime, timedelta

import pytest

from orderlight.contract import APPROVE, HOLD
from orderlight.operators import decisions, monitoring
from tests.conftest import rows

T0 = datetime(2024, 5, 1)
PRED = """prediction_id STRING, order_id STRING, predicted_at TIMESTAMP, probability DOUBLE, threshold DOUBLE, recommendation STRING,
expected_avoidable_cost DOUBLE, expected_false_positive_cost DOUBLE, net_expected_savings DOUBLE, intervention_cost DOUBLE,
scoring_mode STRING, latency_ms DOUBLE, actual_outcome STRING"""


def pred(i, order, mode, rec=HOLD, p=0.7, saved=70.0, friction=3.0, cost=10.0, hours=0, outcome=None, threshold=0.5):
    return (i, order, T0 + timedelta(hours=hours), p, threshold, rec, saved, friction, saved - friction - cost, cost, mode, 5.0, outcome)


def preds(spark, *data):
    return spark.createDataFrame(list(data), PRED)


def decided(spark, *data):
    return spark.createDataFrame(
        [(f"d{i}", p, T0 + timedelta(hours=h), d) for i, (p, d, h) in enumerate(data)],
        "decision_id STRING, prediction_id STRING, decided_at TIMESTAMP, manager_decision STRING")


def test_population(spark):
    modes = ["manual", "batch", "simulation_live", "simulation_historical", "simulation", None]
    out = monitoring.with_population(preds(spark, *[pred(str(i), str(i), m) for i, m in enumerate(modes)]))
    assert out.filter("eligible").count() == 2
    assert dict(rows(monitoring.mode_counts(preds(spark, pred("1", "1", "  "), pred("2", "2", None))), "monitoring_mode", "predictions")) == {"legacy_or_unknown": 2}


def impact_input(spark):
    p = preds(
        spark,
        pred("p1", "A", "batch", rec=APPROVE, hours=0), pred("p2", "A", "batch", rec=APPROVE, hours=1),
        pred("p3", "B", "simulation_live", hours=2), pred("p4", "C", "simulation_live", hours=3),
        pred("p5", "D", "manual", hours=4), pred("p6", "E", "simulation_historical", hours=5),
    )
    return p, decided(spark, ("p3", APPROVE, 6), ("p3", HOLD, 7))


def test_business_impact(spark):
    out = monitoring.business_impact(*impact_input(spark)).first().asDict()
    assert (out["scoring_records"], out["orders_scored"]) == (5, 4)
    assert (out["orders_pending_review"], out["orders_released"], out["orders_verified"]) == (2, 1, 1)
    assert (out["expected_cancellations_reached"], out["expected_cost_prevented"]) == (0.7, 70.0)
    assert (out["verification_cost"], out["expected_unnecessary_check_cost"], out["expected_net_savings"]) == (10.0, 3.0, 57.0)
    assert out["net_savings_per_1000_orders"] == pytest.approx(14250.0)


def test_pending_orders_claim_nothing(spark):
    out = monitoring.business_impact(preds(spark, pred("p", "A", "simulation_live")), decided(spark, ("x", HOLD, 1))).first()
    assert (out["orders_pending_review"], out["expected_net_savings"]) == (1, 0.0)


def test_demo_can_be_left_out(spark):
    p = preds(spark, pred("p1", "A", "manual", saved=51.0), pred("p2", "B", "simulation_live"))
    out = monitoring.business_impact(p, decided(spark, ("p1", HOLD, 1), ("p2", HOLD, 1)), include_demo=False).first()
    assert (out["orders_scored"], out["expected_net_savings"]) == (1, 38.0)


def test_predictions_without_order_stand_alone(spark):
    p = preds(spark, pred("p1", None, "batch"), pred("p2", None, "batch"))
    assert monitoring.business_actions(p, decided(spark, ("x", HOLD, 1))).count() == 2


def test_runtime_summary(spark):
    p = preds(spark, pred("1", "1", "batch", p=0.9), pred("2", "2", "api", p=0.1, rec=APPROVE), pred("3", "3", "simulation"))
    out = monitoring.runtime_summary(p).first().asDict()
    assert (out["total_predictions"], out["eligible_predictions"], out["excluded_predictions"]) == (3, 2, 1)
    assert (out["average_risk"], out["high_risk_rate"], out["intervention_rate"], out["monitoring_ready"]) == (0.5, 0.5, 0.5, False)
    assert out["latency_p95_ms"] == 5.0
    assert monitoring.runtime_summary(p.filter("scoring_mode = 'simulation'")).first()["latency_p95_ms"] is None


def test_lifecycle_follows_the_newest_prediction(spark):
    p = preds(spark, pred("p1", "A", "manual"), pred("p2", "A", "manual", hours=3), pred("p3", "B", "api"), pred("p4", "C", "batch"))
    life = decisions.order_lifecycle(p, decided(spark, ("p1", APPROVE, 1), ("p3", APPROVE, 2)))
    assert sorted(rows(life, "workflow_id", "status")) == [("ops_A", "AWAITING_OPERATIONS_REVIEW"), ("ops_B", "RELEASED_TO_FULFILLMENT")]
    assert decisions.queue_counts(life).first().asDict() == {"awaiting_review": 1, "released": 1, "verification_required": 0}
    queue = decisions.review_queue(life, p, 1)
    assert rows(queue, "order_id", "source") == [("A", "Manual order")]


def test_outcomes_reach_all_predictions_of_an_order(spark):
    p = preds(spark, pred("1", "A", "batch", outcome="Completed"), pred("2", "A", "batch"), pred("3", "B", "batch", outcome="Canceled"))
    feedback = spark.createDataFrame(
        [("A", "canceled", 1), ("A", " COMPLETE ", 2), ("A", "lost", 3), ("Z", "canceled", 4)], "order_id STRING, final_outcome STRING, n INT")
    out = monitoring.apply_outcomes(p, feedback, "n")
    assert sorted(rows(out, "prediction_id", "actual_outcome")) == [("1", "Completed"), ("2", "Completed"), ("3", "Canceled")]


def test_labeled_performance_needs_two_classes(spark):
    one = preds(spark, pred("1", "A", "batch", outcome="canceled"), pred("2", "B", "batch", outcome="Cancelled"), pred("3", "C", "simulation", outcome="complete"))
    assert monitoring.labeled_performance(one).first().asDict() == {"labeled_observations": 2}
    two = preds(spark, pred("1", "A", "batch", outcome="canceled", p=0.9), pred("2", "B", "api", outcome="completed", p=0.2))
    out = monitoring.labeled_performance(two).first().asDict()
    assert (out["labeled_observations"], out["roc_auc"], out["f1"]) == (2, 1.0, 1.0)


def test_reliability_leaves_out_pipelines_that_never_ran(spark):
    batches = spark.createDataFrame([("SUCCESS",), ("SEED",), ("FAILED",)], "status STRING")
    events = spark.createDataFrame([("MODEL_CANDIDATE", "SUCCESS"), ("DATA_INGESTION", "FAILED")], "event_type STRING, status STRING")
    out = {r["pipeline"]: (r["runs"], r["successful"]) for r in monitoring.pipeline_reliability(batches, events).collect()}
    assert out == {"DataOps batches": (3, 2), "Model training": (1, 1)}
