"""Order lifecycle, review queue and decision records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlight.contract import LIFECYCLE_MODES
from orderlight.functions.labels import (
    RECOMMENDATION_LABELS, SOURCE_LABELS, customer_message, lifecycle_status, renamed, scoring_mode,
)
from orderlight.operators.latest import latest_per_key, newest
from orderlight.operators.monitoring import latest_decisions


def order_lifecycle(predictions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Current state of every interactively scored order.

    Scoring an order again restarts its workflow, so the newest prediction per order owns the
    state and only decisions on that prediction count.
    """
    interactive = predictions.filter(scoring_mode(F.col("scoring_mode")).isin(LIFECYCLE_MODES))
    current = latest_per_key(
        interactive.select(F.col("order_id").cast("string"), "prediction_id", "predicted_at"),
        ["order_id"], "predicted_at", "prediction_id",
    )
    decided = latest_decisions(decisions.select("decision_id", "prediction_id", "decided_at", "manager_decision"))
    status = lifecycle_status(F.col("manager_decision"))
    return (
        current.join(decided.drop("decision_id"), "prediction_id", "left")
        .select(
            F.concat(F.lit("ops_"), F.coalesce(F.col("order_id"), F.lit("None"))).alias("workflow_id"),
            "prediction_id", "order_id", F.col("predicted_at").alias("created_at"),
            status.alias("status"), "manager_decision", "decided_at",
            customer_message(status).alias("customer_message"),
        )
    )


def review_queue(lifecycle: DataFrame, predictions: DataFrame, n: int = 100) -> DataFrame:
    """Newest ``n`` orders with their score. The top rows are taken first, so the join
    touches n keys."""
    top = newest(lifecycle, n, "created_at", "workflow_id")
    scores = predictions.select("prediction_id", "probability", "recommendation", "scoring_mode")
    # ``top`` has at most n rows: scan the predictions once against it.
    hits = scores.join(F.broadcast(top.select("prediction_id")), "prediction_id", "left_semi")
    return top.join(F.broadcast(hits), "prediction_id", "left").select(
        "created_at", "order_id", "status", "customer_message", "probability",
        renamed(F.col("recommendation"), RECOMMENDATION_LABELS).alias("recommendation"),
        renamed(scoring_mode(F.col("scoring_mode")), SOURCE_LABELS).alias("source"),
    )


def queue_counts(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.agg(
        F.count_if(F.col("status") == "AWAITING_OPERATIONS_REVIEW").alias("awaiting_review"),
        F.count_if(F.col("status") == "RELEASED_TO_FULFILLMENT").alias("released"),
        F.count_if(F.col("status") == "VERIFICATION_REQUIRED").alias("verification_required"),
    )


# Prediction fields copied into a decision record.
COPIED_FIELDS = [
    "recommendation", "probability", "threshold", "actual_outcome", "model_name", "model_version",
    "net_expected_savings", "avoidable_fulfillment_cost", "intervention_effectiveness",
    "intervention_cost", "false_positive_friction_cost",
]


def decision_log(decisions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Decisions with the score and policy they were based on. Prediction ids are unique, so
    each decision meets one row."""
    made = decisions.select("decision_id", "prediction_id", "decided_at", "manager_decision")
    return made.join(
        predictions.select("prediction_id", F.col("order_id").cast("string"), *COPIED_FIELDS), "prediction_id"
    ).select("decision_id", "prediction_id", "order_id", "decided_at", "manager_decision", *COPIED_FIELDS)


def decision_history(log: DataFrame, n: int = 500) -> DataFrame:
    return newest(log, n, "decided_at", "decision_id").select(
        "decision_id", "decided_at", "order_id", "probability", "threshold", "recommendation",
        "manager_decision", "actual_outcome", "net_expected_savings", "model_name", "model_version",
    )
