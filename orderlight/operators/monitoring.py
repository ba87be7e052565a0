"""Scored-traffic population, runtime summary, business impact and reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlight.contract import (
    APPROVE, AWAITING, BUSINESS_MODES, HOLD, MIN_MONITORING_ROWS, PENDING_MODES,
)
from orderlight.functions.labels import is_production, mode_label, outcome_flag, outcome_text, scoring_mode
from orderlight.operators.backtest import policy_backtest
from orderlight.operators.curves import classification_metrics, curve_points
from orderlight.operators.latest import latest_per_key
from orderlight.operators.quantiles import exact_quantiles
from orderlight.session import small_side, stored


def with_population(predictions: DataFrame) -> DataFrame:
    """Adds the normalized mode and whether the row counts for production monitoring."""
    raw = F.col("scoring_mode") if "scoring_mode" in predictions.columns else F.lit(None).cast("string")
    return (
        predictions.withColumn("monitoring_mode", scoring_mode(raw))
        .withColumn("eligible", is_production(F.col("monitoring_mode")))
    )


def production_traffic(predictions: DataFrame) -> DataFrame:
    return with_population(predictions).filter("eligible").drop("eligible")


def mode_counts(predictions: DataFrame) -> DataFrame:
    return with_population(predictions).groupBy("monitoring_mode").agg(F.count("*").alias("predictions"))


def raw_mode_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("scoring_mode").agg(F.count("*").alias("predictions"))


def traffic_population(predictions: DataFrame) -> DataFrame:
    """Prediction count per mode with its display name, largest first."""
    return (
        mode_counts(predictions)
        .select(
            mode_label(F.col("monitoring_mode")).alias("traffic_type"),
            F.col("monitoring_mode").alias("scoring_mode"),
            "predictions",
            F.when(is_production(F.col("monitoring_mode")), "Yes").otherwise("No").alias("used_for_production_monitoring"),
        )
        .orderBy(F.col("predictions").desc(), "scoring_mode")
    )


def runtime_summary(predictions: DataFrame, production_only: bool = True) -> DataFrame:
    """One row of traffic, risk, value and latency figures."""
    rows = with_population(predictions)
    used = F.col("eligible") if production_only else F.lit(True)
    chosen = rows.filter("eligible") if production_only else rows
    p95 = exact_quantiles(chosen, ["latency_ms"], [0.95])["latency_ms"]
    latency = F.when(used & ~F.isnan(F.col("latency_ms")), F.col("latency_ms"))
    held = used & (F.col("recommendation") == HOLD)
    n = F.count_if(used)
    return rows.agg(
        F.count("*").alias("total_predictions"),
        F.count_if("eligible").alias("eligible_predictions"),
        F.count_if(~F.col("eligible")).alias("excluded_predictions"),
        (F.count_if("eligible") >= MIN_MONITORING_ROWS).alias("monitoring_ready"),
        n.alias("predictions"),
        F.avg(F.when(used, F.col("probability"))).alias("average_risk"),
        F.try_divide(F.count_if(used & (F.col("probability") >= F.col("threshold"))), n).alias("high_risk_rate"),
        F.try_divide(F.count_if(held), n).alias("intervention_rate"),
        F.coalesce(F.sum(F.when(held, F.col("net_expected_savings"))), F.lit(0.0)).alias("expected_net_savings_total"),
        F.avg(latency).alias("latency_mean_ms"),
        F.lit(p95[0] if p95 else None).cast("double").alias("latency_p95_ms"),
        F.max(latency).alias("latency_max_ms"),
    )


def risk_trend(predictions: DataFrame, every: str = "1 day") -> DataFrame:
    """Average risk of production traffic per time window."""
    return (
        production_traffic(predictions)
        .groupBy(F.window("predicted_at", every).alias("w"))
        .agg(F.count("*").alias("predictions"), F.avg("probability").alias("average_risk"))
        .select(F.col("w.start").alias("window_start"), "predictions", "average_risk")
    )


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Newest decision per prediction."""
    return latest_per_key(decisions, ["prediction_id"], "decided_at", "decision_id")


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """Newest prediction per order; a prediction without an order stands for itself."""
    keyed = predictions.withColumn(
        "_order", F.coalesce(F.col("order_id").cast("string"), F.col("prediction_id").cast("string")))
    return latest_per_key(keyed, ["_order"], "predicted_at", "prediction_id").drop("_order")


IMPACT_COLUMNS = [
    "prediction_id", "order_id", "predicted_at", "monitoring_mode", "probability", "recommendation",
    "expected_avoidable_cost", "expected_false_positive_cost", "net_expected_savings", "intervention_cost",
]


def business_action(decision: Column, mode: Column, recommendation: Column) -> Column:
    """Manager decision, else pending for interactive modes, else the recommendation."""
    undecided = decision.isNull() | decision.isin("", "<NA>")
    return (
        F.when(~undecided, decision)
        .when(mode.isin(PENDING_MODES), AWAITING)
        .otherwise(recommendation)
    )


def business_actions(predictions: DataFrame, decisions: DataFrame, include_demo: bool = True) -> DataFrame:
    """Latest operations prediction per order with its resolved action.

    Both sides are reduced to one row per key before they meet, so the join has no repeated
    keys on either side.
    """
    modes = [m for m in BUSINESS_MODES if include_demo or m != "simulation_live"]
    scored = with_population(predictions).filter(F.col("monitoring_mode").isin(modes)).select(IMPACT_COLUMNS)
    decided = latest_decisions(decisions.select("decision_id", "prediction_id", "decided_at", "manager_decision"))
    return (
        latest_predictions(scored)
        .join(decided.select("prediction_id", "manager_decision"), "prediction_id", "left")
        .withColumn("business_action", business_action(
            F.col("manager_decision"), F.col("monitoring_mode"), F.col("recommendation")))
    )


def business_impact(predictions: DataFrame, decisions: DataFrame, include_demo: bool = True) -> DataFrame:
    """One row: scored, pending, released and verified orders and the value of verifying."""
    modes = [m for m in BUSINESS_MODES if include_demo or m != "simulation_live"]
    records = with_population(predictions).agg(
        F.count_if(F.col("monitoring_mode").isin(modes)).alias("scoring_records")).first()[0]
    verified = F.col("business_action") == HOLD

    def total(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.coalesce(F.sum(F.when(verified & ~F.isnan(v), v)), F.lit(0.0))

    orders, checked, net = F.count("*"), F.count_if(verified), total("net_expected_savings")
    return business_actions(predictions, decisions, include_demo).agg(
        F.lit(records).cast("bigint").alias("scoring_records"),
        orders.alias("orders_scored"),
        F.count_if(F.col("business_action") == AWAITING).alias("orders_pending_review"),
        F.count_if(F.col("business_action") == APPROVE).alias("orders_released"),
        checked.alias("orders_verified"),
        F.coalesce(F.try_divide(checked, orders), F.lit(0.0)).alias("verification_rate"),
        total("probability").alias("expected_cancellations_reached"),
        total("expected_avoidable_cost").alias("expected_cost_prevented"),
        total("intervention_cost").alias("verification_cost"),
        total("expected_false_positive_cost").alias("expected_unnecessary_check_cost"),
        net.alias("expected_net_savings"),
        F.coalesce(F.try_divide(net, orders) * 1000.0, F.lit(0.0)).alias("net_savings_per_1000_orders"),
        F.coalesce(F.try_divide(net, checked), F.lit(0.0)).alias("average_net_savings_per_verified_order"),
        F.min("predicted_at").alias("first_scored_at"),
        F.max("predicted_at").alias("last_scored_at"),
    )


# Reported pipelines by event type.
EVENT_PIPELINES = {
    "MODEL_CANDIDATE": "Model training",
    "MODEL_PROMOTION": "Model promotion",
    "BATCH_SCORING": "Batch inference",
}


def pipeline_reliability(batches: DataFrame, events: DataFrame) -> DataFrame:
    """(pipeline, runs, successful, success_rate); pipelines that never ran are left out."""
    names = F.create_map(*[F.lit(x) for kv in EVENT_PIPELINES.items() for x in kv])
    runs = batches.select(
        F.lit("DataOps batches").alias("pipeline"), F.col("status").isin("SUCCESS", "SEED").alias("ok"),
    ).unionByName(
        events.filter(F.col("event_type").isin(list(EVENT_PIPELINES)))
        .select(F.try_element_at(names, F.col("event_type")).alias("pipeline"), (F.col("status") == "SUCCESS").alias("ok"))
    )
    return runs.groupBy("pipeline").agg(
        F.count("*").alias("runs"),
        F.count_if("ok").alias("successful"),
        (F.count_if("ok") / F.count("*")).alias("success_rate"),
    )


def apply_outcomes(predictions: DataFrame, feedback: DataFrame, time: str) -> DataFrame:
    """Set ``actual_outcome`` on every prediction of an order from its last usable feedback.

    The feedback is one row per order after the reduction. A hot order only repeats on the
    prediction side, which the adaptive join splits; a small feedback table is broadcast.
    """
    usable = (
        feedback.select(F.col("order_id").cast("string"), outcome_text(F.col("final_outcome")).alias("_outcome"), F.col(time).alias("_t"))
        .filter("order_id IS NOT NULL AND _outcome IS NOT NULL")
    )
    # Of equal times the larger outcome text counts, so reruns agree.
    moment = F.when(F.col("_t").isNotNull(), F.struct("_t", "_outcome"))
    last = usable.groupBy("order_id").agg(F.max_by("_outcome", moment).alias("_outcome"))
    return (
        predictions.join(small_side(stored(last, "outcomes")), "order_id", "left")
        .withColumn("actual_outcome", F.coalesce(F.col("_outcome"), F.col("actual_outcome")))
        .drop("_outcome").select(*predictions.columns)
    )


def labeled_performance(predictions: DataFrame) -> DataFrame:
    """Metrics of production predictions with known outcomes, at their median threshold. With
    fewer than two rows or a single class only the count is given."""
    # Three narrow columns, read for each figure below.
    rows = stored(
        production_traffic(predictions)
        .withColumn("y", outcome_flag(F.col("actual_outcome")))
        .filter("y IS NOT NULL")
        .select("y", "threshold", F.coalesce(F.col("probability").cast("double"), F.lit(0.0)).alias("p")),
        "labeled",
    )
    size = rows.agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high")).first()
    counted = rows.sparkSession.createDataFrame([(size["n"],)], "labeled_observations BIGINT")
    if size["n"] < 2 or size["low"] == size["high"]:
        return counted
    median = exact_quantiles(rows, ["threshold"], [0.5])["threshold"]
    threshold = median[0] if median else 0.5
    metrics = classification_metrics(curve_points(rows, "y", "p"), F.lit(threshold))
    value = policy_backtest(rows, "y", "p").select("net_savings_per_1000_orders").first()[0]
    return metrics.withColumns({
        "net_savings_per_1000_orders": F.lit(value).cast("double"),
        "labeled_observations": F.lit(size["n"]).cast("bigint"),
    })
