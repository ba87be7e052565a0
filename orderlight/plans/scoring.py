"""Batch scoring: features -> probability -> economics -> prediction log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlight.functions.economics import economics, policy_columns
from orderlight.functions.features import feature_payload
from orderlight.functions.labels import risk_level
from orderlight.sources.workspace import Workspace


def softsign_score(f: dict[str, Column]) -> Column:
    """Closed-form score of three features, for checks and trials without a trained model."""
    z = F.lit(-6.0) + F.lit(2.5) * f["is_cod"] + F.lit(0.00001) * f["grand_total"] + F.lit(3.0) * f["customer_cancel_rate"]
    return F.lit(0.5) * (F.lit(1.0) + z / (F.lit(1.0) + F.abs(z)))


def by_expression(score: Callable[[dict[str, Column]], Column]) -> Callable[[DataFrame], DataFrame]:
    from orderlight.contract import FEATURES

    return lambda df: df.withColumn("probability", score({c: F.col(c) for c in FEATURES}))


def by_model(model) -> Callable[[DataFrame], DataFrame]:
    """Scorer from a fitted pipeline that yields a ``probability`` vector and fills missing inputs
    itself; for the models of this package use ``training.scorer``, which fills them."""
    from pyspark.ml.functions import vector_to_array

    def run(df: DataFrame) -> DataFrame:
        out = model.transform(df.drop("probability"))
        return out.select(*[c for c in df.columns if c != "probability"],
                          vector_to_array(F.col("probability"))[1].alias("probability"))

    return run


def scored_orders(
    features: DataFrame, scorer: Callable[[DataFrame], DataFrame], threshold: float, policy: dict | None = None
) -> DataFrame:
    """Orders with risk level and economics. Row-local: no shuffle."""
    scored = scorer(features).withColumnRenamed("probability", "cancellation_probability")
    p = F.col("cancellation_probability")
    return scored.withColumns({"risk_level": risk_level(p, F.lit(threshold)), **economics(p, policy)})


def prediction_rows(
    scored: DataFrame, threshold: float, at: str, model_name: str, model_version: str,
    dataset_version: str = "unknown", policy: dict | None = None, mode: str = "batch",
    latency_ms: float | None = None,
) -> DataFrame:
    """Scored orders in the layout of the prediction log. The id is derived from the order,
    model and time, so writing the same batch twice adds no new predictions."""
    key = F.concat_ws("|", F.col("order_id").cast("string"), F.lit(model_version), F.lit(at), F.lit(mode))
    return scored.select(
        F.concat(F.lit("pred_"), F.sha2(key, 256)).alias("prediction_id"),
        F.col("order_id").cast("string").alias("order_id"),
        F.lit(at).cast("timestamp").alias("predicted_at"),
        F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version"),
        F.lit(dataset_version).alias("dataset_version"),
        F.col("cancellation_probability").alias("probability"), F.lit(float(threshold)).alias("threshold"),
        "recommendation", F.lit(None).cast("string").alias("actual_outcome"),
        "expected_avoidable_cost", "expected_false_positive_cost", "net_expected_savings",
        *[c.alias(k) for k, c in policy_columns(policy).items()],
        F.lit(latency_ms).cast("double").alias("latency_ms"), F.lit(mode).alias("scoring_mode"),
        feature_payload().alias("feature_json"),
    )


def score_and_log(
    ws: Workspace, features: DataFrame, scorer, threshold: float, at, model_name: str, model_version: str,
    dataset_version: str = "unknown", policy: dict | None = None,
) -> DataFrame:
    """Score a batch, append the predictions and one BATCH_SCORING event."""
    scored = scored_orders(features, scorer, threshold, policy)
    ws.append("predictions", prediction_rows(
        scored, threshold, str(at), model_name, model_version, dataset_version, policy))
    ws.log_event(f"score_{model_version}_{at}", at, "BATCH_SCORING", "SUCCESS", "Scored orders")
    return scored
