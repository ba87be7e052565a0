"""Model qualification, candidate choice, comparison and lifecycle. Model tables hold one row
per trained model, so windows over them are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlight.contract import DEFAULT_GATES
from orderlight.functions.labels import model_health
from orderlight.session import small_side

GATE_COLUMNS = ["roc_gate", "pr_gate", "calibration_gate", "recall_gate", "business_gate"]


def qualify_models(models: DataFrame, gates: dict | None = None) -> DataFrame:
    """Gate results on validation evidence only. A missing metric fails its gate."""
    g = {**DEFAULT_GATES, **(gates or {})}

    def at_least(c: str, key: str) -> Column:
        return F.coalesce(F.col(c) >= F.lit(float(g[key])), F.lit(False))

    checked = models.withColumns({
        "roc_gate": at_least("val_roc_auc", "min_roc_auc"),
        "pr_gate": at_least("val_pr_auc", "min_pr_auc"),
        "calibration_gate": F.coalesce(F.col("val_brier") <= F.lit(float(g["max_brier"])), F.lit(False)),
        "recall_gate": at_least("val_recall_at_90_precision", "min_recall_at_90_precision"),
        "business_gate": at_least("val_net_savings_per_1000_orders", "min_net_savings_per_1000_orders"),
    })
    passed = F.lit(True)
    for c in GATE_COLUMNS:
        passed = passed & F.col(c)
    return checked.withColumn("qualified", passed)


def score_models(models: DataFrame, gates: dict | None = None) -> DataFrame:
    """Adds the weighted selection score of qualified models and marks the one chosen. Savings
    are scaled to [0, 1] among the qualified; equal savings count as 1."""
    q = qualify_models(models, gates)
    money = F.coalesce(F.col("val_net_savings_per_1000_orders"), F.lit(0.0))
    ok = Window.partitionBy("qualified")
    low, high = F.min(money).over(ok), F.max(money).over(ok)
    scaled = F.when(high == low, F.lit(1.0)).otherwise(F.try_divide(money - low, high - low))
    score = (
        0.25 * F.col("val_roc_auc") + 0.25 * F.col("val_pr_auc") + 0.20 * (1.0 - F.col("val_brier"))
        + 0.15 * F.coalesce(F.col("val_recall_at_90_precision"), F.lit(0.0)) + 0.15 * scaled
    )
    scored = q.withColumn("selection_score", F.when(F.col("qualified"), score))
    place = F.row_number().over(Window.partitionBy("qualified").orderBy(F.col("selection_score").desc(), "model_id"))
    return scored.withColumn("selected_candidate", F.col("qualified") & (place == 1))


def select_candidate(models: DataFrame, gates: dict | None = None) -> DataFrame:
    """The chosen model, or no row when none qualifies."""
    return score_models(models, gates).filter("selected_candidate")


def earlier_selection_score(roc: Column, pr: Column, brier: Column) -> Column:
    """Score without gates and business value, kept for old records."""
    return 0.40 * roc + 0.40 * pr + 0.20 * (1.0 - brier)


def with_health(models: DataFrame) -> DataFrame:
    return models.withColumn("health", model_health(F.col("test_roc_auc"), F.col("test_brier")))


def current_status(events: DataFrame) -> DataFrame:
    """Model status from an append-only table of lifecycle events (model_id, event, at).

    Events are REGISTER, CANDIDATE, PROMOTE. At most one model is candidate and one is in
    production: the newest CANDIDATE holds unless a later PROMOTE cleared it or the model is
    the production model; the newest PROMOTE holds.
    """
    order = F.struct("at", "event", "model_id")

    def last(kind: str) -> Column:
        return F.max(F.when(F.col("event") == kind, order))

    marks = events.agg(last("CANDIDATE").alias("c"), last("PROMOTE").alias("p")).select(
        F.col("p.model_id").alias("production"),
        F.when(F.col("p").isNull() | (F.col("c.at") > F.col("p.at")), F.col("c.model_id")).alias("candidate"),
    )
    row = marks.first()
    is_production = F.col("model_id") == F.lit(row["production"])
    is_candidate = F.col("model_id") == F.lit(row["candidate"])
    return events.groupBy("model_id").agg(F.min("at").alias("registered_at"), F.max("at").alias("changed_at")).withColumn(
        "status",
        F.when(F.coalesce(is_production, F.lit(False)), "PRODUCTION")
        .when(F.coalesce(is_candidate, F.lit(False)), "CANDIDATE").otherwise("READY"),
    )


def top_importances(importances: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` most important features, largest first; equal ones by name, a missing importance never. Tasks hand on
    their own ``n`` rows."""
    known = importances.filter(F.col("importance").isNotNull() & ~F.isnan("importance"))
    return known.orderBy(F.desc("importance"), "feature").limit(n)


COMPARED = ["roc_auc", "pr_auc", "brier", "recall_at_90_precision"]


def production_record(records: DataFrame, events: DataFrame) -> DataFrame:
    """The record of the model that is in production now, found by its id; empty if there is none."""
    status = current_status(events).filter(F.col("status") == "PRODUCTION").select("model_id")
    return records.join(small_side(status), "model_id", "left_semi")


def model_comparison(models: DataFrame) -> DataFrame:
    """Test metrics of the production model and the candidate, side by side."""
    role = F.when(F.col("status") == "PRODUCTION", "Current Production").when(F.col("status") == "CANDIDATE", "Candidate")
    return (
        models.withColumn("role", role).filter("role IS NOT NULL")
        .select("role", "model_id", *[F.col(f"test_{m}").alias(m) for m in COMPARED])
    )
