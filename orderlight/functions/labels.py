"""Small classifications: risk, drift, outcomes, modes, lifecycle texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderlight.contract import (
    APPROVE, HIGH_MIN, HOLD, LOW_MAX, MODE_LABELS, PRODUCTION_MODES, PSI_CUTS, TV_CUTS, UNKNOWN_MODE,
)
from orderlight.functions.cleaning import strip


def risk_level(p: Column, threshold: Column) -> Column:
    # NaN is larger than any number; it counts as missing, as null does.
    return F.when((p >= threshold) & ~F.isnan(p), "HIGH").otherwise("LOW")


def risk_band(p: Column) -> Column:
    return F.when(p < LOW_MAX, "LOW").when(p < HIGH_MIN, "MEDIUM").otherwise("HIGH")


def drift_label(score: Column, cuts: tuple[float, float] = PSI_CUTS) -> Column:
    return (
        F.when(score.isNull() | F.isnan(score), "INSUFFICIENT DATA")
        .when(score < cuts[0], "STABLE")
        .when(score < cuts[1], "WATCH")
        .otherwise("DRIFT")
    )


def psi_label(score: Column) -> Column:
    return drift_label(score, PSI_CUTS)


def tv_label(score: Column) -> Column:
    return drift_label(score, TV_CUTS)


def scoring_mode(raw: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(strip(raw)), F.lit("")), F.lit(UNKNOWN_MODE))


def is_production(mode: Column) -> Column:
    return mode.isin(PRODUCTION_MODES)


def mode_label(mode: Column) -> Column:
    pairs = [F.lit(x) for kv in MODE_LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), mode), mode)


def outcome_flag(raw: Column) -> Column:
    word = F.lower(strip(raw))
    return F.when(word.isin("canceled", "cancelled"), 1).when(word.isin("completed", "complete"), 0)


def outcome_text(raw: Column) -> Column:
    flag = outcome_flag(raw)
    return F.when(flag == 1, "Canceled").when(flag == 0, "Completed")


def lifecycle_status(decision: Column) -> Column:
    return (
        F.when(decision.isNull(), "AWAITING_OPERATIONS_REVIEW")
        .when(decision == APPROVE, "RELEASED_TO_FULFILLMENT")
        .otherwise("VERIFICATION_REQUIRED")
    )


# Texts shown to the customer.
CUSTOMER_MESSAGES = {
    "AWAITING_OPERATIONS_REVIEW": "Order received. Please wait while our operations team completes a short verification review.",
    "RELEASED_TO_FULFILLMENT": "Order approved. Your order has been released to fulfillment.",
    "VERIFICATION_REQUIRED": "Additional verification is required before fulfillment. The order remains on hold.",
}

# Display names.
RECOMMENDATION_LABELS = {HOLD: "Keep for verification", APPROVE: "Release to fulfillment"}
SOURCE_LABELS = {
    "manual": "Manual order", "simulation_live": "Demo simulation", "production_manual": "Production manual",
}


def renamed(c: Column, names: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def customer_message(status: Column) -> Column:
    pairs = [F.lit(x) for kv in CUSTOMER_MESSAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), status)


def model_health(roc: Column, brier: Column) -> Column:
    return (
        F.when(roc.isNull() & brier.isNull(), "No metrics")
        .when((F.coalesce(roc, F.lit(0.0)) >= 0.90) & (F.coalesce(brier, F.lit(1.0)) <= 0.12), "Strong")
        .when((F.coalesce(roc, F.lit(0.0)) >= 0.82) & (F.coalesce(brier, F.lit(1.0)) <= 0.20), "Good")
        .otherwise("Needs review")
    )
