"""Verification policy as column expressions."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlight.contract import APPROVE, DEFAULT_POLICY, HOLD


def full_policy(policy: dict | None = None) -> dict[str, float]:
    return {**DEFAULT_POLICY, **{k: float(v) for k, v in (policy or {}).items() if k in DEFAULT_POLICY}}


def clip01(p: Column) -> Column:
    """``p`` limited to [0, 1]; a missing or NaN score is missing (``least`` alone would give 1)."""
    return F.when(p.isNotNull() & ~F.isnan(p), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def economics(p: Column, policy: dict | None = None) -> dict[str, Column]:
    """Expected value of verifying one order with cancellation probability ``p``."""
    pol = full_policy(policy)
    q = clip01(p)
    avoidable = q * F.lit(pol["avoidable_fulfillment_cost"]) * F.lit(pol["intervention_effectiveness"])
    friction = (F.lit(1.0) - q) * F.lit(pol["false_positive_friction_cost"])
    net = avoidable - F.lit(pol["intervention_cost"]) - friction
    return {
        "expected_avoidable_cost": avoidable,
        "expected_false_positive_cost": friction,
        "net_expected_savings": net,
        "recommendation": F.when(net > 0, HOLD).otherwise(APPROVE),
    }


def policy_columns(policy: dict | None = None) -> dict[str, Column]:
    return {k: F.lit(v) for k, v in full_policy(policy).items()}


def policy_net(p: float, policy: dict) -> float:
    return (
        p * policy["avoidable_fulfillment_cost"] * policy["intervention_effectiveness"]
        - policy["intervention_cost"]
        - (1.0 - p) * policy["false_positive_friction_cost"]
    )


def break_even(policy: dict | None = None) -> float:
    """Smallest probability in [0, 1] whose expected net value is positive (inf if none).

    The net value never falls as ``p`` rises, also in floating point, so a bisection over the
    ordered bit patterns of the doubles in [0, 1] finds the exact switch point. Holding an
    order is then the plain test ``p >= break_even``.
    """
    pol = full_policy(policy)
    if min(pol["avoidable_fulfillment_cost"], pol["intervention_effectiveness"], pol["false_positive_friction_cost"]) < 0:
        raise ValueError("costs and effectiveness must not be negative")
    if policy_net(1.0, pol) <= 0:
        return math.inf

    def as_double(bits: int) -> float:
        return struct.unpack("<d", struct.pack("<q", bits))[0]

    low, high = -1, struct.unpack("<q", struct.pack("<d", 1.0))[0]
    while high - low > 1:
        mid = (low + high) // 2
        if policy_net(as_double(mid), pol) > 0:
            high = mid
        else:
            low = mid
    return as_double(high)


def whatif_policies(base: dict | None = None) -> dict[str, dict[str, float]]:
    """Conservative / current / favorable assumption sets around one policy."""
    b = full_policy(base)

    def scaled(benefit: float, cost: float, shift: float) -> dict[str, float]:
        return {
            "avoidable_fulfillment_cost": b["avoidable_fulfillment_cost"] * benefit,
            "intervention_effectiveness": b["intervention_effectiveness"] + shift,
            "intervention_cost": b["intervention_cost"] * cost,
            "false_positive_friction_cost": b["false_positive_friction_cost"] * cost,
        }

    low, high = scaled(0.75, 1.25, -0.15), scaled(1.25, 0.75, 0.15)
    low["intervention_effectiveness"] = max(0.05, low["intervention_effectiveness"])
    high["intervention_effectiveness"] = min(0.95, high["intervention_effectiveness"])
    return {"Conservative": low, "Current assumptions": b, "Favorable": high}


def effective_policy(stored_json: DataFrame, column: str = "policy_json") -> DataFrame:
    """Stored policy text over the defaults. Unknown keys are dropped; if the text is not a
    JSON object or one of its values is not a number, the defaults apply as a whole."""
    raw = F.from_json(F.col(column), "MAP<STRING,STRING>")
    known = F.map_filter(raw, lambda k, v: k.isin(list(DEFAULT_POLICY)))
    readable = raw.isNotNull() & F.forall(F.map_values(known), lambda v: v.try_cast("double").isNotNull())
    return stored_json.select(
        "*",
        *[
            F.coalesce(
                F.when(readable, F.try_element_at(known, F.lit(k)).try_cast("double")), F.lit(v)
            ).alias(k)
            for k, v in DEFAULT_POLICY.items()
        ],
    )
