"""Economics of the verification rule on labeled orders."""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlight.functions.economics import break_even, clip01, full_policy, whatif_policies
from orderlight.operators.binning import cell_counts

GRID_KEYS = [
    "avoidable_fulfillment_cost", "intervention_effectiveness", "intervention_cost",
    "false_positive_friction_cost",
]


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def backtest_columns(orders: Column, canceled: Column, held: Column, caught: Column, policy: dict[str, Column]) -> dict[str, Column]:
    """All backtest figures follow from four counts and the policy."""
    false_held = held - caught
    avoided = caught * policy["avoidable_fulfillment_cost"] * policy["intervention_effectiveness"]
    spent = held * policy["intervention_cost"]
    friction = false_held * policy["false_positive_friction_cost"]
    net = avoided - spent - friction
    return {
        "orders": orders,
        "canceled_orders": canceled,
        "interventions": held,
        "intervention_rate": _ratio(held, orders),
        "cancellations_intervened": caught,
        "cancellation_capture_rate": _ratio(caught, canceled),
        "false_interventions": false_held,
        "false_intervention_rate": _ratio(false_held, held),
        "estimated_avoided_cost": avoided,
        "intervention_cost_total": spent,
        "false_intervention_cost_total": friction,
        "net_savings": net,
        "net_savings_per_1000_orders": _ratio(net, orders) * 1000.0,
        "average_net_savings_per_intervention": _ratio(net, held),
    }


def policy_backtest(df: DataFrame, y: str, p: str, policy: dict | None = None, by: list[str] | None = None) -> DataFrame:
    """One row (per ``by`` group) of totals and rates for one policy."""
    pol = full_policy(policy)
    cut = break_even(pol)
    held = F.lit(False) if math.isinf(cut) else clip01(F.col(p)) >= F.lit(cut)
    yes = F.col(y) == 1
    counts = df.groupBy(*(by or [])).agg(
        F.count("*").alias("o"), F.count_if(yes).alias("c"),
        F.count_if(held).alias("h"), F.count_if(held & yes).alias("k"),
    )
    figures = backtest_columns(
        F.col("o"), F.col("c"), F.col("h"), F.col("k"), {k: F.lit(v) for k, v in pol.items()}
    )
    return counts.select(*(by or []), *[c.alias(k) for k, c in figures.items()])


def policies_backtest(df: DataFrame, y: str, p: str, policies: list[dict]) -> DataFrame:
    """Many policies in one pass over the rows, without pairing rows with policies.

    A policy holds exactly the scores at or above its break-even point. Rows are counted by
    how many of the sorted break-even points they reach (at most policies + 1 groups); each
    policy then sums the groups at or above its own place.
    """
    full = [full_policy(x) for x in policies]
    cuts = [break_even(x) for x in full]
    points = sorted({c for c in cuts if math.isfinite(c)})
    score = clip01(F.col(p))
    counted_by = df.select(score.alias("all"), F.when(F.col(y) == 1, score).alias("positive"))
    # At most 2 x (2 x policies + 1) rows come back; suffix sums over them are plain arithmetic.
    seen = {"all": {}, "positive": {}}
    for r in cell_counts(counted_by, {"all": points, "positive": points}).collect():
        reached = (r["cell"] + 1) // 2
        seen[r["feature"]][reached] = seen[r["feature"]].get(reached, 0) + r["n"]

    def at_least(place: int) -> tuple[int, int]:
        return tuple(sum(n for k, n in seen[side].items() if k >= place) for side in ("all", "positive"))

    everyone = at_least(0)
    counted = df.sparkSession.createDataFrame(
        [
            (i, *[x[k] for k in GRID_KEYS], *everyone,
             *(at_least(points.index(c) + 1) if math.isfinite(c) else (0, 0)))
            for i, (x, c) in enumerate(zip(full, cuts))
        ],
        "policy_id INT, " + ", ".join(f"{k} DOUBLE" for k in GRID_KEYS) + ", o BIGINT, c BIGINT, h BIGINT, k BIGINT",
    )
    figures = backtest_columns(
        F.col("o"), F.col("c"), F.col("h"), F.col("k"), {k: F.col(k) for k in GRID_KEYS}
    )
    return counted.select("policy_id", *GRID_KEYS, *[c.alias(k) for k, c in figures.items()])


def sensitivity_grid(
    df: DataFrame, y: str, p: str,
    fulfillment_costs: Iterable[float], effectiveness: Iterable[float], intervention_costs: Iterable[float],
    friction_cost: float = 50.0,
) -> DataFrame:
    grid = [
        dict(zip(GRID_KEYS, (float(a), float(e), float(c), float(friction_cost))))
        for a, e, c in product(fulfillment_costs, effectiveness, intervention_costs)
    ]
    return policies_backtest(df, y, p, grid).select(
        *GRID_KEYS, "interventions", "intervention_rate", "cancellation_capture_rate",
        "false_intervention_rate", "net_savings", "net_savings_per_1000_orders",
    )


def whatif_scenarios(df: DataFrame, y: str, p: str, base: dict | None = None) -> DataFrame:
    named = whatif_policies(base)
    table = policies_backtest(df, y, p, list(named.values()))
    names = F.array(*[F.lit(n) for n in named])
    return table.withColumn("scenario", F.element_at(names, F.col("policy_id") + 1)).drop("policy_id")
