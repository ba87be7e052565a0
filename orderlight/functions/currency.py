"""PKR <-> USD at a given rate. Stored amounts stay in PKR; only exports convert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Money columns of a scored batch and their export names.
EXPORT_NAMES = {
    "price": "price_usd",
    "grand_total": "grand_total_usd",
    "discount_amount": "discount_amount_usd",
    "expected_avoidable_cost": "expected_money_saved_usd",
    "expected_false_positive_cost": "expected_unnecessary_check_cost_usd",
    "net_expected_savings": "expected_net_savings_usd",
}
INPUT_MONEY = ["price", "grand_total", "discount_amount"]


def _checked(rate: float) -> float:
    rate = float(rate)
    if not rate > 0:
        raise ValueError("rate must be above zero")
    return rate


def to_usd(pkr: Column, rate: float) -> Column:
    return pkr * F.lit(float(rate))


def to_pkr(usd: Column, rate: float) -> Column:
    return usd / F.lit(_checked(rate))


def usd_text(pkr: Column, rate: float, decimals: int = 2) -> Column:
    usd = to_usd(pkr, rate)
    return F.concat(F.when(usd < 0, "-$").otherwise("$"), F.format_number(F.abs(usd), decimals))


def inputs_in_pkr(orders: DataFrame, rate: float) -> DataFrame:
    from orderlight.functions.cleaning import to_number

    money = [c for c in INPUT_MONEY if c in orders.columns]
    return orders.withColumns({c: to_pkr(to_number(orders, c), rate) for c in money})


def scored_export(scored: DataFrame, rate: float) -> DataFrame:
    money = [c for c in EXPORT_NAMES if c in scored.columns]
    return (
        scored.withColumns({c: to_usd(F.col(c), rate) for c in money})
        .withColumnsRenamed({c: EXPORT_NAMES[c] for c in money})
        .withColumn("fx_pkr_to_usd", F.lit(float(rate)))
    )
