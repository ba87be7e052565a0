"""Decisions, backtests, policies and currency."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orderlight.functions import currency
from orderlight.functions.economics import break_even, economics, effective_policy, full_policy, policy_net, whatif_policies
from orderlight.operators.backtest import GRID_KEYS, policies_backtest, policy_backtest, sensitivity_grid, whatif_scenarios
from tests.conftest import rows

POLICY = {"avoidable_fulfillment_cost": 100.0, "intervention_effectiveness": 0.5, "intervention_cost": 10.0, "false_positive_friction_cost": 5.0}


def labeled(spark, y, p):
    return spark.createDataFrame(list(zip(y, p)), "y INT, p DOUBLE")


def test_backtest_figures(spark):
    out = policy_backtest(labeled(spark, [1, 0, 1, 0], [0.9, 0.9, 0.1, 0.1]), "y", "p", POLICY).first().asDict()
    assert (out["interventions"], out["cancellations_intervened"], out["false_interventions"]) == (2, 1, 1)
    assert (out["estimated_avoided_cost"], out["intervention_cost_total"], out["false_intervention_cost_total"]) == (50.0, 20.0, 5.0)
    assert (out["net_savings"], out["net_savings_per_1000_orders"]) == (25.0, 6250.0)
    assert out["average_net_savings_per_intervention"] == 12.5


def test_backtest_rates_without_interventions_or_cancellations(spark):
    out = policy_backtest(labeled(spark, [0, 0], [0.0, 0.01]), "y", "p").first().asDict()
    assert (out["interventions"], out["false_intervention_rate"], out["cancellation_capture_rate"], out["net_savings"]) == (0, 0.0, 0.0, 0.0)


def test_scores_outside_the_unit_interval_are_clipped(spark):
    df = spark.createDataFrame([(5.0,), (-3.0,)], "p DOUBLE").withColumns(economics(F.col("p")))
    assert rows(df, "expected_avoidable_cost", "recommendation") == [(1100.0, "Hold for Verification"), (0.0, "Approve for Fulfillment")]


def test_break_even_is_the_exact_switch_point():
    rng = random.Random(4)
    for _ in range(300):
        pol = {k: rng.choice([0.0, rng.random(), rng.uniform(0, 5000)]) for k in GRID_KEYS}
        cut = break_even(pol)
        if math.isinf(cut):
            assert policy_net(1.0, pol) <= 0
        else:
            assert policy_net(cut, pol) > 0
            assert cut == 0 or policy_net(math.nextafter(cut, -1), pol) <= 0


def test_grid_equals_one_backtest_per_policy(spark):
    rng = random.Random(6)
    df = labeled(spark, [rng.randrange(2) for _ in range(400)], [round(rng.random(), 2) for _ in range(400)])
    policies = [{k: rng.choice([0.0, 0.3, 20.0, 900.0]) for k in GRID_KEYS} for _ in range(12)]
    many = {r["policy_id"]: r.asDict() for r in policies_backtest(df, "y", "p", policies).collect()}
    for i, pol in enumerate(policies):
        one = policy_backtest(df, "y", "p", pol).first().asDict()
        assert {k: many[i][k] for k in one} == one


def test_grid_has_one_row_per_combination(spark):
    out = sensitivity_grid(labeled(spark, [1, 0], [0.8, 0.2]), "y", "p", [1000, 2000], [0.4, 0.6], [100, 200])
    assert out.count() == 8


def test_whatif_effectiveness_is_clamped(spark):
    low = whatif_policies({"intervention_effectiveness": 0.1})["Conservative"]
    high = whatif_policies({"intervention_effectiveness": 0.9})["Favorable"]
    assert (low["intervention_effectiveness"], high["intervention_effectiveness"]) == (0.05, 0.95)
    assert whatif_scenarios(labeled(spark, [1, 0], [0.8, 0.2]), "y", "p").count() == 3


def test_stored_policy_over_defaults(spark):
    texts = ['{"intervention_cost": 7, "other": 1}', "oops", '{"intervention_cost": "x", "false_positive_friction_cost": 1}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, policy_json STRING")
    got = {r["i"]: (r["intervention_cost"], r["false_positive_friction_cost"]) for r in effective_policy(df).collect()}
    assert got == {0: (7.0, 50.0), 1: (150.0, 50.0), 2: (150.0, 50.0), 3: (150.0, 50.0)}
    assert full_policy({"unknown": 3})["intervention_cost"] == 150.0


def test_currency(spark):
    df = spark.createDataFrame([(2500.0,), (-2500.0,), (1234567.891,)], "pkr DOUBLE")
    out = df.select(
        currency.usd_text(F.col("pkr"), 0.004).alias("t"),
        currency.to_pkr(currency.to_usd(F.col("pkr"), 0.004), 0.004).alias("back"))
    assert [r["t"] for r in out.collect()] == ["$10.00", "-$10.00", "$4,938.27"]
    assert [r["back"] for r in out.collect()][:2] == [2500.0, -2500.0]
    with pytest.raises(ValueError):
        currency.to_pkr(F.col("pkr"), 0.0)


def test_usd_uploads_are_converted_before_scoring(spark):
    df = currency.inputs_in_pkr(spark.createDataFrame([("o", "10", "x")], "order_id STRING, price STRING, grand_total STRING"), 0.004)
    assert rows(df, "price", "grand_total") == [(2500.0, None)]


def test_missing_scores_stay_missing(spark):
    df = spark.createDataFrame([(None,)], "p DOUBLE").withColumns(economics(F.col("p")))
    assert rows(df, "expected_avoidable_cost", "recommendation") == [(None, "Approve for Fulfillment")]
