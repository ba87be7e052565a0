"""Shape of the physical plans of the heavy operators."""

import re

import pytest

from checks.catalog import QUERIES
from checks.oracles import ORACLES
from checks.tables import Tables
from orderlight.operators import backtest, curves, monitoring
from orderlight.operators.orders import aggregate_to_orders
from orderlight.operators.sampling import temporal_split

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_order_aggregation_is_one_combining_shuffle(tables):
    text = plan(aggregate_to_orders(tables.valid))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text and "SinglePartition" not in text


def test_history_is_one_shuffle(tables):
    text = plan(tables.history)
    assert text.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in text


def test_split_moves_no_rows(tables):
    assert "Exchange" not in plan(temporal_split(tables.labeled))


def test_latest_rows_combine_before_the_shuffle(tables):
    text = plan(monitoring.latest_predictions(tables.predictions))
    assert "partial_max_by" in text and "Window" not in text


def test_scans_read_only_needed_columns(tables):
    text = plan(backtest.policy_backtest(tables.labeled, "is_canceled", "probability"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"o_orderstatus", "o_totalprice", "o_orderpriority"}


def test_curves_sort_in_parts(tables):
    text = plan(curves.roc_points(curves.curve_points(tables.labeled, "is_canceled", "probability")))
    # The only ordered single-partition step runs over one row per part.
    assert text.count("Exchange SinglePartition") <= 2 and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", [
    "business_impact", "order_lifecycle", "apply_outcomes", "decision_log", "sensitivity_grid", "quarantine_existing", "model_lifecycle", "version_history"])
def test_no_pairing_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
