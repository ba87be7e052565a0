"""Global positions, running totals and exact quantiles against plain Python."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orderlight.operators.ordering import global_rank, running_totals
from orderlight.operators.quantiles import exact_quantiles
from tests.conftest import rows


def test_global_rank_with_one_hot_first_key(spark):
    data = [(0 if i % 3 else i, f"k{i:04d}") for i in range(2000)]
    random.Random(1).shuffle(data)
    got = dict((r["k"], r["rank"]) for r in global_rank(spark.createDataFrame(data, "t INT, k STRING"), ["t", "k"]).collect())
    assert got == {k: i for i, (_, k) in enumerate(sorted(data))}


def test_missing_keys_rank_last(spark):
    df = spark.createDataFrame([(None, "b"), (2, "a"), (None, "a"), (1, "z")], "t INT, k STRING")
    assert sorted(rows(global_rank(df, ["t", "k"]), "rank", "t", "k")) == [(0, 1, "z"), (1, 2, "a"), (2, None, "a"), (3, None, "b")]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_per_group(spark, descending):
    rng = random.Random(2)
    data = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.randrange(5)) for i in range(1500)]
    rng.shuffle(data)
    out = running_totals(spark.createDataFrame(data, "g STRING, o INT, v BIGINT"), ["g"], ["o"], ["v"], descending, totals=True)
    want, seen = {}, {}
    for g, o, v in sorted(data, key=lambda r: -r[1] if descending else r[1]):
        want[o] = seen.get(g, 0)
        seen[g] = want[o] + v
    assert {r["o"]: (r["before_v"], r["total_v"]) for r in out.collect()} == {o: (want[o], seen[g]) for g, o, _ in data}


@pytest.mark.parametrize("bracket", [3, 40, 10**6])
def test_quantiles_equal_numpy(spark, bracket):
    rng = np.random.default_rng(5)
    x = np.where(rng.random(3000) < 0.6, 0.0, rng.lognormal(0, 3, 3000)) * np.sign(rng.random(3000) - 0.2)
    y = rng.integers(0, 4, 3000).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, float("nan"))], "x DOUBLE, y DOUBLE")
    probs = [0.0, 0.1, 0.333, 0.5, 0.61, 0.95, 1.0]
    got = exact_quantiles(df, ["x", "y"], probs, bracket)
    for c, v in (("x", x), ("y", y)):
        np.testing.assert_allclose(got[c], np.quantile(v, probs), rtol=1e-12, atol=0)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0])), min_size=1, max_size=60), st.floats(0, 1))
def test_any_quantile_of_any_list(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    got = exact_quantiles(df, ["v"], [q], bracket_rows=2)["v"][0]
    assert got == pytest.approx(float(np.quantile(values, q)), rel=1e-9, abs=1e-9)


def test_empty_columns_have_no_quantiles(spark):
    df = spark.createDataFrame([(None, 1.0)], "a DOUBLE, b DOUBLE")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": None, "b": [1.0]}
