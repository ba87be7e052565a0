"""PSI, category shift, labels and the feature table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlight.contract import FEATURES, NUMERIC_FEATURES
from orderlight.functions.labels import psi_label, tv_label
from orderlight.operators import drift
from tests.conftest import rows


def column(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x DOUBLE")


def psi(spark, a, b):
    return drift.psi_table(column(spark, a), column(spark, b), ["x"]).first()["psi"]


def direct_psi(ref, cur):
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    inner = edges[1:-1]
    r = np.bincount(np.searchsorted(inner, ref), minlength=len(inner) + 1) / len(ref)
    c = np.bincount(np.searchsorted(inner, cur), minlength=len(inner) + 1) / len(cur)
    r, c = np.clip(r, 1e-6, None), np.clip(c, 1e-6, None)
    return float(np.sum((c - r) * np.log(c / r)))


def test_same_and_shifted(spark):
    same = np.linspace(0, 1, 200)
    assert psi(spark, same, same) < 0.01
    shifted = psi(spark, same, np.linspace(2, 3, 200))
    assert shifted > 0.25
    df = spark.createDataFrame([(shifted,)], "s DOUBLE")
    assert df.select(psi_label(F.col("s"))).first()[0] == "DRIFT"


def test_duplicate_edges_and_values_outside(spark):
    rng = np.random.default_rng(1)
    ref = np.round(rng.exponential(2.0, 300))
    cur = np.concatenate([np.round(rng.exponential(3.0, 200)), [-50, 900]])
    assert psi(spark, ref, cur) == pytest.approx(direct_psi(ref, cur), abs=1e-12)


def test_small_or_constant_sides(spark):
    assert psi(spark, [1.0] * 19 + [None] * 10, range(50)) is None
    assert psi(spark, range(50), [float("nan")] * 40 + [1.0] * 10) is None
    assert psi(spark, [3.0] * 50, range(50)) == 0.0


def text(spark, values):
    return spark.createDataFrame([(v,) for v in values], "c STRING")


def test_total_variation(spark):
    half = ["a"] * 50 + ["b"] * 50
    table = drift.total_variation_table(text(spark, half), text(spark, half), ["c"])
    assert table.first()["total_variation"] == 0.0
    moved = drift.total_variation_table(text(spark, half), text(spark, ["a"] * 50 + [None] * 50), ["c"])
    assert moved.first()["total_variation"] == 0.5
    assert drift.total_variation_table(text(spark, half), text(spark, ["a"] * 19), ["c"]).first()["total_variation"] is None


def test_labels(spark):
    df = spark.createDataFrame([(None,), (0.05,), (0.10,), (0.20,), (0.25,)], "s DOUBLE")
    assert [tuple(r) for r in df.select(psi_label(F.col("s")), tv_label(F.col("s"))).collect()] == [
        ("INSUFFICIENT DATA", "INSUFFICIENT DATA"), ("STABLE", "STABLE"), ("WATCH", "WATCH"), ("WATCH", "DRIFT"), ("DRIFT", "DRIFT")]


def test_feature_table_covers_all_features(spark):
    rng = random.Random(2)
    cols = [f"{c} DOUBLE" if c in NUMERIC_FEATURES else f"{c} STRING" for c in FEATURES]

    def frame(shift):
        return spark.createDataFrame(
            [tuple(rng.random() + shift if c in NUMERIC_FEATURES else rng.choice("ab") for c in FEATURES) for _ in range(120)], ", ".join(cols))

    out = {r["feature"]: (r["metric"], r["status"]) for r in drift.feature_drift(frame(0.0), frame(5.0)).collect()}
    assert set(out) == set(FEATURES)
    assert out["price"] == ("PSI", "DRIFT") and out["payment_method"][0] == "Total variation"
    assert drift.feature_drift(frame(0.0), frame(0.0).limit(0)).count() == 0


def test_severe_needs_rows_and_evidence(spark):
    table = spark.createDataFrame([("a", "DRIFT"), ("b", "DRIFT"), ("c", "STABLE")], "feature STRING, status STRING")

    def severe(n, p):
        return drift.severe_drift(table.filter("status != 'x'"), F.lit(n), F.lit(p).cast("double")).first()["severe_drift"]

    assert severe(100, None) and not severe(99, 0.9)
    one = table.filter("feature = 'a'")
    assert drift.severe_drift(one, F.lit(500), F.lit(0.25)).first()["severe_drift"]
    assert not drift.severe_drift(one, F.lit(500), F.lit(0.24)).first()["severe_drift"]
