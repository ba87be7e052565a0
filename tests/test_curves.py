"""Ranking and threshold metrics against direct computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlight.operators import curves
from tests.conftest import rows


def frame(spark, y, p):
    return spark.createDataFrame(list(zip([int(v) for v in y], [float(v) for v in p])), "y INT, p DOUBLE")


def sample(seed, n=400, step=0.02):
    rng = random.Random(seed)
    p = [round(rng.random() / step) * step for _ in range(n)]
    y = [int(rng.random() < 0.2 + 0.6 * v) for v in p]
    return np.array(y), np.array(p)


def brute(y, p):
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap = last = 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall, precision = (y[hit] == 1).sum() / (y == 1).sum(), y[hit].mean()
        ap += (recall - last) * precision
        last = recall
    return auc, ap


def f1(y, p, t):
    hit = p >= t
    tp = (y[hit] == 1).sum()
    return 0.0 if hit.sum() + y.sum() == 0 else 2 * tp / (hit.sum() + y.sum())


@pytest.mark.parametrize("seed", [1, 2])
def test_metrics_match_direct_computation(spark, seed):
    y, p = sample(seed)
    auc, ap = brute(y, p)
    m = curves.classification_metrics(curves.curve_points(frame(spark, y, p), "y", "p"), F.lit(0.5)).first().asDict()
    assert m["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert m["pr_auc"] == pytest.approx(ap, abs=1e-12)
    assert m["brier"] == pytest.approx(np.mean((p - y) ** 2), abs=1e-12)
    assert m["f1"] == pytest.approx(f1(y, p, 0.5), abs=1e-12)


@pytest.mark.parametrize("seed", [3, 4])
def test_best_threshold_is_the_first_maximum(spark, seed):
    y, p = sample(seed, step=0.005)
    scores = [f1(y, p, t) for t in np.linspace(0.05, 0.95, 181)]
    got = curves.best_f1_threshold(frame(spark, y, p), "y", "p").first()
    i = int(np.argmax(scores))
    assert got["threshold"] == np.linspace(0.05, 0.95, 181)[i]
    assert got["f1"] == pytest.approx(scores[i], abs=1e-12)


def test_scores_on_the_threshold_count_as_reached(spark):
    grid = np.linspace(0.05, 0.95, 181)
    df = spark.createDataFrame([(float(t),) for t in grid] + [(0.0,), (1.0,), (-1.0,)], "p DOUBLE")
    got = [r[0] for r in df.select(curves._thresholds_reached(F.col("p"))).collect()]
    assert got == list(range(1, 182)) + [0, 181, 0]


def test_no_score_above_the_lowest_threshold(spark):
    assert rows(curves.best_f1_threshold(frame(spark, [1, 0], [0.0, 0.01]), "y", "p"), "threshold", "f1") == [(0.05, 0.0)]


def test_fixed_precision(spark):
    df = frame(spark, [1, 1, 0, 0, 1, 0], [0.95, 0.90, 0.80, 0.20, 0.85, 0.10])
    out = curves.recall_at_precision(curves.curve_points(df, "y", "p"), (0.9,)).first().asDict()
    assert out == {"recall_at_90_precision": 1.0, "precision_at_90_precision": 1.0, "threshold_at_90_precision": 0.85}


def test_unattainable_precision(spark):
    df = frame(spark, [0, 1, 0, 0], [0.9, 0.8, 0.7, 0.6])
    out = curves.recall_at_precision(curves.curve_points(df, "y", "p"), (0.9,)).first().asDict()
    assert out == {"recall_at_90_precision": 0.0, "precision_at_90_precision": 0.5, "threshold_at_90_precision": 1.0}


def test_one_class_has_no_area(spark):
    m = curves.classification_metrics(curves.curve_points(frame(spark, [0, 0], [0.9, 0.2]), "y", "p"), F.lit(0.5)).first()
    assert m["roc_auc"] is None and m["f1"] == 0.0 and m["recall"] == 0.0


def test_many_models_in_one_pass(spark):
    parts, want = [], {}
    for seed in (5, 6, 7):
        y, p = sample(seed, 200)
        want[f"m{seed}"] = brute(y, p)
        parts += [(f"m{seed}", int(a), float(b)) for a, b in zip(y, p)]
    df = spark.createDataFrame(parts, "model STRING, y INT, p DOUBLE")
    points = curves.curve_points(df, "y", "p", ["model"])
    got = {r["model"]: (r["roc_auc"], r["pr_auc"]) for r in curves.classification_metrics(points, F.lit(0.5), ["model"]).collect()}
    for m in want:
        assert got[m] == pytest.approx(want[m], abs=1e-12)
    best = {r["model"]: r["threshold"] for r in curves.best_f1_threshold(df, "y", "p", ["model"]).collect()}
    assert set(best) == set(want)


def test_calibration_bins_hold_every_row(spark):
    y, p = sample(8, 500, 0.01)
    out = curves.calibration_bins(frame(spark, y, p), "y", "p").collect()
    assert sum(r["rows"] for r in out) == 500
    edges = np.quantile(p, np.linspace(0, 1, 11))
    bins = np.searchsorted(edges[1:-1], p)
    for r in out:
        assert r["mean_predicted"] == pytest.approx(p[bins == r["bin"]].mean())
        assert r["fraction_positive"] == pytest.approx(y[bins == r["bin"]].mean())
