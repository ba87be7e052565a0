"""Logistic regressions of many folds and parameters in shared passes."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from orderlight.contract import CATEGORICAL_FEATURES, FEATURES, NUMERIC_FEATURES, TARGET
from orderlight.operators import explain, linear
from orderlight.plans import training
from tests.test_models import snapshot


def noisy(spark, n=500):
    data = snapshot(spark, n)
    flip = F.pmod(F.xxhash64("order_id"), F.lit(5)) == 0
    holes = F.pmod(F.xxhash64("order_id"), F.lit(7)) == 0
    return data.withColumns({
        TARGET: F.when(flip, 1 - F.col(TARGET)).otherwise(F.col(TARGET)), "price": F.when(~holes, F.col("price")),
        "payment_method": F.when(~holes, F.col("payment_method"))}).cache()


def test_weights_are_the_optimum_of_sparks_objective(spark):
    prepared = training.prepared_snapshot(noisy(spark))
    for params in ({}, {"class_weight": "balanced", "C": 0.05}):
        model = training.fit_family(prepared, "logistic_regression", params)
        weights = training.weights_by_class(params.get("class_weight"), prepared.train_rows, prepared.positives)
        own = model.stages[-1]
        rows = model.transform(training.imputed(prepared.table.filter("split = 'train'"), prepared.fill)).select("features", TARGET).collect()
        x, y = np.array([r.features.toArray() for r in rows]), np.array([r[TARGET] for r in rows])
        w, beta = np.where(y == 1, weights[1], weights[0]), own.coefficients.toArray()
        p = 1 / (1 + np.exp(-(x @ beta + own.intercept)))
        assert x.T @ (w * (p - y)) / w.sum() + own.getRegParam() * beta == pytest.approx(0, abs=1e-5)
        assert w @ (p - y) / w.sum() == pytest.approx(0, abs=1e-5)
        learner = training.estimator("logistic_regression", prepared.train_rows, {**params, "max_iter": 1000})
        learner.setTol(1e-12)
        weighted = training.imputed(prepared.table.filter("split = 'train'"), prepared.fill).withColumn(
            "weight", training.class_weight(params.get("class_weight"), prepared.train_rows, prepared.positives))
        spark_own = Pipeline(stages=[*training.encoder_stages(True), learner]).fit(weighted).stages[-1]
        assert beta == pytest.approx(spark_own.coefficients.toArray(), abs=1e-3)
        assert own.intercept == pytest.approx(spark_own.intercept, abs=1e-3) and own.getMaxIter() == 600


def test_folds_and_candidates_share_their_passes(spark, monkeypatch):
    data, passes = noisy(spark), []
    one = linear._pass
    monkeypatch.setattr(linear, "_pass", lambda table, tasks, betas, *rest: passes.append(len(betas)) or one(table, tasks, betas, *rest))
    candidates = [{"C": 0.1}, {"C": 1.0, "max_iter": 200}]
    out = {r.candidate: r for r in training.cross_validate(data, "logistic_regression", candidates, folds=3).collect()}
    assert passes[0] == 6 and len(passes) < 15  # one fit after the other would take over a hundred
    assert {i: r.folds for i, r in out.items()} == {0: 3, 1: 3}
    assert all(0.5 < r.mean_roc_auc <= 1 for r in out.values())


def test_models_of_a_fold_are_those_fitted_alone(spark):
    from dataclasses import replace

    table = training.stored(noisy(spark).select("order_id", "created_at", *FEATURES, TARGET).withColumn("fold", F.pmod(F.xxhash64("order_id"), F.lit(3)).cast("int")))
    bases = explain.baselines_without(table, "fold", 3)
    wanted = []
    for f, base in enumerate(bases):
        rest = table.filter(F.col("fold") != f)
        assert base == explain.feature_baseline(rest)
        size = rest.agg(F.count("*").alias("n"), F.sum(TARGET).alias("y")).first()
        inside = F.col("fold") != f
        marked = table.withColumn("split", F.when(inside, "train").otherwise("validation"))
        wanted.append((training.Prepared(marked, base, [], size.n, size.y, "", training=inside), [{"C": 0.3}, {"C": 3.0}]))
    together = training.fit_together(wanted, "logistic_regression")
    for (p, params), models in zip(wanted[:2], together):
        alone = [training.fit_family(p, "logistic_regression", c) for c in params]
        for a, b in zip(models, alone):
            assert a.stages[-1].coefficients.toArray() == pytest.approx(b.stages[-1].coefficients.toArray(), abs=1e-9)
        held = p.table.filter("split = 'validation'")
        each = {(r.candidate, r.order_id): r.probability for r in training.predicted_by_each(models, held, p.fill).collect()}
        for i, m in enumerate(alone):
            for r in training.predicted(m, held, p.fill).collect():
                assert each[i, r.order_id] == pytest.approx(r.probability, abs=1e-9)


def test_wide_models_go_to_sparks_learner(spark, monkeypatch):
    monkeypatch.setattr(linear, "MOST_WIDTH", 3)
    monkeypatch.setattr(linear, "newton", lambda *a: pytest.fail("too wide"))
    model = training.fit_family(training.prepared_snapshot(noisy(spark, 300)), "logistic_regression", {"max_iter": 3})
    assert model.stages[-1].summary.totalIterations <= 3
    assert len(NUMERIC_FEATURES) + len(CATEGORICAL_FEATURES) > 3
