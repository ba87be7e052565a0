"""Boosted trees over binned rows, against brute force, Spark's model class and other dealings of the rows."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlight.contract import TARGET
from orderlight.operators import boosting
from orderlight.plans import training
from tests.test_models import snapshot

NUMBERS, TEXTS = ["a", "b"], ["t"]


def table(spark, n=3000):
    rng = np.random.default_rng(5)
    a, b, t = rng.random(n), rng.integers(0, 5, n).astype(float), rng.choice(["x", "y", "z"], n)
    y = ((a > 0.6) ^ (t == "y") | (b == 3)).astype(int)
    return spark.createDataFrame([(i, float(a[i]), float(b[i]), str(t[i]), int(y[i])) for i in range(n)], "id BIGINT, a DOUBLE, b DOUBLE, t STRING, y INT").cache()


def grown(spark, rows, parts, trees=6, rate=0.8, weights=(1.0, 1.0)):
    layout = boosting.layout_of(rows, NUMBERS, [["x", "y", "z"]])
    blocks = boosting.coded_blocks(rows, NUMBERS, TEXTS, "y", F.col("id"), layout, 7, parts)
    return layout, boosting.boosted(blocks, layout, trees, 0.1, 3, 10, rate, weights)


def test_one_task_and_many_grow_the_same_trees(spark):
    rows = table(spark)
    for weights in ((1.0, 1.0), (1.0, 3.5)):
        one, many = (grown(spark, rows, parts, weights=weights)[1] for parts in (1, 3))
        for a, b in zip(one, many, strict=True):
            assert all((x[0] == y[0]).all() and (x[1] == y[1]).all() for x, y in zip(a.levels, b.levels, strict=True))
            assert a.leaves() == pytest.approx(b.leaves())


def test_first_split_is_the_best_of_all(spark):
    rows = table(spark, 400)
    layout, trees = grown(spark, rows, 1, 1, 1.0)
    data = rows.collect()
    y = np.array([2.0 * r.y - 1.0 for r in data])

    def gain(right):
        right = np.array(right)
        if min(right.sum(), (~right).sum()) < 10:
            return -1.0
        return y.var() - (y[right].var() * right.sum() + y[~right].var() * (~right).sum()) / len(y)

    found = [gain([r[c] > e for r in data]) for i, c in enumerate(NUMBERS) for e in layout.edges[i]]
    found += [gain([r.t == v for r in data]) for v in ("x", "y", "z")]
    assert trees[0].gains[0][0] == pytest.approx(max(found))
    assert layout.edges[1].tolist() == [0.5, 1.5, 2.5, 3.5]


def test_words_hold_every_combination():
    sizes = [32, 5, 32, 2, 2, 7, 24, 32, 7, 4, 3000]
    words = boosting.shared_words(sizes)
    assert sorted(f for w in words for f in w) == list(range(len(sizes)))
    layout = boosting.Layout([np.arange(s - 1.0) for s in sizes], [], words)
    for w, features in enumerate(words):
        assert layout.width(w) <= boosting.WORD or len(features) == 1
        codes = set(zip(*[layout.bins(f)[1].tolist() for f in features]))
        assert codes == set(product(*[range(sizes[f]) for f in features]))


def test_model_follows_the_trees_in_few_jobs(spark, tmp_path):
    prepared = training.prepared_snapshot(snapshot(spark, 600))
    context = spark.sparkContext
    context.setJobGroup("boosted", "boosted")
    model = training.fit_family(prepared, "boosted_trees", {"n_estimators": 30, "min_samples_leaf": 5})
    jobs = len(context.statusTracker().getJobIdsForGroup("boosted"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 30  # a job for each level of each tree would be 150
    fitted = model.stages[-1]
    assert fitted.getNumTrees == 30 and fitted.getMaxDepth() == 5 and fitted.getLabelCol() == TARGET
    held = prepared.table.filter(F.col("split") == "test")
    first = {r.order_id: r.probability for r in training.predicted(model, held, prepared.fill).collect()}
    training.save_model(spark, model, prepared.fill, str(tmp_path / "m"))
    again, fill = training.load_model(spark, str(tmp_path / "m"))
    assert {r.order_id: r.probability for r in training.predicted(again, held, fill).collect()} == first
    label = {r.order_id: r[TARGET] for r in held.collect()}
    assert sum((first[k] > 0.5) == bool(label[k]) for k in label) >= 0.95 * len(label)
    assert all(0 < p < 1 and math.isfinite(p) for p in first.values())


def test_wide_trees_go_to_sparks_learner(spark, monkeypatch):
    monkeypatch.setattr(boosting, "MOST_CELLS", 1)
    model = training.fit_family(training.prepared_snapshot(snapshot(spark, 300)), "boosted_trees", {"n_estimators": 2, "max_depth": 2})
    assert model.stages[-1].getNumTrees == 2


def test_sparks_learners_get_a_part_for_each_core(spark, monkeypatch):
    prepared, seen = training.prepared_snapshot(snapshot(spark, 300)), []
    prepared.table = training.stored(prepared.table.coalesce(1))
    fit = training.RandomForestClassifier.fit
    monkeypatch.setattr(training.RandomForestClassifier, "fit", lambda self, df, *rest: seen.append(df.rdd.getNumPartitions()) or fit(self, df, *rest))
    training.fit_family(prepared, "random_forest", {"n_estimators": 2, "max_depth": 3})
    assert prepared.table.rdd.getNumPartitions() == 1 < spark.sparkContext.defaultParallelism == seen[0]
