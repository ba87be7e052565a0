"""Health checks walked in parts, duplicates without a full write, kept quantile sketches."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from orderlight.operators import drift, retraining
from orderlight.operators import validation as v
from orderlight.operators.quantiles import exact_quantiles, merged_sketches, quantile_sketches
from tests.conftest import rows
from tests.test_items import COLUMNS, item

T0 = datetime(2024, 1, 1)
CHECKS = "model_version STRING, checked_at TIMESTAMP, severe_drift BOOLEAN, note BIGINT"


def thinned(data, minutes=30):
    kept = []
    for model in {m for m, _ in data}:
        last = None
        for t in sorted({t for m, t in data if m == model and t is not None}):
            if last is None or t - last >= timedelta(minutes=minutes):
                kept.append((model, t))
                last = t
    return sorted(kept, key=str)


@pytest.mark.parametrize("step", [0.4, 11, 29, 31, 400])
def test_one_hot_model_is_walked_in_parts(spark, step):
    rng = random.Random(int(step * 10))
    data, clock = [], 0.0
    for _ in range(3000):
        clock += rng.random() * 2 * step
        data.append((rng.choice(["hot"] * 8 + ["b", None]), T0 + timedelta(minutes=clock)))
    shuffled = data + data[:50] + [("hot", None), ("only", None)]
    rng.shuffle(shuffled)
    df = spark.createDataFrame([(m, t, None if i % 5 == 0 else i % 2 == 0, i if i % 7 else None) for i, (m, t) in enumerate(shuffled)], CHECKS)
    out = retraining.recorded_checks(df.repartition(6))
    assert out.columns == df.columns
    assert sorted(((r["model_version"], r["checked_at"]) for r in out.collect()), key=str) == thinned(data)


def test_sparse_parts_and_empty_checks(spark):
    # Parts that keep nothing hand on what was kept before them.
    data = [("m", T0 + timedelta(seconds=i)) for i in range(4000)]
    df = spark.createDataFrame([(m, t, True, 1) for m, t in data], CHECKS)
    got = retraining.recorded_checks(df).collect()
    assert sorted((r["model_version"], r["checked_at"]) for r in got) == thinned(data)
    assert retraining.recorded_checks(df.limit(0)).count() == 0


def test_newest_checks_over_all_models_are_kept(spark):
    data = [(f"m{i % 3}", T0 + timedelta(hours=i // 2), True, i) for i in range(600)]
    kept = retraining.kept_history(spark.createDataFrame(data, CHECKS))
    want = sorted(data, key=lambda r: (r[1], r[0]), reverse=True)[: retraining.KEPT_CHECKS]
    assert rows(kept, "note") == [(r[3],) for r in want]


def test_duplicates_are_found_on_both_sides_of_the_bound(spark):
    rng = random.Random(4)
    data = [item(increment_id=f"o{rng.randrange(40)}", price=str(rng.randrange(3))) for _ in range(300)] + [item(status="x", created_at=None)] * 3
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], COLUMNS + ", _ord BIGINT")
    want = {}
    for i, r in enumerate(data):
        n, first = want.get(r, (0, i))
        want[r] = (n + 1, first)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for bound in (0, 500):
        got = v.checked_rows(df, bound).collect()
        assert {tuple(r[c] for c in names): (r["_copies"], r["_ord"]) for r in got} == want
        assert {r[v.REASON] for r in got if r["status"] == "x"} == {"invalid_created_at;invalid_status;"}


def test_single_rows_are_neither_shuffled_nor_written(spark, tmp_path):
    items = [item(increment_id=f"o{i}") for i in range(50)] + [item(), item()]
    spark.createDataFrame(items, COLUMNS).write.parquet(str(tmp_path / "items"))
    plan = v.checked_rows(spark.read.parquet(str(tmp_path / "items")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_kept_sketches_of_parts_give_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(6000) < 0.3, 1.0, rng.lognormal(0, 2, 6000))
    df = spark.createDataFrame([(float(a), None) for a in x] + [(float("nan"), None)], "x DOUBLE, y DOUBLE")
    parts = [quantile_sketches(df.filter(p), ["x", "y"]) for p in ("x < 1", "x = 1", "x > 1")]
    kept = merged_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert {r["feature"]: (r["n"], r["sketch"] is None) for r in kept.collect()} == {"x": (6000, False), "y": (0, True)}
    probs = [0.0, 0.07, 0.2, 0.5, 0.93, 1.0]
    got = exact_quantiles(df, ["x", "y"], probs, 50, kept)
    np.testing.assert_allclose(got["x"], np.quantile(x, probs), rtol=1e-12)
    assert got["y"] is None


def test_drift_against_a_kept_profile_leaves_the_reference_unread(spark, tmp_path):
    rng = random.Random(9)

    def frame(n, shift):
        data = [(rng.random() + shift, rng.choice(["a", "b", None])) for _ in range(n)]
        return spark.createDataFrame(data, "price DOUBLE, payment_method STRING")

    reference, current = frame(300, 0.0), frame(80, 0.4)
    drift.reference_profile(reference).write.parquet(str(tmp_path / "profile"))
    kept = spark.read.parquet(str(tmp_path / "profile"))
    direct = {r["feature"]: tuple(r) for r in drift.feature_drift(reference, current).collect()}
    assert set(direct) == {"price", "payment_method"}
    for r in drift.profile_drift(kept, current).collect():
        assert r["drift_score"] == pytest.approx(direct[r["feature"]][2], abs=1e-12) and r["status"] == direct[r["feature"]][3]
    psi = drift.psi_table(reference, current, ["price"]).first()["psi"]
    assert direct["price"][2] == pytest.approx(psi, abs=1e-12)
    nothing = drift.profile_drift(drift.reference_profile(reference.limit(0)), current).collect()
    assert {(r["feature"], r["drift_score"], r["status"]) for r in nothing} == {
        ("price", None, "INSUFFICIENT DATA"), ("payment_method", None, "INSUFFICIENT DATA")}
