from datetime import datetime

from pyspark.sql import functions as F

from orderlight.functions.economics import economics
from orderlight.functions.features import inference_features
from orderlight.functions.labels import risk_level
from orderlight.operators import explain, sampling, validation
from orderlight.operators.monitoring import apply_outcomes
from orderlight.sources.items import read_items
from orderlight.streaming.jobs import current_trend, start_risk_trend


def test_nan_probability_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.9,)], "p double")
    got = df.select(risk_level(F.col("p"), F.lit(0.5)).alias("level"), *[c.alias(n) for n, c in economics(F.col("p")).items()]).collect()
    assert got[0] == got[1] and got[0].net_expected_savings is None and got[0].level == "LOW" and got[2].level == "HIGH"


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text('item_id,note\n1,"a\nb"\n2,c\n')
    assert sorted(r.note for r in read_items(spark, str(path), line_breaks=True).collect()) == ["a\nb", "c"]


def test_equal_times_have_one_outcome(spark):
    predictions = spark.createDataFrame([("1", None)], "order_id string, actual_outcome string")
    at = datetime(2024, 1, 1)
    rows = [("1", "canceled", at), ("1", "complete", at)]
    found = {apply_outcomes(predictions, spark.createDataFrame(r, "order_id string, final_outcome string, t timestamp"), "t").first().actual_outcome for r in (rows, rows[::-1])}
    assert len(found) == 1 and found != {None}


def test_late_predictions_are_counted(spark, tmp_path):
    schema = "scoring_mode string, predicted_at timestamp, probability double"
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for k, (day, p) in enumerate([(20, 0.5), (1, 0.25), (20, 1.0), (1, None)]):
        spark.createDataFrame([("api", datetime(2024, 1, day), p)], schema).write.mode("append").parquet(source)
        start_risk_trend(spark.readStream.schema(schema).parquet(source), out, mark).awaitTermination()
    got = {r.window_start.day: (r.predictions, r.average_risk) for r in current_trend(spark.read.parquet(out)).collect()}
    assert got == {1: (2, 0.25), 20: (2, 0.75)}


def test_generated_ids_are_whole_hashes():
    import inspect

    assert "substring" not in inspect.getsource(inference_features)


def test_split_of_times_beyond_double_precision(spark):
    from orderlight.operators.sampling import temporal_split

    far = spark.range(1000).select(
        F.format_string("o%04d", "id").alias("order_id"),
        F.timestamp_micros(F.lit(253402300799123457) - (F.col("id") % 3)).alias("created_at"))
    got = temporal_split(far)
    want = sorted(((-(i % 3), f"o{i:04d}") for i in range(1000)))
    parts = {k: "train" if n < 700 else "validation" if n < 850 else "test" for n, (_, k) in enumerate(want)}
    assert {r.order_id: r.split for r in got.select("order_id", "split").collect()} == parts


def test_a_broken_upload_may_come_again(spark, workspace, tmp_path, monkeypatch):
    import pytest

    from orderlight.plans import ingest
    from tests.test_ingest import FIRST, upload

    path, at = upload(tmp_path, "a.csv", FIRST), datetime(2024, 1, 1)
    whole = ingest.aggregate_to_orders

    def lost(_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(ingest, "aggregate_to_orders", lost)
    with pytest.raises(RuntimeError):
        ingest.ingest_file(workspace, path, at)
    monkeypatch.setattr(ingest, "aggregate_to_orders", whole)
    assert [(r.status, r.notes) for r in workspace.batches().collect()] == [("FAILED", "executor lost")]
    again = ingest.ingest_file(workspace, path, at)
    assert again["status"] == "success" and again["snapshot_orders"] == 2
    assert sorted(r.status for r in workspace.batches().collect()) == ["FAILED", "SUCCESS"]


def test_a_dead_run_holds_its_upload_until_resumed(spark, workspace):
    from orderlight.plans import ingest

    at = datetime(2024, 1, 1)
    first, _ = ingest.reserve(workspace, "a.csv", "k", at)
    none, known = ingest.reserve(workspace, "b.csv", "k", at)
    assert none is None and known["status"] == "PROCESSING" and known["batch_id"] == first.batch_id
    second, _ = ingest.reserve(workspace, "a.csv", "k", at, resume=True)
    assert second.batch_id != first.batch_id
    # The second run published its version, then died: resuming closes it instead of starting anew.
    workspace.append("dataset_versions", [("v001", at, second.batch_id, 1, 1, "", "", "", False)])
    none, known = ingest.reserve(workspace, "a.csv", "k", at, resume=True)
    assert none is None and (known["status"], known["dataset_version"]) == ("SUCCESS", "v001")


def test_unpublished_versions_are_written_over_and_published_ones_are_not(spark, workspace):
    import pytest

    from orderlight.operators.validation import REPORT_SCHEMA
    from orderlight.sources.schemas import SNAPSHOT

    empty = spark.createDataFrame([], SNAPSHOT)
    args = ("v001", empty, spark.createDataFrame([], "quarantine_reason STRING"), spark.createDataFrame([], REPORT_SCHEMA), "b", datetime(2024, 1, 1))
    spark.range(3).write.parquet(workspace.path("snapshots", "dataset_version=v001"))
    assert workspace.write_version(*args)["row_count"] == 0
    with pytest.raises(ValueError):
        workspace.write_version(*args)


def test_settings_decide_about_automatic_runs(spark, workspace):
    from orderlight.plans import retrain

    at = datetime(2024, 1, 1)
    signals = spark.createDataFrame(
        [("m1", "SUSTAINED_DATA_DRIFT", True), ("m2", None, False)], "model_version string, trigger_type string, triggered boolean")
    off = {"automatic_retraining_enabled": False}
    first = retrain.retrain_on_signals(workspace, signals, "v001", at, at, off)
    assert [(r["model_version"], r["status"]) for r in first] == [("m1", "RETRAINING_REQUIRED")]
    again = retrain.retrain_on_signals(workspace, signals, "v001", at, at, off)
    assert [r["request_id"] for r in again] == [r["request_id"] for r in first]
    assert retrain.manual_request(workspace, "v001", at)["model_version"] == "unknown"
    assert retrain.current_requests(workspace).count() == 2


def test_saved_models_score_alike(spark, tmp_path):
    import pytest

    from orderlight.plans import training
    from tests.test_models import snapshot

    prepared = training.prepared_snapshot(snapshot(spark, 300))
    model = training.fit_family(prepared, "logistic_regression", {"max_iter": 20})
    path = str(tmp_path / "m")
    training.save_model(spark, model, prepared.fill, path)
    loaded = training.scorer(*training.load_model(spark, path))
    gaps = prepared.table.withColumn("price", F.when(F.col("hour") % 2 == 0, F.col("price")))
    old = {r.order_id: r.probability for r in training.predicted(model, gaps, prepared.fill).collect()}
    assert {r.order_id: r.probability for r in loaded(gaps).collect()} == old
    training.save_model(spark, model, {"price": 1.0}, path)
    with pytest.raises(ValueError):
        training.load_model(spark, path)


def test_large_samples_are_the_first_by_hash(spark, monkeypatch):
    df = spark.range(500).selectExpr("cast(id as string) as k")
    small = {r.k for r in sampling.first_by_hash(df, "k", 120).collect()}
    monkeypatch.setattr(sampling, "TOP_ROWS", 10)
    large = sampling.first_by_hash(df, "k", 120)
    assert {r.k for r in large.collect()} == small
    assert large.columns == ["k"]
    assert "TakeOrderedAndProject" not in large._jdf.queryExecution().executedPlan().toString()


def test_known_orders_leave_the_history_in_place(spark):
    batch = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "increment_id string")
    history = spark.createDataFrame([("b",), ("c",), (None,)], "order_id string")
    out = validation.existing_orders(batch, "increment_id", history)
    assert [r.order_id for r in out.collect()] == ["b"]
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()


def test_domains_are_the_texts_that_occur(spark):
    rows = spark.createDataFrame([("x", "p"), ("x", None), (None, "q")], "category_name_1 string, payment_method string")
    found = sorted((r.feature, r.value) for r in explain.feature_domains(rows).collect())
    assert found == [("category_name_1", "x"), ("payment_method", "p"), ("payment_method", "q")]
    assert explain.feature_domains(rows.limit(0)).count() == 0
