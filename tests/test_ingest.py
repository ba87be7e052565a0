"""Whole ingestion runs, features of a batch to score, and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orderlight.functions import features
from orderlight.plans import ingest, scoring
from orderlight.sources.workspace import read_snapshot
from orderlight.streaming import jobs
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
HEADER = "increment_id,Customer ID,created_at,price,qty_ordered,grand_total,discount_amount,payment_method,category_name_1,status\n"
FIRST = HEADER + """o1,c1,2024-01-01 08:00:00,10,1,10,0,cod,A,complete
o1,c1,2024-01-01 08:00:00,10,1,10,0,cod,A,complete
o1,c1,2024-01-01 08:00:00,20,2,50,5,cod,B,complete
o2,c1,2024-01-02,10,1,10,0,Payaxis,A,canceled
o3,,2024-01-02,10,0,10,0,Payaxis,A,canceled
o4,c2,2024-01-03,10,1,10,0,Payaxis,A,canceled
o4,c2,2024-01-03,11,1,10,0,Payaxis,A,complete
,,,,,,,,,
"""
SECOND = HEADER + """o2,c1,2024-01-02,10,1,10,0,Payaxis,A,complete
o5,c1,01/05/2024,10,1,10,0,cod,A,complete
o6,,2024-01-06,7,1,7,0,,A,canceled
"""


def upload(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_batches_build_versions(spark, workspace, tmp_path):
    first = ingest.ingest_file(workspace, upload(tmp_path, "a.csv", FIRST), T0)
    assert first["status"] == "success" and first["dataset_version"].startswith("v001_")
    assert (first["raw_rows"], first["valid_rows"], first["quarantined_rows"], first["snapshot_orders"]) == (7, 3, 4, 2)
    reasons = spark.read.option("header", True).csv(first["quarantine_path"])
    assert sorted(rows(reasons, "increment_id", "quarantine_reason")) == [
        ("o1", "duplicate_row;"), ("o3", "invalid_qty_ordered;"), ("o4", "inconsistent_order_status;"), ("o4", "inconsistent_order_status;")]
    report = {r["check_name"]: (r["status"], r["affected_rows"]) for r in spark.read.json(first["report_path"]).collect()}
    assert report["order_status_consistency"] == ("WARN", 1) and report["existing_order_duplicates"] == ("PASS", 0)

    again = ingest.ingest_file(workspace, upload(tmp_path, "copy.csv", FIRST), T0 + timedelta(hours=1))
    assert again["status"] == "duplicate" and again["dataset_version"] == first["dataset_version"]

    second = ingest.ingest_file(workspace, upload(tmp_path, "b.csv", SECOND), T0 + timedelta(hours=2))
    assert second["status"] == "success" and second["snapshot_orders"] == 4
    got = sorted(rows(workspace.snapshot(), "order_id", "customer_id", "prev_orders", "prev_cancellations", "status"))
    assert got == [("o1", "c1", 0, 0, "complete"), ("o2", "c1", 1, 0, "canceled"), ("o5", "c1", 2, 1, "complete"), ("o6", None, 0, 0, "canceled")]
    assert workspace.active_version()["dataset_version"] == second["dataset_version"]
    # The first version is still readable and unchanged.
    assert sorted(rows(workspace.snapshot(first["dataset_version"]), "order_id")) == [("o1",), ("o2",)]

    nothing = ingest.ingest_file(workspace, upload(tmp_path, "c.csv", SECOND + "\n"), T0 + timedelta(hours=3))
    assert nothing["status"] == "duplicate" and nothing["dataset_version"] is None
    states = {r["filename"]: r["status"] for r in workspace.batches().collect()}
    assert states == {"a.csv": "SUCCESS", "b.csv": "SUCCESS", "c.csv": "NO_NEW_DATA"}
    assert workspace.events().count() == 3


def test_failed_batch_may_come_again(workspace, tmp_path):
    path = upload(tmp_path, "bad.csv", "increment_id,price\n1,2\n")
    first = ingest.ingest_file(workspace, path, T0)
    again = ingest.ingest_file(workspace, path, T0 + timedelta(hours=1))
    assert first["status"] == again["status"] == "failed"
    assert first["batch_id"] != again["batch_id"]
    assert {r["quarantined_rows"] for r in workspace.batches().collect()} == {1}


def test_demo_versions_stay_isolated(workspace, tmp_path):
    path = upload(tmp_path, "a.csv", FIRST)
    full = ingest.ingest_file(workspace, path, T0)
    demo = ingest.ingest_file(workspace, path, T0 + timedelta(hours=1), run_mode="demo", sample_orders=1)
    # The hash covers the mode, so the same file is another batch; it never becomes active.
    assert demo["status"] in ("success", "duplicate") and demo["batch_id"] != full["batch_id"]
    assert workspace.active_version()["dataset_version"] == full["dataset_version"]


def test_seed_is_registered_once(spark, workspace, tmp_path):
    path = str(tmp_path / "seed.parquet")
    first = ingest.ingest_file(workspace, upload(tmp_path, "a.csv", FIRST), T0 - timedelta(days=1))
    workspace.snapshot(first["dataset_version"]).write.parquet(path)
    assert ingest.register_seed(workspace, path, "seed_v1", T0)
    assert not ingest.register_seed(workspace, path, "seed_v1", T0 + timedelta(days=1))
    assert workspace.active_version()["dataset_version"] == "seed_v1"


def test_snapshots_by_suffix(spark, tmp_path):
    (tmp_path / "s.csv").write_text("order_id,created_at,price,extra\n007,2024-01-02,1.5,x\n008,bad,y,z\n")
    df = read_snapshot(spark, str(tmp_path / "s.csv"), ["order_id", "created_at", "price"])
    assert [tuple(r) for r in df.collect()] == [("007", datetime(2024, 1, 2), 1.5), ("008", None, None)]
    with pytest.raises(ValueError):
        read_snapshot(spark, "orders.pkl")


def test_inference_features(spark):
    df = spark.createDataFrame(
        [("10", "1", "20", "5", "COD", None, "7"), ("10", "1", "-20", "0", None, "A", "x")],
        "price STRING, qty_ordered STRING, grand_total STRING, discount_amount STRING, payment_method STRING, category_name_1 STRING, customer_cancel_rate STRING")
    out = features.inference_features(df, "2024-01-06 09:30:00").collect()
    assert [(r["is_cod"], r["customer_cancel_rate"], r["category_name_1"], r["payment_method"], r["day_of_week"], r["hour"]) for r in out] == [
        (1, 1.0, "unknown", "COD", 5, 9), (0, 0.0, "A", "unknown", 5, 9)]
    assert len({r["order_id"] for r in out}) == 2 and all(r["order_id"].startswith("manual_") for r in out)
    with pytest.raises(ValueError):
        features.inference_features(df.withColumn("price", F.lit("abc")), "2024-01-01")
    with pytest.raises(ValueError):
        features.inference_features(df.drop("price"), "2024-01-01")


def test_contract_guard():
    with pytest.raises(ValueError):
        features.check_feature_contract(["price"])
    with pytest.raises(ValueError):
        features.check_feature_contract(["price", "status"], ["price", "status"])


def test_scored_batch_is_logged_once(spark, workspace):
    orders = spark.createDataFrame([("1", 10.0, 1.0, 400000.0, 0.0, "cod", "A", 0.5)],
                                   "order_id STRING, price DOUBLE, qty_ordered DOUBLE, grand_total DOUBLE, discount_amount DOUBLE, payment_method STRING, category_name_1 STRING, customer_cancel_rate DOUBLE")
    ready = features.inference_features(orders, "2024-01-01")
    for _ in range(2):
        scoring.score_and_log(workspace, ready, scoring.by_expression(scoring.softsign_score), 0.41, T0, "scorecard", "m1")
    log = workspace.predictions().collect()
    assert len(log) == 1 and log[0]["scoring_mode"] == "batch" and '"category_name_1":"A"' in log[0]["feature_json"]
    assert features.read_payload(workspace.predictions()).first()["grand_total"] == 400000.0


def test_streamed_files_become_batches_and_replays_do_not(spark, workspace, tmp_path):
    source, checkpoint = tmp_path / "drop", str(tmp_path / "cp")
    source.mkdir()
    (source / "a.csv").write_text(FIRST)
    schema = ", ".join(f"`{c}` STRING" for c in HEADER.strip().split(","))

    def run(folder):
        items = spark.readStream.schema(schema).option("header", True).csv(str(source))
        q = jobs.start_ingest(items, workspace, folder, lambda n: T0 + timedelta(hours=n))
        q.awaitTermination()

    run(checkpoint)
    (source / "b.csv").write_text(SECOND)
    run(checkpoint)
    assert sorted(rows(workspace.snapshot(), "order_id")) == [("o1",), ("o2",), ("o5",), ("o6",)]
    assert workspace.batches().count() == 2
    # Starting over replays batch number 0; the ledger knows it.
    run(str(tmp_path / "cp2"))
    assert workspace.batches().count() == 2


def test_generated_batch_passes_the_checks(spark):
    from orderlight.operators.validation import check_items
    from orderlight.sources.items import generated_items, with_order

    df = generated_items(spark, 2000)
    assert rows(df, "increment_id", "grand_total") == rows(generated_items(spark, 2000), "increment_id", "grand_total")
    out = check_items(with_order(df))
    assert out.counts["valid_rows"] == 2000
    share = {r["payment_method"]: r["count"] / 2000 for r in df.groupBy("payment_method").count().collect()}
    assert abs(share["cod"] - 0.48) < 0.05 and len(share) == 4
    assert df.select("status").distinct().count() == 2
