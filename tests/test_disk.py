"""What a job leaves on disk while it runs."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from orderlight.plans.ingest import ingest_items
from orderlight.session import scratch_root, stored
from orderlight.sources.items import generated_items, with_order


def shuffled(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    table = spark.range(20_000).withColumn("k", F.pmod("id", F.lit(97)))
    stored(spark.range(1))
    before = shuffled(spark)
    out = stored(table.join(table.groupBy("k").count().hint("merge"), "k").repartition(3, "id"))
    assert out.count() == 20_000
    assert not shuffled(spark) - before


def test_a_stored_batch_is_not_written_again(spark, workspace):
    folders = lambda: {n for n in os.listdir(scratch_root(spark).removeprefix("file:")) if n.startswith("items-")}
    rows = stored(with_order(generated_items(spark, 200)), "batch")
    before = folders()
    done = ingest_items(workspace, rows, "b1", "first.csv", "k1", datetime(2024, 1, 1), prepared=True)
    assert done["status"] == "success" and folders() == before
    ingest_items(workspace, rows.filter("false"), "b2", "second.csv", "k2", datetime(2024, 1, 2))
    assert len(folders() - before) == 1


def test_a_stored_snapshot_is_not_written_again(spark, workspace):
    from orderlight.operators.validation import REPORT_SCHEMA
    from tests.test_models import snapshot

    folders = lambda: {n for n in os.listdir(scratch_root(spark).removeprefix("file:")) if n.startswith("snapshot-")}
    orders, before = stored(snapshot(spark, 100)), folders()
    rejected, report = spark.createDataFrame([], "quarantine_reason STRING"), spark.createDataFrame([], REPORT_SCHEMA)
    size = workspace.write_version("v1", orders, rejected, report, "b", datetime(2024, 1, 1), prepared=True)
    assert folders() == before and size["row_count"] == orders.count() == workspace.snapshot("v1").count()
