"""Model packages: a trained model with its record and support tables, registered, imported from elsewhere, and put
into production."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlight.contract import FEATURE_SCHEMA_VERSION, TARGET
from orderlight.operators.curves import prediction_summary
from orderlight.operators.latest import latest_per_key
from orderlight.operators.selection import current_status
from orderlight.plans.training import (
    SUPPORT_TABLES, SuiteResult, load_model, predicted, prepared_snapshot, save_model, support_tables, write_support_tables,
)
from orderlight.sources.workspace import Workspace

PREDICTIONS = f"order_id STRING, {TARGET} INT, probability DOUBLE"


def package_model(result: SuiteResult, model_id: str, path: str) -> str:
    """Writes a model's pipeline, fill values, support tables and record. The record comes last: a package without one
    is unfinished and can't be registered."""
    record = result.records.filter(F.col("model_id") == model_id)
    if record.isEmpty():
        raise LookupError(f"No model {model_id} in the suite")
    save_model(record.sparkSession, result.models[model_id], result.prepared.fill, path)
    write_support_tables(result, model_id, f"{path}/support")
    rates = {s["split"]: s["cancellation_rate"] for s in result.prepared.stats}
    record.withColumn("split_rates", F.lit(json.dumps(rates))).coalesce(1).write.mode("errorifexists").parquet(f"{path}/record")
    return path


def _read(spark: SparkSession, path: str, what: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{path}/{what}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"Model package {path} lacks its {what}") from e


def checked_record(spark: SparkSession, path: str) -> dict:
    """The record of a package that is whole and made for this release's features."""
    _read(spark, path, "fill")
    record = _read(spark, path, "record").first().asDict()
    if not record.get("model_id"):
        raise ValueError(f"Model package {path} names no model")
    if record.get("feature_schema_version") != FEATURE_SCHEMA_VERSION:
        raise ValueError(f"Model {record['model_id']} was made for feature schema {record.get('feature_schema_version')}")
    load_model(spark, path)
    return record


def register(ws: Workspace, path: str, at: datetime, source: str) -> dict:
    """Enter a package into the registry; one with a known id replaces the earlier package. Changes no status."""
    record = checked_record(ws.spark, path)
    ws.append("model_records", [(
        record["model_id"], at, source, path, record["dataset_version"], record["threshold"], json.dumps(record, default=str))])
    ws.append("model_events", [(record["model_id"], "REGISTER", at, source)])
    return record


def import_candidate(ws: Workspace, path: str, at: datetime) -> dict:
    """Register a package that was trained elsewhere and make it the candidate; production stays."""
    record = register(ws, path, at, "import")
    ws.append("model_events", [(record["model_id"], "CANDIDATE", at, "import")])
    return record


def keep_suite(ws: Workspace, result: SuiteResult, at: datetime, source: str) -> list[str]:
    """Package and register every model of a suite. Returns their ids."""
    ids = [r["model_id"] for r in result.records.select("model_id").collect()]
    for model_id in ids:
        register(ws, package_model(result, model_id, ws.path("models", f"{model_id}-{uuid.uuid4().hex}")), at, source)
    return ids


def model_records(ws: Workspace) -> DataFrame:
    """Newest package per model."""
    return latest_per_key(ws.ledger("model_records"), ["model_id"], "at", "path")


def _whole(spark: SparkSession, path: str) -> bool:
    try:
        for name in SUPPORT_TABLES:
            spark.read.text(f"{path}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def promote(ws: Workspace, model_id: str, at: datetime, snapshot: DataFrame | None = None) -> DataFrame:
    """Put a registered model into production; the previous one and the candidate step back.

    Its support tables become those of production. A package without them gets new ones: the model scores the test part
    of ``snapshot``, or of the active version. The promotion event publishes both, so a run that dies before it changes nothing.
    """
    spark = ws.spark
    known = model_records(ws).filter(F.col("model_id") == model_id).first()
    if known is None:
        raise LookupError(f"No package of model {model_id} is registered")
    record = checked_record(spark, known["path"])
    rates, path = json.loads(record["split_rates"]), f"{known['path']}/support"
    rebuilt = not _whole(spark, path)
    if rebuilt:
        source = ws.snapshot() if snapshot is None else snapshot
        if source is None:
            raise ValueError(f"Model {model_id} has no support tables, and there is no version to make them from")
        model, fill = load_model(spark, known["path"])
        prepared = prepared_snapshot(source)
        rates = {s["split"]: s["cancellation_rate"] for s in prepared.stats}
        path = ws.path("support", f"{model_id}-{uuid.uuid4().hex}")
        test = prepared.table.filter(F.col("split") == "test")
        support_tables(prepared.table, predicted(model, test, fill), path)
    predictions = spark.read.schema(PREDICTIONS).option("header", True).csv(f"{path}/test_predictions")
    figures = prediction_summary(predictions, "probability").first()
    ws.append("production_support", [(
        model_id, at, path, rebuilt, *figures, *[rates.get(s) for s in ("train", "validation", "test")])])
    ws.append("model_events", [(model_id, "PROMOTE", at, "approved")])
    return current_status(ws.ledger("model_events"))


def production_support(ws: Workspace) -> DataFrame:
    """Where the production model's support tables lie, and what they say: one row, none before the first promotion."""
    live = current_status(ws.ledger("model_events")).filter("status = 'PRODUCTION'").select("model_id")
    newest = latest_per_key(ws.ledger("production_support"), ["model_id"], "promoted_at", "path")
    return newest.join(F.broadcast(live), "model_id")
