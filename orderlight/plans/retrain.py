"""Retraining jobs: request -> training snapshot -> suite -> candidate. Production is changed
only by an explicit promotion."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlight.operators.retraining import normalized_settings, request_status
from orderlight.operators.sampling import time_spanning_sample
from orderlight.operators.selection import current_status
from orderlight.plans.registry import keep_suite
from orderlight.plans.training import SuiteResult, train_suite
from orderlight.session import stored
from orderlight.sources.workspace import Workspace


def training_snapshot(snapshot: DataFrame, settings: dict | None = None) -> DataFrame:
    """Full snapshot, or the time-spanning sample in quick mode."""
    s = normalized_settings(settings)
    if s["training_scope"] == "quick_sample":
        return time_spanning_sample(snapshot, s["max_training_rows"])
    return snapshot


def _row(request: dict, status: str, at: datetime, **metadata) -> tuple:
    return (
        request["request_id"], request["model_version"], request["dataset_version"], request["trigger_type"],
        request.get("source", "modelops"), status, request.get("signals_json"),
        json.dumps(metadata, default=str), at,
    )


def _state(ws: Workspace, request: dict, status: str, at: datetime, **metadata) -> None:
    ws.append("retraining_requests", [_row(request, status, at, **metadata)])


def current_requests(ws: Workspace) -> DataFrame:
    return request_status(ws.ledger("retraining_requests"))


def create_request(
    ws: Workspace, model_version: str, dataset_version: str, trigger_type: str, at: datetime,
    signals: dict | None = None, source: str = "monitoring", force_new: bool = False,
) -> dict:
    """New request, or the newest open one with the same model, dataset and trigger."""
    from orderlight.operators.retraining import open_requests

    if not force_new:
        found = open_requests(current_requests(ws)).filter(
            (F.col("model_version") == model_version) & (F.col("dataset_version") == dataset_version)
            & (F.col("trigger_type") == trigger_type)).first()
        if found:
            return found.asDict()
    number = current_requests(ws).count()
    while True:
        request = {
            "request_id": f"retrain_{dataset_version}_{number:04d}", "model_version": model_version,
            "dataset_version": dataset_version, "trigger_type": trigger_type, "source": source,
            "signals_json": json.dumps(signals or {}, default=str), "status": "RETRAINING_REQUIRED",
        }
        # The id is one commit: a number that another writer took is passed over.
        if ws.commit("retraining_requests", request["request_id"], _row(request, "RETRAINING_REQUIRED", at)):
            return request
        number += 1


def run_retraining(
    ws: Workspace, request: dict, at: datetime, done_at: datetime, settings: dict | None = None,
    overrides: dict | None = None, families: list[str] | None = None, gates: dict | None = None,
) -> tuple[dict, SuiteResult]:
    """Run one request. All models are packaged and registered, the best qualified one becomes the candidate;
    production stays."""
    s = normalized_settings(settings)
    _state(ws, request, "RUNNING", at, training_scope=s["training_scope"])
    try:
        version = request["dataset_version"]
        source = ws.snapshot(version)
        data = training_snapshot(source, s)
        if s["training_scope"] == "quick_sample":
            data = stored(data, "sample")
        result = train_suite(
            data, version, families, overrides, gates=gates,
            stamp=request["request_id"], training_scope=s["training_scope"])
        ids = keep_suite(ws, result, at, request["request_id"])
        if result.candidate_id:
            ws.append("model_events", [(result.candidate_id, "CANDIDATE", done_at, request["request_id"])])
        status = "CANDIDATE_READY" if result.candidate_id else "COMPLETED_NO_CANDIDATE"
        summary = {
            "candidate_model_id": result.candidate_id, "model_count": len(ids),
            "source_rows": source.count(), "training_rows": data.count(), "training_scope": s["training_scope"],
        }
        _state(ws, request, status, done_at, **summary)
        ws.log_event(
            f"retrain_done_{request['request_id']}", done_at, "MODEL_RETRAINING",
            "SUCCESS" if result.candidate_id else "WARNING", f"Retraining completed for {version}")
        return {**request, "status": status, **summary}, result
    except Exception as error:
        _state(ws, request, "FAILED", done_at, error=str(error))
        ws.log_event(f"retrain_failed_{request['request_id']}", done_at, "MODEL_RETRAINING", "FAILED", str(error))
        raise


def run_if_automatic(
    ws: Workspace, request: dict, at: datetime, done_at: datetime, settings: dict | None = None, **options,
) -> dict:
    """Run a waiting request, unless automatic retraining is switched off. Returns the request as it stands."""
    waiting = request["status"] == "RETRAINING_REQUIRED"
    if not waiting or not normalized_settings(settings)["automatic_retraining_enabled"]:
        return request
    return run_retraining(ws, request, at, done_at, settings, **options)[0]


def retrain_on_signals(
    ws: Workspace, evaluated: DataFrame, dataset_version: str, at: datetime, done_at: datetime,
    settings: dict | None = None, **options,
) -> list[dict]:
    """From signals to runs: one request per triggered row of ``evaluated_policy`` (an open request
    is used again), each then run if retraining is automatic. One row per model reaches the driver."""
    triggered = evaluated.filter("triggered").select("model_version", "trigger_type").orderBy("model_version").collect()
    requests = [create_request(ws, r["model_version"], dataset_version, r["trigger_type"], at) for r in triggered]
    return [run_if_automatic(ws, r, at, done_at, settings, **options) for r in requests]


def manual_request(ws: Workspace, dataset_version: str, at: datetime) -> dict:
    """A new request for the model in production, whatever requests are open."""
    live = current_status(ws.ledger("model_events")).filter("status = 'PRODUCTION'").first()
    return create_request(
        ws, live["model_id"] if live else "unknown", dataset_version, "MANUAL_RETRAIN", at,
        source="modelops", force_new=True)


def final_benchmark(snapshot: DataFrame, dataset_version: str, **options) -> tuple[DataFrame, dict]:
    """Full-data comparison that changes no lifecycle state, with its contract flags."""
    result = train_suite(snapshot, dataset_version, stamp="benchmark", **options)
    same = result.records.agg(
        (F.count_distinct("dataset_version") == 1).alias("same_dataset_version"),
        (F.count_distinct("dataset_fingerprint") == 1).alias("same_dataset_fingerprint"),
        (F.count_distinct("split_id") == 1).alias("same_temporal_split"),
        (F.count_distinct("feature_schema_version") == 1).alias("same_feature_schema"),
        (F.count_distinct("business_policy") == 1).alias("same_business_policy"),
    ).first().asDict()
    return result.records, {
        **same,
        "candidate_selection_uses": "validation_only",
        "test_holdout_use": "final_unbiased_evaluation_only",
    }
