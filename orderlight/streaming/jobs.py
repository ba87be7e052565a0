"""Structured Streaming jobs: batch-file ingestion, scoring, order lifecycle, risk trend."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderlight.functions.labels import is_production, scoring_mode
from orderlight.operators.decisions import order_lifecycle
from orderlight.operators.latest import latest_per_key
from orderlight.plans.ingest import ingest_items
from orderlight.plans.scoring import prediction_rows, scored_orders
from orderlight.session import stored
from orderlight.sources.workspace import Workspace


def start_ingest(
    items: DataFrame, ws: Workspace, checkpoint: str, at: Callable[[int], datetime], name: str = "stream",
) -> StreamingQuery:
    """Each micro-batch of item rows is one upload. Its key holds the query name and the
    micro-batch number, so a replay after a failure finds the batch in the ledger."""

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        key = f"{name}-{number}"
        frozen = stored(batch, "micro")
        ingest_items(ws, frozen, f"batch_{key}", key, key, at(number), resume=True)

    return (
        items.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def start_scoring(
    features: DataFrame, scorer, path: str, checkpoint: str, threshold: float, at: str,
    model_name: str, model_version: str, mode: str = "api",
) -> StreamingQuery:
    """Stateless scoring of arriving orders into an append-only prediction table."""
    rows = prediction_rows(
        scored_orders(features, scorer, threshold), threshold, at, model_name, model_version, mode=mode)
    return (
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def start_decisions(decisions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append arriving decisions, reduced to the newest per prediction inside each
    micro-batch. The batch number is part of the path, so a replay overwrites itself."""

    def run(batch: DataFrame, number: int) -> None:
        latest_per_key(batch, ["prediction_id"], "decided_at", "decision_id").write.mode("overwrite").parquet(
            f"{path}/micro={number}")

    return (
        decisions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def lifecycle_view(predictions: DataFrame, decision_log: DataFrame) -> DataFrame:
    """Current order states from the stored predictions and streamed decisions."""
    return order_lifecycle(predictions, decision_log)


def risk_trend_parts(batch: DataFrame, every: str = "1 day") -> DataFrame:
    """Counts and sums per window of one micro-batch of production traffic."""
    return (
        batch.filter(is_production(scoring_mode(F.col("scoring_mode"))))
        .groupBy(F.window("predicted_at", every).alias("w"))
        .agg(F.count("*").alias("predictions"), F.count("probability").alias("scored"), F.sum("probability").alias("risk"))
        .select(F.col("w.start").alias("window_start"), "predictions", "scored", "risk")
    )


def start_risk_trend(predictions: DataFrame, path: str, checkpoint: str, every: str = "1 day") -> StreamingQuery:
    """Every micro-batch writes what it adds to its windows. No watermark: a prediction counts
    however late it arrives. The batch number is part of the path, so a replay overwrites itself."""

    def run(batch: DataFrame, number: int) -> None:
        risk_trend_parts(batch, every).write.mode("overwrite").parquet(f"{path}/micro={number}")

    return (
        predictions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def current_trend(stored_windows: DataFrame) -> DataFrame:
    """Windows with the parts of all micro-batches added up."""
    return stored_windows.groupBy("window_start").agg(
        F.sum("predictions").alias("predictions"),
        F.try_divide(F.sum("risk"), F.sum("scored")).alias("average_risk"),
    )
