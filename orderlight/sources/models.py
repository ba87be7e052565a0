"""Model registries and benchmark summaries stored as nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlight.sources.schemas import SUITE_SUMMARY

# Metrics shown per split in the benchmark table.
VALIDATION_METRICS = ["roc_auc", "pr_auc", "brier", "recall_at_90_precision"]
TEST_METRICS = ["roc_auc", "pr_auc", "brier", "f1", "precision", "recall", "recall_at_90_precision"]


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUITE_SUMMARY).option("multiLine", True).json(path)


def parse_summaries(df: DataFrame, column: str) -> DataFrame:
    """Summaries held as text, one JSON object per row."""
    return df.select(F.from_json(F.col(column), SUITE_SUMMARY).alias("s")).select("s.*")


def model_records(summaries: DataFrame) -> DataFrame:
    return summaries.select("candidate_model_id", "production_model_id", F.explode("models").alias("m"))


def benchmark_rows(summaries: DataFrame) -> DataFrame:
    """One flat row per model of a suite summary."""
    test_value = F.coalesce(
        F.col("m.test_business_metrics.net_savings_per_1000_orders"),
        F.col("m.business_metrics.net_savings_per_1000_orders"),
    )
    return model_records(summaries).select(
        F.col("m.model_id").alias("model_id"),
        F.col("m.display_name").alias("model"),
        F.col("m.model_family").alias("model_family"),
        F.coalesce(F.col("m.qualification.passed"), F.lit(False)).alias("qualified_on_validation"),
        F.coalesce(F.col("m.model_id") == F.col("candidate_model_id"), F.lit(False)).alias("selected_candidate"),
        *[F.col(f"m.val_metrics.{k}").alias(f"validation_{k}") for k in VALIDATION_METRICS],
        F.col("m.val_business_metrics.net_savings_per_1000_orders").alias("validation_net_savings_per_1000_orders"),
        *[F.col(f"m.test_metrics.{k}").alias(f"test_{k}") for k in TEST_METRICS],
        test_value.alias("test_net_savings_per_1000_orders"),
        F.col("m.training_device").alias("training_device"),
        F.col("m.duration_seconds").alias("duration_seconds"),
    )


def registry_runs(summaries: DataFrame) -> DataFrame:
    """Registered runs as shown in the experiment list."""
    return model_records(summaries).select(
        F.coalesce(F.col("m.run_name"), F.col("m.model_id")).alias("run_name"),
        F.col("m.display_name").alias("model"),
        F.coalesce(F.col("m.run_role"), F.lit("suite / packaged")).alias("role"),
        F.coalesce(F.col("m.status"), F.lit("READY")).alias("status"),
        F.col("m.dataset_version").alias("dataset"),
        F.col("m.training_scope").alias("scope"),
        F.col("m.training_device").alias("device"),
        *[F.col(f"m.test_metrics.{k}").alias(k) for k in VALIDATION_METRICS],
        F.col("m.trained_at").alias("trained"),
    )
