"""Column lists of the stored tables, as DDL."""

# --- Fixed values: ledger and snapshot layouts ---

SNAPSHOT = """
    order_id STRING, created_at TIMESTAMP, customer_id STRING, price DOUBLE, qty_ordered DOUBLE,
    grand_total DOUBLE, discount_amount DOUBLE, is_canceled INT, category_name_1 STRING,
    payment_method STRING, status STRING, discount_ratio DOUBLE, is_cod INT, has_discount INT,
    day_of_week INT, hour INT, prev_orders BIGINT, prev_cancellations BIGINT, customer_cancel_rate DOUBLE
"""

LEDGERS = {
    "data_batches": """
        batch_id STRING, filename STRING, file_hash STRING, uploaded_at TIMESTAMP, raw_rows BIGINT,
        valid_rows BIGINT, quarantined_rows BIGINT, status STRING, dataset_version STRING, notes STRING, step BIGINT
    """,
    "dataset_versions": """
        dataset_version STRING, created_at TIMESTAMP, source_batch_id STRING, row_count BIGINT,
        order_count BIGINT, processed_path STRING, quarantine_path STRING, report_path STRING, sample BOOLEAN
    """,
    "validation_results": """
        batch_id STRING, check_name STRING, status STRING, affected_rows BIGINT, details STRING, checked_at TIMESTAMP
    """,
    "predictions": """
        prediction_id STRING, order_id STRING, predicted_at TIMESTAMP, model_name STRING, model_version STRING,
        dataset_version STRING, probability DOUBLE, threshold DOUBLE, recommendation STRING, actual_outcome STRING,
        expected_avoidable_cost DOUBLE, expected_false_positive_cost DOUBLE, net_expected_savings DOUBLE,
        avoidable_fulfillment_cost DOUBLE, intervention_effectiveness DOUBLE, intervention_cost DOUBLE,
        false_positive_friction_cost DOUBLE, latency_ms DOUBLE, scoring_mode STRING, feature_json STRING
    """,
    "manager_decisions": """
        decision_id STRING, prediction_id STRING, order_id STRING, decided_at TIMESTAMP, manager_decision STRING,
        recommendation STRING, probability DOUBLE, threshold DOUBLE, actual_outcome STRING, model_name STRING,
        model_version STRING, net_expected_savings DOUBLE, avoidable_fulfillment_cost DOUBLE,
        intervention_effectiveness DOUBLE, intervention_cost DOUBLE, false_positive_friction_cost DOUBLE
    """,
    "prototype_orders": """
        workflow_id STRING, prediction_id STRING, order_id STRING, created_at TIMESTAMP, status STRING,
        manager_decision STRING, decided_at TIMESTAMP, customer_message STRING
    """,
    "system_events": """
        event_id STRING, created_at TIMESTAMP, event_type STRING, status STRING, message STRING, metadata_json STRING
    """,
    "retraining_requests": """
        request_id STRING, model_version STRING, dataset_version STRING, trigger_type STRING, source STRING,
        status STRING, signals_json STRING, metadata_json STRING, updated_at TIMESTAMP
    """,
    "health_checks": """
        model_version STRING, checked_at TIMESTAMP, prediction_psi DOUBLE, severe_feature_drift_count BIGINT,
        eligible_runtime_predictions BIGINT, labeled_observations BIGINT, severe_drift BOOLEAN
    """,
    "model_events": "model_id STRING, event STRING, at TIMESTAMP, reason STRING",
    "model_records": """
        model_id STRING, at TIMESTAMP, source STRING, path STRING, dataset_version STRING, threshold DOUBLE, record_json STRING
    """,
    "production_support": """
        model_id STRING, promoted_at TIMESTAMP, path STRING, rebuilt BOOLEAN, holdout_rows BIGINT, mean_probability DOUBLE,
        median_probability DOUBLE, p95_probability DOUBLE, train_rate DOUBLE, validation_rate DOUBLE, test_rate DOUBLE
    """,
}

METRICS = """
    roc_auc DOUBLE, pr_auc DOUBLE, brier DOUBLE, f1 DOUBLE, precision DOUBLE, recall DOUBLE,
    recall_at_80_precision DOUBLE, precision_at_80_precision DOUBLE, threshold_at_80_precision DOUBLE,
    recall_at_90_precision DOUBLE, precision_at_90_precision DOUBLE, threshold_at_90_precision DOUBLE
"""
BUSINESS = """
    orders BIGINT, canceled_orders BIGINT, interventions BIGINT, intervention_rate DOUBLE,
    cancellations_intervened BIGINT, cancellation_capture_rate DOUBLE, false_interventions BIGINT,
    false_intervention_rate DOUBLE, estimated_avoided_cost DOUBLE, intervention_cost_total DOUBLE,
    false_intervention_cost_total DOUBLE, net_savings DOUBLE, net_savings_per_1000_orders DOUBLE,
    average_net_savings_per_intervention DOUBLE
"""


def _struct(ddl: str) -> str:
    return "STRUCT<" + ", ".join(f"{f.split()[0]}: {f.split()[1]}" for f in ddl.split(",")) + ">"


MODEL_RECORD = f"""
    model_id STRING, model_family STRING, display_name STRING, status STRING, dataset_version STRING,
    threshold DOUBLE, training_device STRING, duration_seconds DOUBLE, training_scope STRING,
    run_name STRING, run_role STRING, trained_at STRING,
    val_metrics {_struct(METRICS)}, test_metrics {_struct(METRICS)},
    val_business_metrics {_struct(BUSINESS)}, test_business_metrics {_struct(BUSINESS)},
    business_metrics {_struct(BUSINESS)}, qualification STRUCT<passed: BOOLEAN>
"""
SUITE_SUMMARY = (
    "dataset_version STRING, candidate_model_id STRING, production_model_id STRING, "
    f"models ARRAY<STRUCT<{MODEL_RECORD}>>"
)
