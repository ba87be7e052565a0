"""Names, limits and word lists shared by every job."""

# --- Fixed values: column names and vocabularies of the data contract ---

ORDER_ID_CANDIDATES = ["increment_id", "order_id", "Order ID", "item_id"]
CUSTOMER_ID_CANDIDATES = ["Customer ID", "customer_id"]
NULL_WORDS = ["", "nan", "None", "<NA>"]

REQUIRED_COLUMNS = [
    "created_at", "price", "qty_ordered", "grand_total", "discount_amount",
    "payment_method", "category_name_1", "status",
]
VALID_STATUSES = ["complete", "canceled"]

NUMERIC_FEATURES = [
    "price", "qty_ordered", "grand_total", "discount_amount", "discount_ratio",
    "is_cod", "has_discount", "day_of_week", "hour", "customer_cancel_rate",
]
CATEGORICAL_FEATURES = ["category_name_1", "payment_method"]
FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
FEATURE_SCHEMA_VERSION = "order_features_v1"
TARGET = "is_canceled"
BASE_INPUTS = [
    "price", "qty_ordered", "grand_total", "discount_amount",
    "payment_method", "category_name_1",
]
LEAKAGE_COLUMNS = [
    "BI Status", "bi_status", "canceled_at", "cancelled_at", "completed_at",
    "final_status", "is_canceled", "refund", "refund_status", "status",
]

HOLD = "Hold for Verification"
APPROVE = "Approve for Fulfillment"
AWAITING = "Awaiting Operations Review"

PRODUCTION_MODES = [
    "manual", "batch", "production", "production_manual", "production_batch", "api",
]
BUSINESS_MODES = [
    "manual", "batch", "production_manual", "production_batch", "simulation_live",
]
PENDING_MODES = ["simulation_live", "manual", "production_manual"]
LIFECYCLE_MODES = ["simulation_live", "manual", "production_manual", "production", "api"]
UNKNOWN_MODE = "legacy_or_unknown"
MODE_LABELS = {
    "manual": "Manual orders",
    "batch": "Batch orders",
    "production": "Production/API",
    "production_manual": "Production manual",
    "production_batch": "Production batch",
    "api": "API orders",
    "simulation_live": "Live simulation",
    "simulation_historical": "Historical evaluation",
    "simulation": "Legacy simulation",
    "historical_evaluation": "Legacy historical evaluation",
    "single": "Legacy / unclassified single",
    "legacy_or_unknown": "Legacy / unknown",
}

# --- Fixed values: default policy, gates, cuts and seed ---

DEFAULT_POLICY = {
    "avoidable_fulfillment_cost": 2000.0,
    "intervention_effectiveness": 0.55,
    "intervention_cost": 150.0,
    "false_positive_friction_cost": 50.0,
}
DEFAULT_GATES = {
    "min_roc_auc": 0.80,
    "min_pr_auc": 0.70,
    "max_brier": 0.22,
    "min_recall_at_90_precision": 0.15,
    "min_net_savings_per_1000_orders": 0.0,
}
MIN_MONITORING_ROWS = 100
LOW_MAX = 0.35
HIGH_MIN = 0.70
PSI_CUTS = (0.10, 0.25)
TV_CUTS = (0.10, 0.20)
SEED = 42
