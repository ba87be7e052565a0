"""SQL counterpart of each query, written from the definitions on the same base tables.

``TABLES`` holds named sub-queries; a final query pulls in the ones it mentions.
"""

from __future__ import annotations

import re

TABLES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def _needed(sql: str) -> list[str]:
    seen: list[str] = []

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in seen and re.search(rf"\b{name}\b", text):
                visit(TABLES[name])
                if name not in seen:
                    seen.append(name)

    visit(sql)
    return seen


def oracle(name: str, sql: str, recursive: bool = False) -> None:
    parts = [f"{n} AS ({TABLES[n].strip()})" for n in _needed(sql)]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        parts.append(body[len("WITH RECURSIVE"):].strip())
        ORACLES[name] = "WITH RECURSIVE " + ",\n".join(parts)
    else:
        ORACLES[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE"


# ---- items and orders ----

TABLES["d_base_items"] = """
SELECT
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 AND l_tax = 0.07 THEN NULL ELSE CAST(l_orderkey AS VARCHAR) END AS increment_id,
  CASE WHEN o_totalprice >= 20000 THEN CAST(o_custkey AS VARCHAR) END AS customer_id,
  CASE WHEN month(o_orderdate) = 1 AND day(o_orderdate) = 1 THEN 'not a date'
       ELSE strftime(o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)), '%Y-%m-%d %H:%M:%S') END AS created_at,
  CAST(l_partkey AS VARCHAR) AS sku,
  l_extendedprice AS price,
  CASE WHEN p_brand = 'Brand#13' AND l_tax = 0.08 THEN '0' WHEN p_brand = 'Brand#13' AND l_tax = 0.0 THEN 'two'
       ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS qty_ordered,
  CASE WHEN o_totalprice < 2500 THEN -o_totalprice ELSE o_totalprice END AS grand_total,
  l_extendedprice * l_discount + 0.0::DOUBLE AS discount_amount,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'cod' WHEN '2-HIGH' THEN 'Payaxis' WHEN '3-MEDIUM' THEN 'easypay_voucher'
       WHEN '5-LOW' THEN 'jazzwallet' END AS payment_method,
  CASE WHEN p_size < 50 THEN p_type END AS category_name_1,
  CASE WHEN l_linenumber = 1 AND l_tax = 0.01 AND l_linestatus = 'F'
         THEN CASE WHEN o_orderstatus = 'P' THEN 'complete' ELSE 'canceled' END
       WHEN o_orderstatus = 'P' THEN 'canceled' WHEN o_orderstatus = 'F' THEN 'Complete '
       WHEN o_orderpriority = '1-URGENT' THEN 'received' ELSE 'complete' END AS status,
  p_brand = 'Brand#7' AND l_linenumber = 2 AS twice
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""
TABLES["d_items"] = """
SELECT * EXCLUDE (twice) FROM d_base_items UNION ALL SELECT * EXCLUDE (twice) FROM d_base_items WHERE twice"""
TABLES["d_flagged"] = """
SELECT *,
  CASE WHEN increment_id IS NULL THEN 'missing_order_id;' ELSE '' END
  || CASE WHEN try_cast(created_at AS TIMESTAMP) IS NULL THEN 'invalid_created_at;' ELSE '' END
  || CASE WHEN price IS NULL OR price < 0 THEN 'invalid_price;' ELSE '' END
  || CASE WHEN try_cast(qty_ordered AS DOUBLE) IS NULL OR try_cast(qty_ordered AS DOUBLE) <= 0 THEN 'invalid_qty_ordered;' ELSE '' END
  || CASE WHEN grand_total IS NULL OR grand_total < 0 THEN 'invalid_grand_total;' ELSE '' END
  || CASE WHEN discount_amount IS NULL OR discount_amount < 0 THEN 'invalid_discount_amount;' ELSE '' END
  || CASE WHEN lower(trim(status)) NOT IN ('complete', 'canceled') THEN 'invalid_status;' ELSE '' END AS row_reason,
  row_number() OVER (PARTITION BY increment_id, customer_id, created_at, sku, price, qty_ordered, grand_total,
                     discount_amount, payment_method, category_name_1, status ORDER BY sku) AS copy_no
FROM d_items"""
TABLES["d_valid"] = """
SELECT increment_id, customer_id, CAST(created_at AS TIMESTAMP) AS created_at, sku, price,
       CAST(qty_ordered AS DOUBLE) AS qty_ordered, grand_total, discount_amount, payment_method, category_name_1,
       lower(trim(status)) AS status
FROM d_flagged WHERE row_reason = '' AND copy_no = 1"""
TABLES["d_inconsistent"] = "SELECT increment_id AS order_id FROM d_valid GROUP BY 1 HAVING count(DISTINCT status) > 1"
TABLES["d_kept"] = "SELECT * FROM d_valid WHERE increment_id NOT IN (SELECT order_id FROM d_inconsistent)"
TABLES["d_category_mode"] = """
SELECT increment_id AS order_id, v AS category_name_1 FROM (
  SELECT increment_id, v, row_number() OVER (PARTITION BY increment_id ORDER BY n DESC, v) AS rn FROM (
    SELECT increment_id, coalesce(category_name_1, 'unknown') AS v, count(*) AS n FROM d_kept GROUP BY 1, 2)) WHERE rn = 1"""
TABLES["d_payment_mode"] = """
SELECT increment_id AS order_id, v AS payment_method FROM (
  SELECT increment_id, v, row_number() OVER (PARTITION BY increment_id ORDER BY n DESC, v) AS rn FROM (
    SELECT increment_id, coalesce(payment_method, 'unknown') AS v, count(*) AS n FROM d_kept GROUP BY 1, 2)) WHERE rn = 1"""
TABLES["d_sums"] = """
SELECT increment_id AS order_id, min(created_at) AS created_at,
       arg_min(customer_id, created_at) FILTER (customer_id IS NOT NULL) AS customer_id,
       avg(price) AS price, sum(qty_ordered) AS qty_ordered, max(grand_total) AS grand_total,
       sum(discount_amount) AS discount_amount, max(CASE WHEN status = 'canceled' THEN 1 ELSE 0 END) AS is_canceled
FROM d_kept GROUP BY 1"""
TABLES["d_orders"] = """
SELECT s.order_id, created_at, customer_id, price, qty_ordered, grand_total, discount_amount, is_canceled,
       category_name_1, payment_method, CASE WHEN is_canceled = 1 THEN 'canceled' ELSE 'complete' END AS status,
       discount_amount / (abs(grand_total) + 0.00001::DOUBLE) AS discount_ratio,
       CASE WHEN lower(payment_method) = 'cod' THEN 1 ELSE 0 END AS is_cod,
       CASE WHEN discount_amount > 0 THEN 1 ELSE 0 END AS has_discount,
       CAST(isodow(created_at) - 1 AS INTEGER) AS day_of_week, CAST(hour(created_at) AS INTEGER) AS hour
FROM d_sums s JOIN d_category_mode USING (order_id) JOIN d_payment_mode USING (order_id)"""
_HISTORY = """
SELECT *, CASE WHEN prev_orders > 0 THEN prev_cancellations / CAST(prev_orders AS DOUBLE) ELSE 0.0::DOUBLE END AS customer_cancel_rate
FROM (SELECT *,
  CAST(row_number() OVER w - 1 AS BIGINT) AS prev_orders,
  CAST(sum(is_canceled) OVER w - is_canceled AS BIGINT) AS prev_cancellations
  FROM {source} WINDOW w AS (PARTITION BY customer_id ORDER BY created_at, order_id ROWS UNBOUNDED PRECEDING))"""
TABLES["d_history"] = _HISTORY.format(source="d_orders")
TABLES["d_scored"] = """
SELECT *, 0.5::DOUBLE * (1.0::DOUBLE + z / (1.0::DOUBLE + abs(z))) AS p FROM (
  SELECT *, -6.0::DOUBLE + 2.5::DOUBLE * is_cod + 0.00001::DOUBLE * grand_total + 3.0::DOUBLE * customer_cancel_rate AS z FROM d_history)"""
TABLES["d_labeled"] = """
SELECT order_id, created_at, is_canceled, 0.5::DOUBLE * (1.0::DOUBLE + z / (1.0::DOUBLE + abs(z))) AS probability FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderdate AS created_at,
    CASE WHEN o_orderstatus = 'P' OR (o_orderpriority = '1-URGENT' AND o_totalprice > 300000) THEN 1 ELSE 0 END AS is_canceled,
    -2.0::DOUBLE + 2.5::DOUBLE * (CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)
      + 0.00001::DOUBLE * (floor(o_totalprice / 1000.0::DOUBLE) * 1000.0::DOUBLE) AS z FROM orders)"""
TABLES["d_split"] = """
SELECT *, CASE WHEN pos < CAST(floor(n * 0.70::DOUBLE) AS BIGINT) THEN 'train'
  WHEN pos < CAST(floor(n * 0.85::DOUBLE) AS BIGINT) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY created_at, order_id) - 1 AS pos, count(*) OVER () AS n FROM d_labeled)"""


def econ(p: str) -> str:
    q = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {p}))"
    a = f"{q} * 2000.0::DOUBLE * 0.55::DOUBLE"
    f = f"(1.0::DOUBLE - {q}) * 50.0::DOUBLE"
    n = f"{a} - 150.0::DOUBLE - {f}"
    return (
        f"{a} AS expected_avoidable_cost, {f} AS expected_false_positive_cost, {n} AS net_expected_savings, "
        f"CASE WHEN {n} > 0 THEN 'Hold for Verification' ELSE 'Approve for Fulfillment' END AS recommendation"
    )


# ---- scored traffic ----

TABLES["d_events"] = "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events"
TABLES["d_pred"] = f"""
SELECT *, {econ("probability")} FROM (
SELECT CAST(event_id AS VARCHAR) AS prediction_id,
  CASE WHEN event_type = 'error' AND value < 5 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS order_id,
  ts AS predicted_at, 'scorecard' AS model_name, CASE WHEN k < 50 THEN 'm1' ELSE 'm2' END AS model_version,
  least(value / 200.0::DOUBLE, 1.0::DOUBLE) AS probability,
  CASE WHEN event_type = 'click' THEN 0.40::DOUBLE ELSE 0.45::DOUBLE END AS threshold,
  CASE WHEN k < 30 THEN 'Canceled' WHEN k < 35 THEN ' CANCELLED' WHEN k < 60 THEN 'complete' WHEN k < 70 THEN 'Completed'
       WHEN k < 75 THEN 'returned' END AS actual_outcome,
  CASE WHEN k < 35 THEN 1 WHEN k < 70 THEN 0 END AS y,
  value AS latency_ms,
  CASE event_type WHEN 'view' THEN 'manual' WHEN 'click' THEN ' Batch ' WHEN 'purchase' THEN 'api'
    WHEN 'signup' THEN 'simulation_live' ELSE CASE WHEN value >= 20 THEN 'simulation_historical' END END AS scoring_mode,
  CASE event_type WHEN 'view' THEN 'manual' WHEN 'click' THEN 'batch' WHEN 'purchase' THEN 'api'
    WHEN 'signup' THEN 'simulation_live'
    ELSE CASE WHEN value >= 20 THEN 'simulation_historical' ELSE 'legacy_or_unknown' END END AS mode,
  event_type IN ('view', 'click', 'purchase') AS eligible,
  value AS price, 1.0::DOUBLE + (k % 5) AS qty_ordered, value * (1.0::DOUBLE + (k % 5)) AS grand_total,
  k * 0.5::DOUBLE AS discount_amount,
  (k * 0.5::DOUBLE) / (abs(value * (1.0::DOUBLE + (k % 5))) + 0.00001::DOUBLE) AS discount_ratio,
  CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_cod, CASE WHEN k > 0 THEN 1 ELSE 0 END AS has_discount,
  CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(hour(ts) AS INTEGER) AS hour, k / 100.0::DOUBLE AS customer_cancel_rate,
  CASE WHEN k < 99 THEN 'C' || CAST(k % 7 AS VARCHAR) END AS category_name_1, event_type AS payment_method,
  event_type = 'error' AND value < 10 AS unreadable
FROM d_events)"""
TABLES["d_decisions"] = """
SELECT 'd1_' || CAST(event_id AS VARCHAR) AS decision_id, CAST(event_id AS VARCHAR) AS prediction_id, ts + INTERVAL 1 HOUR AS decided_at,
  CASE WHEN value >= 40 THEN 'Hold for Verification' ELSE 'Approve for Fulfillment' END AS manager_decision FROM d_events WHERE k < 40
UNION ALL
SELECT 'd2_' || CAST(event_id AS VARCHAR), CAST(event_id AS VARCHAR), ts + INTERVAL 2 HOUR,
  CASE WHEN value >= 40 THEN 'Approve for Fulfillment' ELSE 'Hold for Verification' END FROM d_events WHERE k < 15"""
TABLES["d_last_decision"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY decided_at DESC, decision_id DESC) AS rn FROM d_decisions) WHERE rn = 1"""
TABLES["d_lifecycle"] = """
SELECT 'ops_' || coalesce(order_id, 'None') AS workflow_id, p.prediction_id, order_id, predicted_at AS created_at,
  CASE WHEN manager_decision IS NULL THEN 'AWAITING_OPERATIONS_REVIEW'
       WHEN manager_decision = 'Approve for Fulfillment' THEN 'RELEASED_TO_FULFILLMENT' ELSE 'VERIFICATION_REQUIRED' END AS status,
  manager_decision, decided_at,
  CASE WHEN manager_decision IS NULL THEN 'Order received. Please wait while our operations team completes a short verification review.'
       WHEN manager_decision = 'Approve for Fulfillment' THEN 'Order approved. Your order has been released to fulfillment.'
       ELSE 'Additional verification is required before fulfillment. The order remains on hold.' END AS customer_message
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY predicted_at DESC, prediction_id DESC) AS rn
      FROM d_pred WHERE mode IN ('simulation_live', 'manual', 'api')) p
LEFT JOIN d_last_decision d ON p.prediction_id = d.prediction_id WHERE rn = 1"""
TABLES["d_actions"] = """
SELECT p.*, manager_decision,
  CASE WHEN manager_decision IS NOT NULL THEN manager_decision
       WHEN mode IN ('manual', 'simulation_live') THEN 'Awaiting Operations Review' ELSE recommendation END AS business_action
FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(order_id, prediction_id) ORDER BY predicted_at DESC, prediction_id DESC) AS rn
      FROM d_pred WHERE mode IN ('manual', 'batch', 'simulation_live')) p
LEFT JOIN d_last_decision d ON p.prediction_id = d.prediction_id WHERE rn = 1"""
TABLES["d_reference"] = """
SELECT *, price * qty_ordered AS grand_total, discount_amount / (abs(price * qty_ordered) + 0.00001::DOUBLE) AS discount_ratio FROM (
SELECT o_totalprice / 1000.0::DOUBLE AS price, 1.0::DOUBLE + (o_custkey % 5) AS qty_ordered, CAST(day(o_orderdate) AS DOUBLE) AS discount_amount,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS is_cod, CASE WHEN day(o_orderdate) > 15 THEN 1 ELSE 0 END AS has_discount,
  isodow(o_orderdate) - 1 AS day_of_week, o_orderkey % 24 AS hour, (o_custkey % 100) / 100.0::DOUBLE AS customer_cancel_rate,
  'C' || CAST(o_custkey % 7 AS VARCHAR) AS category_name_1,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'view' WHEN '2-HIGH' THEN 'click' WHEN '3-MEDIUM' THEN 'purchase' WHEN '5-LOW' THEN 'error' END AS payment_method
FROM orders)"""

NUMERIC = ["price", "qty_ordered", "grand_total", "discount_amount", "discount_ratio", "is_cod", "has_discount",
           "day_of_week", "hour", "customer_cancel_rate"]


def psi_sql(reference: str, current: str, feature: str) -> str:
    """PSI of one feature, from the sorted distinct decile edges."""
    ref, cur = f"(SELECT CAST({feature} AS DOUBLE) AS v FROM {reference})", f"(SELECT CAST({feature} AS DOUBLE) AS v FROM {current})"
    points = ", ".join(f"quantile_cont(v, {i / 10})" for i in range(11))
    return f"""
SELECT '{feature}' AS feature, CASE
  WHEN (SELECT count(v) FROM {ref}) < 20 OR (SELECT count(v) FROM {cur}) < 20 THEN NULL
  WHEN len(edges) < 3 THEN 0.0::DOUBLE
  ELSE (SELECT sum((cs - rs) * ln(cs / rs)) FROM (
    SELECT greatest(0.000001::DOUBLE, (SELECT count(*) FROM {ref} WHERE (i = 1 OR v > edges[i]) AND (i = len(edges) - 1 OR v <= edges[i + 1]))
                     / CAST((SELECT count(v) FROM {ref}) AS DOUBLE)) AS rs,
           greatest(0.000001::DOUBLE, (SELECT count(*) FROM {cur} WHERE (i = 1 OR v > edges[i]) AND (i = len(edges) - 1 OR v <= edges[i + 1]))
                     / CAST((SELECT count(v) FROM {cur}) AS DOUBLE)) AS cs
    FROM (SELECT unnest(range(1, len(edges))) AS i))) END AS psi
FROM (SELECT list_sort(list_distinct([{points}])) AS edges FROM {ref})"""


def tv_sql(reference: str, current: str, feature: str) -> str:
    side = "(SELECT coalesce({f}, '<missing>') AS c, count(*) AS n, sum(count(*)) OVER () AS total FROM {t} GROUP BY 1)"
    a, b = side.format(f=feature, t=reference), side.format(f=feature, t=current)
    return f"""
SELECT '{feature}' AS feature, 0.5::DOUBLE * sum(abs(coalesce(a.n / CAST(a.total AS DOUBLE), 0) - coalesce(b.n / CAST(b.total AS DOUBLE), 0))) AS total_variation
FROM {a} a FULL JOIN {b} b ON a.c = b.c"""


def drift_label(score: str, low: float, high: float) -> str:
    return (f"CASE WHEN {score} IS NULL THEN 'INSUFFICIENT DATA' WHEN {score} < {low} THEN 'STABLE' "
            f"WHEN {score} < {high} THEN 'WATCH' ELSE 'DRIFT' END")


TABLES["d_live"] = "SELECT * FROM d_pred WHERE eligible AND NOT unreadable"
TABLES["d_drift"] = "\nUNION ALL\n".join(
    [f"SELECT feature, 'PSI' AS metric, psi AS drift_score, {drift_label('psi', 0.10, 0.25)} AS status FROM ({psi_sql('d_reference', 'd_live', f)})" for f in NUMERIC]
    + [f"SELECT feature, 'Total variation', total_variation, {drift_label('total_variation', 0.10, 0.20)} FROM ({tv_sql('d_reference', 'd_live', f)})"
       for f in ("category_name_1", "payment_method")])

# ---- ledgers ----

TABLES["d_months"] = """
SELECT *, CASE mon WHEN 3 THEN 'FAILED' WHEN 7 THEN 'NO_NEW_DATA' WHEN 1 THEN 'SEED' ELSE 'SUCCESS' END AS final FROM (
  SELECT strftime(o_orderdate, '%Y%m') AS ym, CAST(strftime(o_orderdate, '%m') AS INTEGER) AS mon, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day,
    count(*) AS n, count(*) FILTER (o_orderstatus <> 'O') AS good, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2)"""
TABLES["d_batches"] = """
SELECT 'batch_' || ym AS batch_id, md5('file' || ym) AS file_hash, last_day AS uploaded_at, n AS raw_rows, good AS valid_rows, final AS status FROM d_months"""
TABLES["d_versions"] = """
SELECT 'v' || ym AS dataset_version, last_day + INTERVAL 1 DAY AS created_at, 'batch_' || ym AS source_batch_id, n AS row_count,
  customers AS order_count, mon >= 7 AS sample FROM d_months WHERE final IN ('SUCCESS', 'SEED')"""
TABLES["d_version_states"] = """
SELECT *, dataset_version = (SELECT dataset_version FROM d_versions WHERE NOT sample ORDER BY created_at DESC, dataset_version DESC LIMIT 1) AS active FROM d_versions"""
TABLES["d_system"] = """
SELECT 'e' || CAST(event_id AS VARCHAR) AS event_id, ts AS created_at,
  CASE event_type WHEN 'view' THEN 'BATCH_SCORING' WHEN 'click' THEN 'MODEL_CANDIDATE' WHEN 'purchase' THEN 'MODEL_PROMOTION'
    WHEN 'signup' THEN 'DATA_INGESTION' ELSE 'MODEL_RETRAINING' END AS event_type,
  CASE WHEN value >= 20 THEN 'SUCCESS' ELSE 'FAILED' END AS status, props AS message FROM events"""
TABLES["d_nations"] = "SELECT *, 'm' || CAST(c_nationkey AS VARCHAR) AS model_id FROM orders JOIN customer ON o_custkey = c_custkey"
TABLES["d_shares"] = """
SELECT model_id, count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) AS f, count(*) FILTER (o_orderstatus = 'P') / CAST(count(*) AS DOUBLE) AS p,
  count(*) FILTER (o_orderstatus = 'O') / CAST(count(*) AS DOUBLE) AS o,
  count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) / CAST(count(*) AS DOUBLE) AS u FROM d_nations GROUP BY 1"""
TABLES["d_models"] = """
SELECT model_id, 0.70::DOUBLE + 0.35::DOUBLE * f AS val_roc_auc, 0.55::DOUBLE + 0.5::DOUBLE * p AS val_pr_auc, 0.12::DOUBLE + 0.3::DOUBLE * o AS val_brier,
  0.5::DOUBLE * u AS val_recall_at_90_precision, 1000.0::DOUBLE * (p - 0.30::DOUBLE) AS val_net_savings_per_1000_orders,
  0.75::DOUBLE + 0.4::DOUBLE * p AS test_roc_auc, 0.60::DOUBLE + 0.5::DOUBLE * f AS test_pr_auc, 0.05::DOUBLE + 0.3::DOUBLE * o AS test_brier,
  0.6::DOUBLE * u AS test_recall_at_90_precision, 900.0::DOUBLE * (f - 0.30::DOUBLE) AS test_net_savings_per_1000_orders FROM d_shares"""
TABLES["d_gates"] = """
SELECT *, roc_gate AND pr_gate AND calibration_gate AND recall_gate AND business_gate AS qualified FROM (
  SELECT *, val_roc_auc >= 0.80 AS roc_gate, val_pr_auc >= 0.70 AS pr_gate, val_brier <= 0.22 AS calibration_gate,
    val_recall_at_90_precision >= 0.15 AS recall_gate, val_net_savings_per_1000_orders >= 0 AS business_gate FROM d_models)"""
TABLES["d_money_range"] = """
SELECT min(val_net_savings_per_1000_orders) AS low, max(val_net_savings_per_1000_orders) AS high FROM d_gates WHERE qualified"""
TABLES["d_selection"] = """
SELECT *, coalesce(qualified AND model_id = (SELECT model_id FROM (
    SELECT model_id, score AS s FROM d_model_scores WHERE qualified ORDER BY s DESC, model_id LIMIT 1)), false) AS selected_candidate
FROM d_model_scores"""
TABLES["d_model_scores"] = """
SELECT g.*, CASE WHEN qualified THEN 0.25::DOUBLE * val_roc_auc + 0.25::DOUBLE * val_pr_auc + 0.20::DOUBLE * (1 - val_brier)
  + 0.15::DOUBLE * val_recall_at_90_precision
  + 0.15::DOUBLE * CASE WHEN high = low THEN 1.0::DOUBLE ELSE (val_net_savings_per_1000_orders - low) / (high - low) END END AS score
FROM d_gates g, d_money_range"""
TABLES["d_model_events"] = """
SELECT model_id, 'REGISTER' AS event, min(o_orderdate) AS "at" FROM d_nations GROUP BY 1
UNION ALL SELECT model_id, 'CANDIDATE', o_orderdate FROM d_nations WHERE o_totalprice > 400000
UNION ALL SELECT model_id, 'PROMOTE', o_orderdate FROM d_nations WHERE o_totalprice < 1500"""
TABLES["d_production"] = '''SELECT model_id, "at" FROM d_model_events WHERE event = 'PROMOTE' ORDER BY "at" DESC, model_id DESC LIMIT 1'''
TABLES["d_candidate"] = """
SELECT model_id FROM (SELECT model_id, "at" FROM d_model_events WHERE event = 'CANDIDATE' ORDER BY "at" DESC, model_id DESC LIMIT 1)
WHERE "at" > coalesce((SELECT "at" FROM d_production), TIMESTAMP '1900-01-01')"""
TABLES["d_model_status"] = """
SELECT model_id, min("at") AS registered_at, max("at") AS changed_at,
  CASE WHEN model_id = (SELECT model_id FROM d_production) THEN 'PRODUCTION'
       WHEN model_id = (SELECT model_id FROM d_candidate) THEN 'CANDIDATE' ELSE 'READY' END AS status FROM d_model_events GROUP BY 1"""
TABLES["d_request_log"] = """
SELECT 'r' || CAST(user_id AS VARCHAR) AS request_id, 'm' || CAST(user_id % 10 AS VARCHAR) AS model_version, 'v' || CAST(user_id % 3 AS VARCHAR) AS dataset_version,
  CASE WHEN user_id % 2 = 0 THEN 'SUSTAINED_DATA_DRIFT' ELSE 'NEW_DATA_VERSION' END AS trigger_type,
  CASE event_type WHEN 'view' THEN 'RETRAINING_REQUIRED' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'CANDIDATE_READY'
    WHEN 'signup' THEN 'COMPLETED_NO_CANDIDATE' ELSE 'FAILED' END AS status, ts AS updated_at FROM events"""
TABLES["d_requests"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, min(updated_at) OVER (PARTITION BY request_id) AS created_at,
  row_number() OVER (PARTITION BY request_id ORDER BY updated_at DESC, status DESC) AS rn FROM d_request_log) WHERE rn = 1"""

# Greedy thinning: from each kept check, the next is the first at least 30 minutes later.
_WALK = """
WITH RECURSIVE walk AS (
  SELECT event_type AS model_version, min(ts) AS checked_at FROM events GROUP BY 1
  UNION ALL
  SELECT model_version, checked_at FROM (
    SELECT w.model_version, (SELECT min(e.ts) FROM events e WHERE e.event_type = w.model_version AND e.ts >= w.checked_at + INTERVAL 30 MINUTE) AS checked_at
    FROM walk w) WHERE checked_at IS NOT NULL),
recorded AS (SELECT w.model_version, w.checked_at, bool_or(e.value >= 20) AS severe_drift FROM walk w JOIN events e
  ON e.event_type = w.model_version AND e.ts = w.checked_at GROUP BY 1, 2),
sustained AS (SELECT model_version, count(*) AS recent_checks, count(*) >= 2 AND bool_and(severe_drift) AS sustained_drift FROM (
  SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY checked_at DESC) AS rn FROM recorded) WHERE rn <= 2 GROUP BY 1)
"""
TABLES["d_signals"] = """
SELECT event_type AS model_version, avg(CASE WHEN k >= 50 THEN 1.0::DOUBLE ELSE 0 END) * 0.5::DOUBLE AS prediction_psi,
  count(*) FILTER (value > 300) AS severe, count(*) AS eligible, count(*) FILTER (k < 75) AS labels,
  0.6::DOUBLE + 0.4::DOUBLE * avg(CASE WHEN k < 50 THEN 1.0::DOUBLE ELSE 0 END) AS roc, 0.3::DOUBLE * avg(CASE WHEN value >= 20 THEN 1.0::DOUBLE ELSE 0 END) AS brier,
  count(*) FILTER (value > 100) - count(*) FILTER (k < 10) AS savings,
  0.6::DOUBLE + 0.45::DOUBLE * avg(CASE WHEN k < 60 THEN 1.0::DOUBLE ELSE 0 END) AS base_roc, 0.3::DOUBLE * avg(CASE WHEN value >= 40 THEN 1.0::DOUBLE ELSE 0 END) AS base_brier
FROM d_events GROUP BY 1"""
_REASONS = """concat_ws(',', CASE WHEN labels >= 100 AND roc < base_roc - 0.05::DOUBLE THEN 'roc_auc_declined' END,
  CASE WHEN labels >= 100 AND brier > base_brier + 0.05::DOUBLE THEN 'brier_worsened' END,
  CASE WHEN labels >= 100 AND savings <= 0 THEN 'business_value_not_positive' END)"""

# ---- sources and sinks ----

oracle("read_items", "SELECT * FROM d_items")
_SNAPSHOT = f"""order_id, created_at, customer_id, {r('price', 9)} AS price, qty_ordered, grand_total, {r('discount_amount', 9)} AS discount_amount,
  is_canceled, category_name_1, payment_method, status, {r('discount_ratio', 9)} AS discount_ratio, is_cod, has_discount, day_of_week, hour,
  prev_orders, prev_cancellations, customer_cancel_rate"""
oracle("read_snapshot_files", f"""
SELECT {_SNAPSHOT}, kind FROM d_history, (VALUES ('parquet'), ('csv')) k(kind)""")
oracle("version_snapshot", f"""
SELECT {_SNAPSHOT}, version FROM d_history, (VALUES ('v001'), ('active')) k(version) WHERE version = 'active' OR created_at < DATE '2000-01-01'""")
oracle("version_quarantine", """
SELECT increment_id, sku, created_at, price, grand_total, discount_amount, qty_ordered, status,
  row_reason || CASE WHEN copy_no > 1 THEN 'duplicate_row;' ELSE '' END AS quarantine_reason FROM d_flagged WHERE row_reason <> '' OR copy_no > 1""")
oracle("version_report", """
SELECT 'required_columns' AS check_name, 'PASS' AS status, CAST(0 AS BIGINT) AS affected_rows, 'Nothing is absent' AS details, version
FROM (VALUES ('v001'), ('v002')) k(version)""")
# Conflicting statuses are judged per upload; an order's items never span the two uploads.
oracle("ingest_batch", """
SELECT order_id, created_at, customer_id, grand_total, is_canceled, prev_orders, prev_cancellations, customer_cancel_rate FROM d_history""")
oracle("write_version", """
SELECT v AS dataset_version, made AS created_at, b AS source_batch_id, (SELECT count(*) FROM d_orders) AS row_count,
  (SELECT count(DISTINCT order_id) FROM d_orders) AS order_count, v = 'v002' AS active
FROM (VALUES ('v001', TIMESTAMP '2002-01-01', 'b1'), ('v002', TIMESTAMP '2002-01-02', 'b2')) x(v, made, b)""")
oracle("bronze", "SELECT * FROM d_items")
oracle("batch_dedupe", """
SELECT file_hash, filename, uploaded_at FROM (
  SELECT md5(CAST(o_custkey AS VARCHAR)) AS file_hash, CAST(o_orderkey AS VARCHAR) AS filename, o_orderdate AS uploaded_at,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS rn, o_custkey FROM orders)
WHERE rn = 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000 AND c_mktsegment <> 'BUILDING')""")
oracle("batch_status", "SELECT batch_id, file_hash, uploaded_at, raw_rows, valid_rows, status FROM d_batches")
oracle("prediction_log", "SELECT prediction_id, order_id, predicted_at, probability, recommendation, scoring_mode FROM d_pred")
oracle("support_tables", "SELECT order_id, is_canceled, probability FROM d_labeled")
oracle("benchmark_rows", """
SELECT model_id, upper(model_id) AS model, qualified AS qualified_on_validation, selected_candidate, val_roc_auc AS validation_roc_auc,
  val_brier AS validation_brier, val_net_savings_per_1000_orders AS validation_net_savings_per_1000_orders, test_roc_auc,
  CAST(NULL AS DOUBLE) AS test_f1, test_net_savings_per_1000_orders FROM d_selection""")
oracle("seed_version", """
SELECT 'seed_v1' AS dataset_version, count(*) AS row_count, count(DISTINCT order_id) AS order_count, true AS active, true AS added FROM d_orders""")
oracle("scored_export", f"""
SELECT order_id, probability, expected_avoidable_cost * 0.00361::DOUBLE AS expected_money_saved_usd,
  expected_false_positive_cost * 0.00361::DOUBLE AS expected_unnecessary_check_cost_usd,
  net_expected_savings * 0.00361::DOUBLE AS expected_net_savings_usd, recommendation, 0.00361::DOUBLE AS fx_pkr_to_usd,
  o_totalprice / 8 * 0.00361::DOUBLE AS price_usd, o_totalprice * 0.00361::DOUBLE AS grand_total_usd, -o_totalprice / 16 * 0.00361::DOUBLE AS discount_amount_usd
FROM (SELECT order_id, probability, {econ("probability")} FROM d_labeled) JOIN orders ON order_id = CAST(o_orderkey AS VARCHAR)""")

# ---- projections ----

oracle("normalize_identifiers", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN CAST(o_orderkey AS VARCHAR) END AS increment_id,
  CAST(o_custkey AS VARCHAR) AS customer_id FROM orders""")
oracle("normalize_schema", """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS created_at,
  CASE WHEN o_custkey > 10 THEN CAST(o_custkey AS VARCHAR) END AS customer_id,
  CASE WHEN o_orderpriority NOT IN ('5-LOW', '2-HIGH') THEN o_totalprice END AS price,
  CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 0 END AS is_canceled, CAST(3 AS BIGINT) AS prev_orders, o_orderstatus AS status FROM orders""")
oracle("required_columns", """
SELECT 'required_columns' AS check_name, 'FAIL' AS status, CAST(2 AS BIGINT) AS affected_rows,
  'Absent: [''price'', ''status'']' AS details, count(*) AS quarantined_rows FROM d_items""")
oracle("validate_items", """
SELECT increment_id, sku, created_at, qty_ordered, price, status, row_reason AS quarantine_reason, count(*) AS copies FROM d_flagged
GROUP BY increment_id, customer_id, created_at, sku, price, qty_ordered, grand_total, discount_amount, payment_method, category_name_1, status, row_reason""")
oracle("quarantine_rows", """
SELECT increment_id, sku, created_at, payment_method, category_name_1,
  row_reason || CASE WHEN copy_no > 1 THEN 'duplicate_row;' ELSE '' END AS quarantine_reason FROM d_flagged WHERE row_reason <> '' OR copy_no > 1
UNION ALL
SELECT increment_id, sku, strftime(created_at, '%Y-%m-%d %H:%M:%S'), payment_method, category_name_1, 'inconsistent_order_status;'
FROM d_valid WHERE increment_id IN (SELECT order_id FROM d_inconsistent)""")
oracle("valid_items", "SELECT * FROM d_valid")
oracle("row_features", """
SELECT increment_id, sku, price, CAST(isodow(created_at) - 1 AS INTEGER) AS day_of_week, CAST(hour(created_at) AS INTEGER) AS hour,
  discount_amount / (abs(grand_total) + 0.00001::DOUBLE) AS discount_ratio, CASE WHEN payment_method = 'cod' THEN 1 ELSE 0 END AS is_cod,
  CASE WHEN discount_amount > 0 THEN 1 ELSE 0 END AS has_discount, CASE WHEN status = 'canceled' THEN 1 ELSE 0 END AS is_canceled FROM d_valid""")
oracle("inference_features", """
SELECT order_id, created_at, price, 2.0::DOUBLE AS qty_ordered, price * 2.0::DOUBLE AS grand_total, discount_amount, payment_method, category_name_1,
  customer_cancel_rate, CAST(isodow(created_at) - 1 AS INTEGER) AS day_of_week, CAST(hour(created_at) AS INTEGER) AS hour,
  discount_amount / (abs(price * 2.0::DOUBLE) + 0.00001::DOUBLE) AS discount_ratio, CASE WHEN payment_method = 'COD' THEN 1 ELSE 0 END AS is_cod,
  CASE WHEN discount_amount > 0 THEN 1 ELSE 0 END AS has_discount
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate ELSE TIMESTAMP '2002-01-01 05:00:00' END AS created_at,
  o_totalprice AS price, CAST(o_custkey % 3 AS DOUBLE) AS discount_amount,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'COD' WHEN '5-LOW' THEN 'unknown' ELSE 'Payaxis' END AS payment_method,
  CASE WHEN o_orderstatus = 'F' THEN 'Beauty' ELSE 'unknown' END AS category_name_1,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, o_custkey / 1000.0::DOUBLE) END AS customer_cancel_rate FROM orders)""")
oracle("model_frame", f"""
SELECT order_id, {r('price', 9)} AS price, qty_ordered, grand_total, {r('discount_amount', 9)} AS discount_amount, {r('discount_ratio', 9)} AS discount_ratio, is_cod,
  has_discount, day_of_week, hour, {r('customer_cancel_rate', 9)} AS customer_cancel_rate, category_name_1, payment_method, is_canceled FROM d_history""")
oracle("economic_decision", f"SELECT order_id, probability, {econ('probability')} FROM d_labeled")
oracle("policy_effective", """
SELECT o_orderkey, 2000.0::DOUBLE AS avoidable_fulfillment_cost, CASE WHEN o_orderpriority = '2-HIGH' THEN 0.25::DOUBLE ELSE 0.55::DOUBLE END AS intervention_effectiveness,
  CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_custkey AS DOUBLE) ELSE 150.0::DOUBLE END AS intervention_cost,
  50.0::DOUBLE AS false_positive_friction_cost FROM orders""")
oracle("score_batch", f"""
SELECT order_id, p AS cancellation_probability, CASE WHEN p >= 0.41::DOUBLE THEN 'HIGH' ELSE 'LOW' END AS risk_level,
  expected_avoidable_cost, expected_false_positive_cost, net_expected_savings, recommendation
FROM (SELECT order_id, p, {econ('p')} FROM d_scored)""")
_BAND = "CASE WHEN probability < 0.35 THEN 'LOW' WHEN probability < 0.70 THEN 'MEDIUM' ELSE 'HIGH' END"
oracle("risk_band", f"SELECT order_id, {_BAND} AS risk_band FROM d_labeled")
oracle("monitoring_population", "SELECT prediction_id, mode AS monitoring_mode, eligible FROM d_pred")
oracle("outcome_norm", """
SELECT prediction_id, y AS label, CASE y WHEN 1 THEN 'Canceled' WHEN 0 THEN 'Completed' END AS outcome FROM d_pred""")
oracle("currency_convert", """
SELECT o_orderkey, usd, usd / 0.00361::DOUBLE AS pkr, CASE WHEN usd < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(usd)) AS text
FROM (SELECT o_orderkey, (CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END) * 0.00361::DOUBLE AS usd FROM orders)""")
oracle("order_lifecycle", "SELECT * FROM d_lifecycle")
oracle("feature_payload", """
SELECT prediction_id, price, qty_ordered, grand_total, discount_amount, discount_ratio, CAST(is_cod AS BIGINT) AS is_cod, CAST(has_discount AS BIGINT) AS has_discount,
  CAST(day_of_week AS BIGINT) AS day_of_week, CAST(hour AS BIGINT) AS hour, customer_cancel_rate, category_name_1, payment_method FROM d_pred WHERE NOT unreadable""")
oracle("model_health", """
SELECT model_id, CASE WHEN test_roc_auc >= 0.90 AND test_brier <= 0.12 THEN 'Strong' WHEN test_roc_auc >= 0.82 AND test_brier <= 0.20 THEN 'Good'
  ELSE 'Needs review' END AS health FROM d_models""")


def backtest_sql(policies: str, names: str) -> str:
    """All figures per policy by pairing every policy with every labeled order."""
    return f"""
SELECT {names}, o AS orders, c AS canceled_orders, h AS interventions, h / CAST(o AS DOUBLE) AS intervention_rate, k AS cancellations_intervened,
  CASE WHEN c > 0 THEN k / CAST(c AS DOUBLE) ELSE 0.0::DOUBLE END AS cancellation_capture_rate, h - k AS false_interventions,
  CASE WHEN h > 0 THEN (h - k) / CAST(h AS DOUBLE) ELSE 0.0::DOUBLE END AS false_intervention_rate,
  k * a * e AS estimated_avoided_cost, h * ic AS intervention_cost_total, (h - k) * f AS false_intervention_cost_total,
  k * a * e - h * ic - (h - k) * f AS net_savings, (k * a * e - h * ic - (h - k) * f) / o * 1000 AS net_savings_per_1000_orders,
  CASE WHEN h > 0 THEN (k * a * e - h * ic - (h - k) * f) / h ELSE 0.0::DOUBLE END AS average_net_savings_per_intervention
FROM (SELECT {names}, a, e, ic, f, count(*) AS o, count(*) FILTER (is_canceled = 1) AS c,
    count(*) FILTER (probability * a * e - ic - (1.0::DOUBLE - probability) * f > 0) AS h,
    count(*) FILTER (is_canceled = 1 AND probability * a * e - ic - (1.0::DOUBLE - probability) * f > 0) AS k
  FROM d_labeled, ({policies}) GROUP BY ALL)"""


_FIGURES = ["intervention_rate", "cancellation_capture_rate", "false_intervention_rate", "estimated_avoided_cost", "intervention_cost_total",
            "false_intervention_cost_total", "net_savings", "net_savings_per_1000_orders", "average_net_savings_per_intervention"]
_COUNTS = ["orders", "canceled_orders", "interventions", "cancellations_intervened", "false_interventions"]
_ROUNDED = ", ".join(_COUNTS + [f"{r(c)} AS {c}" for c in _FIGURES])
_KEYS = ("a AS avoidable_fulfillment_cost", "e AS intervention_effectiveness", "ic AS intervention_cost", "f AS false_positive_friction_cost")
oracle("policy_backtest", f"""
SELECT {_ROUNDED} FROM ({backtest_sql("SELECT 1 AS one, 2000.0::DOUBLE AS a, 0.55::DOUBLE AS e, 150.0::DOUBLE AS ic, 50.0::DOUBLE AS f", "one")})""")
oracle("whatif_scenarios", f"""
SELECT scenario, {", ".join(r(k.split()[0]) + " AS " + k.split()[2] for k in _KEYS)}, {_ROUNDED}
FROM ({backtest_sql('''SELECT 'Conservative' AS scenario, 1500.0::DOUBLE AS a, 0.55::DOUBLE - 0.15::DOUBLE AS e, 187.5::DOUBLE AS ic, 62.5::DOUBLE AS f
  UNION ALL SELECT 'Current assumptions', 2000.0::DOUBLE, 0.55::DOUBLE, 150.0::DOUBLE, 50.0::DOUBLE
  UNION ALL SELECT 'Favorable', 2500.0::DOUBLE, 0.55::DOUBLE + 0.15::DOUBLE, 112.5::DOUBLE, 37.5::DOUBLE''', "scenario, a, e, ic, f")})""")
oracle("sensitivity_grid", f"""
SELECT {", ".join(_KEYS)}, interventions, {", ".join(f"{r(c)} AS {c}" for c in ("intervention_rate", "cancellation_capture_rate", "false_intervention_rate", "net_savings", "net_savings_per_1000_orders"))}
FROM ({backtest_sql('''SELECT a, e, ic, 50.0::DOUBLE AS f FROM (VALUES (1000.0::DOUBLE), (2000.0::DOUBLE), (4000.0::DOUBLE)) x(a),
  (VALUES (0.25::DOUBLE), (0.55::DOUBLE), (0.85::DOUBLE)) y(e), (VALUES (75.0::DOUBLE), (150.0::DOUBLE), (1500.0::DOUBLE)) z(ic)''', "a, e, ic, f")})""")
oracle("traffic_population", """
SELECT CASE mode WHEN 'manual' THEN 'Manual orders' WHEN 'batch' THEN 'Batch orders' WHEN 'api' THEN 'API orders' WHEN 'simulation_live' THEN 'Live simulation'
  WHEN 'simulation_historical' THEN 'Historical evaluation' ELSE 'Legacy / unknown' END AS traffic_type, mode AS scoring_mode, count(*) AS predictions,
  CASE WHEN mode IN ('manual', 'batch', 'api') THEN 'Yes' ELSE 'No' END AS used_for_production_monitoring FROM d_pred GROUP BY mode""")

# ---- joins ----

oracle("order_snapshot", f"""
SELECT order_id, created_at, customer_id, {r('price', 9)} AS price, qty_ordered, grand_total, {r('discount_amount', 9)} AS discount_amount, is_canceled, category_name_1,
  payment_method, status, {r('discount_ratio', 9)} AS discount_ratio, is_cod, has_discount, day_of_week, hour FROM d_orders""")
oracle("business_impact", f"""
SELECT (SELECT count(*) FROM d_pred WHERE mode IN ('manual', 'batch', 'simulation_live')) AS scoring_records, n AS orders_scored, pending AS orders_pending_review,
  released AS orders_released, v AS orders_verified, {r('v / CAST(n AS DOUBLE)', 4)} AS verification_rate, {r('p', 4)} AS expected_cancellations_reached,
  {r('a', 4)} AS expected_cost_prevented, {r('v * 150.0::DOUBLE', 4)} AS verification_cost, {r('f', 4)} AS expected_unnecessary_check_cost,
  {r('net', 4)} AS expected_net_savings, {r('net / n * 1000', 4)} AS net_savings_per_1000_orders, {r('net / v', 4)} AS average_net_savings_per_verified_order,
  first_scored_at, last_scored_at
FROM (SELECT count(*) AS n, count(*) FILTER (business_action = 'Awaiting Operations Review') AS pending,
    count(*) FILTER (business_action = 'Approve for Fulfillment') AS released, count(*) FILTER (business_action = 'Hold for Verification') AS v,
    sum(probability) FILTER (business_action = 'Hold for Verification') AS p, sum(expected_avoidable_cost) FILTER (business_action = 'Hold for Verification') AS a,
    sum(expected_false_positive_cost) FILTER (business_action = 'Hold for Verification') AS f,
    sum(net_expected_savings) FILTER (business_action = 'Hold for Verification') AS net, min(predicted_at) AS first_scored_at, max(predicted_at) AS last_scored_at
  FROM d_actions)""")
oracle("review_queue", """
SELECT created_at, l.order_id, status, customer_message, probability,
  CASE recommendation WHEN 'Hold for Verification' THEN 'Keep for verification' ELSE 'Release to fulfillment' END AS recommendation,
  CASE mode WHEN 'manual' THEN 'Manual order' WHEN 'simulation_live' THEN 'Demo simulation' ELSE mode END AS source
FROM (SELECT * FROM d_lifecycle ORDER BY created_at DESC, workflow_id DESC LIMIT 100) l LEFT JOIN d_pred p ON l.prediction_id = p.prediction_id""")
oracle("quarantine_existing", """
SELECT increment_id, sku, 'existing_order_id;' AS quarantine_reason FROM d_kept
WHERE increment_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')""")
oracle("new_orders_only", """
SELECT increment_id, sku, price FROM d_kept
WHERE increment_id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')""")
oracle("apply_outcomes", """
SELECT prediction_id, p.order_id, coalesce(outcome, actual_outcome) AS actual_outcome FROM d_pred p LEFT JOIN (
  SELECT order_id, outcome FROM (SELECT CAST(user_id AS VARCHAR) AS order_id, CASE WHEN k < 50 THEN 'Canceled' ELSE 'Completed' END AS outcome,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM d_events WHERE event_type IN ('purchase', 'view') AND k < 95) WHERE rn = 1) f
ON p.order_id = f.order_id""")
oracle("categorical_tv", f"""
SELECT feature, {r('total_variation', 9)} AS total_variation FROM ({tv_sql('d_reference', 'd_pred', 'category_name_1')} UNION ALL {tv_sql('d_reference', 'd_pred', 'payment_method')})""")
oracle("lookup", "SELECT model_id, val_roc_auc, test_roc_auc FROM d_models WHERE model_id = (SELECT model_id FROM d_production)")

# ---- aggregations ----

oracle("group_mode", """
SELECT order_id, category_name_1 AS category_mode, payment_method AS payment_mode FROM d_category_mode JOIN d_payment_mode USING (order_id)""")
_CHECKS = [
    ("order_identifier", "missing_order_id", "Orders are told apart by increment_id"),
    ("date_parsing", "invalid_created_at", "Rows without a readable created_at"),
    *[(f"range_{c}", f"invalid_{c}", f"Rows whose {c} is no number or out of range") for c in ("price", "qty_ordered", "grand_total", "discount_amount")],
    ("target_status", "invalid_status", "Rows whose status is neither complete nor canceled"),
]
oracle("validation_report", "SELECT 'required_columns' AS check_name, 'PASS' AS status, CAST(0 AS BIGINT) AS affected_rows, 'No required column is absent' AS details\nUNION ALL "
       + "\nUNION ALL ".join(
           f"SELECT '{n}', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END, count(*), '{d}' FROM d_flagged WHERE contains(row_reason, '{reason};')" for n, reason, d in _CHECKS)
       + """
UNION ALL SELECT 'duplicate_rows', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END, count(*), 'Rows equal to an earlier row' FROM d_flagged WHERE copy_no > 1
UNION ALL SELECT 'leakage_guard', 'PASS', 0, 'Never used as features: [''BI Status'', ''bi_status'', ''canceled_at'', ''cancelled_at'', ''completed_at'', ''final_status'', ''is_canceled'', ''refund'', ''refund_status'', ''status'']'
UNION ALL SELECT 'order_status_consistency', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END, count(*), 'Orders whose items end in different statuses' FROM d_inconsistent""")
oracle("inconsistent_orders", "SELECT order_id FROM d_inconsistent")
oracle("queue_counts", """
SELECT count(*) FILTER (status = 'AWAITING_OPERATIONS_REVIEW') AS awaiting_review, count(*) FILTER (status = 'RELEASED_TO_FULFILLMENT') AS released,
  count(*) FILTER (status = 'VERIFICATION_REQUIRED') AS verification_required FROM d_lifecycle""")
oracle("business_actions", "SELECT prediction_id, order_id, mode AS monitoring_mode, manager_decision, business_action FROM d_actions")
oracle("mode_counts", "SELECT mode AS monitoring_mode, count(*) AS predictions FROM d_pred GROUP BY 1")
oracle("raw_mode_counts", "SELECT scoring_mode, count(*) AS predictions FROM d_pred GROUP BY 1")
oracle("runtime_summary", f"""
SELECT (SELECT count(*) FROM d_pred) AS total_predictions, count(*) AS eligible_predictions, (SELECT count(*) FROM d_pred WHERE NOT eligible) AS excluded_predictions,
  count(*) >= 100 AS monitoring_ready, count(*) AS predictions, {r('avg(probability)', 4)} AS average_risk,
  {r('count(*) FILTER (probability >= threshold) / CAST(count(*) AS DOUBLE)', 4)} AS high_risk_rate,
  {r("count(*) FILTER (recommendation = 'Hold for Verification') / CAST(count(*) AS DOUBLE)", 4)} AS intervention_rate,
  {r("sum(net_expected_savings) FILTER (recommendation = 'Hold for Verification')", 4)} AS expected_net_savings_total, {r('avg(latency_ms)', 4)} AS latency_mean_ms,
  {r('quantile_cont(latency_ms, 0.95)', 4)} AS latency_p95_ms, {r('max(latency_ms)', 4)} AS latency_max_ms FROM d_pred WHERE eligible""")
oracle("pipeline_reliability", """
SELECT pipeline, count(*) AS runs, count(*) FILTER (ok) AS successful, count(*) FILTER (ok) / CAST(count(*) AS DOUBLE) AS success_rate FROM (
  SELECT 'DataOps batches' AS pipeline, status IN ('SUCCESS', 'SEED') AS ok FROM d_batches
  UNION ALL SELECT CASE event_type WHEN 'MODEL_CANDIDATE' THEN 'Model training' WHEN 'MODEL_PROMOTION' THEN 'Model promotion' ELSE 'Batch inference' END, status = 'SUCCESS'
  FROM d_system WHERE event_type IN ('MODEL_CANDIDATE', 'MODEL_PROMOTION', 'BATCH_SCORING')) GROUP BY 1""")
oracle("psi", "SELECT feature, " + r("psi", 9) + " AS psi FROM (" + " UNION ALL ".join(
    psi_sql("d_reference", "d_pred", f) for f in ("price", "qty_ordered", "grand_total", "discount_amount", "hour", "is_cod", "customer_cancel_rate")) + ")")
oracle("feature_drift", f"SELECT feature, metric, {r('drift_score', 9)} AS drift_score, status FROM d_drift")
oracle("profile_drift", f"SELECT feature, metric, {r('drift_score', 9)} AS drift_score, status FROM d_drift")
oracle("severe_drift", f"""
SELECT n AS severe_feature_drift_count, eligible >= 100 AND (coalesce(psi >= 0.25, false) OR n >= 2) AS severe_drift
FROM (SELECT (SELECT count(*) FROM d_drift WHERE status = 'DRIFT') AS n, (SELECT count(*) FROM d_pred WHERE eligible) AS eligible,
  (SELECT psi FROM ({psi_sql('d_labeled', '(SELECT probability FROM d_pred WHERE eligible)', 'probability')})) AS psi)""")
TABLES["d_points"] = """
SELECT s.probability AS threshold, (SELECT count(*) FROM d_labeled x WHERE x.probability >= s.probability) AS predicted,
  (SELECT count(*) FROM d_labeled x WHERE x.probability >= s.probability AND is_canceled = 1) AS tp,
  (SELECT count(*) FROM d_labeled) AS n, (SELECT sum(is_canceled) FROM d_labeled) AS positives
FROM (SELECT DISTINCT probability FROM d_labeled) s"""
TABLES["d_at41"] = """
SELECT count(*) FILTER (probability >= 0.41::DOUBLE AND is_canceled = 1) AS tp, count(*) FILTER (probability >= 0.41::DOUBLE) AS predicted,
  sum(is_canceled) AS positives, avg((probability - is_canceled) * (probability - is_canceled)) AS brier FROM d_labeled"""
_AT41 = f"""{r('2 * tp / CAST(predicted + positives AS DOUBLE)', 9)} AS f1, {r('tp / CAST(predicted AS DOUBLE)', 9)} AS precision,
  {r('tp / CAST(positives AS DOUBLE)', 9)} AS recall, {r('brier', 9)} AS brier"""
oracle("point_metrics", f"SELECT {_AT41} FROM d_at41")
TABLES["d_ap"] = """
SELECT sum((recall - coalesce(earlier, 0)) * precision) AS pr_auc FROM (
  SELECT recall, precision, lag(recall) OVER (ORDER BY threshold DESC) AS earlier FROM (
    SELECT threshold, tp / CAST(positives AS DOUBLE) AS recall, tp / CAST(predicted AS DOUBLE) AS precision FROM d_points))"""
# Share of (positive, negative) pairs ranked right, ties counting one half.
TABLES["d_auc"] = """
SELECT sum(CASE WHEN a.is_canceled = 1 AND b.is_canceled = 0 THEN a.n * b.n * CASE WHEN a.probability > b.probability THEN 1.0::DOUBLE
    WHEN a.probability = b.probability THEN 0.5::DOUBLE ELSE 0 END END)
  / ((SELECT CAST(count(*) AS DOUBLE) FROM d_labeled WHERE is_canceled = 1) * (SELECT count(*) FROM d_labeled WHERE is_canceled = 0)) AS roc_auc
FROM (SELECT probability, is_canceled, count(*) AS n FROM d_labeled GROUP BY 1, 2) a, (SELECT probability, is_canceled, count(*) AS n FROM d_labeled GROUP BY 1, 2) b"""
oracle("average_precision", f"SELECT {r('pr_auc', 9)} AS pr_auc FROM d_ap")
oracle("roc_auc", f"SELECT {r('roc_auc', 9)} AS roc_auc FROM d_auc")


def fixed_precision_sql(target: float, tag: str) -> str:
    met = f"(SELECT * FROM d_points WHERE tp / CAST(predicted AS DOUBLE) >= {target}::DOUBLE ORDER BY tp DESC, threshold LIMIT 1)"
    return f"""
  {r(f"coalesce((SELECT tp / CAST(positives AS DOUBLE) FROM {met}), 0.0::DOUBLE)", 9)} AS recall_at_{tag}_precision,
  {r(f"coalesce((SELECT tp / CAST(predicted AS DOUBLE) FROM {met}), (SELECT max(tp / CAST(predicted AS DOUBLE)) FROM d_points))", 9)} AS precision_at_{tag}_precision,
  {r(f"coalesce((SELECT threshold FROM {met}), 1.0::DOUBLE)", 9)} AS threshold_at_{tag}_precision"""


oracle("recall_at_precision", "SELECT " + ",".join(fixed_precision_sql(x, tag) for x, tag in ((0.40, "40"), (0.80, "80"), (0.90, "90"), (0.999, "100"))))
oracle("classification_metrics", f"""
SELECT (SELECT {r('roc_auc', 9)} FROM d_auc) AS roc_auc, (SELECT {r('pr_auc', 9)} FROM d_ap) AS pr_auc, {_AT41}, {fixed_precision_sql(0.80, '80')}, {fixed_precision_sql(0.90, '90')} FROM d_at41""")


def thresholds_sql() -> str:
    from orderlight.operators.curves import F1_THRESHOLDS

    return ", ".join(f"({x!r}::DOUBLE)" for x in F1_THRESHOLDS)


oracle("best_f1_threshold", f"""
SELECT {r('t', 9)} AS threshold, {r('f1', 9)} AS f1 FROM (
  SELECT t, 2 * count(*) FILTER (probability >= t AND is_canceled = 1) / CAST(count(*) FILTER (probability >= t) + sum(is_canceled) AS DOUBLE) AS f1
  FROM d_labeled, (VALUES {thresholds_sql()}) v(t) GROUP BY t) ORDER BY f1 DESC, t LIMIT 1""")
oracle("roc_curve", f"""
SELECT threshold, {r('(predicted - tp) / CAST(n - positives AS DOUBLE)', 9)} AS fpr, {r('tp / CAST(positives AS DOUBLE)', 9)} AS tpr FROM d_points""")
oracle("pr_curve", f"""
SELECT threshold, {r('tp / CAST(predicted AS DOUBLE)', 9)} AS precision, {r('tp / CAST(positives AS DOUBLE)', 9)} AS recall FROM d_points""")
oracle("calibration_bins", f"""
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS rows, {r('avg(probability)', 9)} AS mean_predicted, {r('avg(is_canceled)', 9)} AS fraction_positive
FROM (SELECT probability, is_canceled, {" + ".join(f"CASE WHEN probability > q{i} THEN 1 ELSE 0 END" for i in range(1, 10))} AS bin
  FROM d_labeled, (SELECT {", ".join(f"quantile_cont(probability, {i / 10}) AS q{i}" for i in range(1, 10))} FROM d_labeled)) GROUP BY 1""")
oracle("split_stats", f"""
SELECT split, count(*) AS rows, {r('avg(is_canceled)', 9)} AS cancellation_rate, min(created_at) AS "start", max(created_at) AS "end" FROM d_split GROUP BY 1""")
oracle("prediction_summary", f"""
SELECT count(*) AS holdout_rows, {r('avg(probability)', 9)} AS mean_probability, {r('quantile_cont(probability, 0.5)', 9)} AS median_probability,
  {r('quantile_cont(probability, 0.95)', 9)} AS p95_probability FROM d_labeled""")
TABLES["d_baseline"] = " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS number, CAST(NULL AS VARCHAR) AS text FROM d_history" for c in NUMERIC]
    + [f"SELECT '{c}', NULL, (SELECT {c} FROM d_history GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1)" for c in ("category_name_1", "payment_method")])
oracle("feature_baseline", f"SELECT feature, {r('number', 9)} AS number, text FROM d_baseline")
TABLES["d_lp"] = "SELECT y AS is_canceled, probability, threshold FROM d_pred WHERE eligible AND y IS NOT NULL"
TABLES["d_lp_points"] = """
SELECT s.probability AS threshold, count(*) AS predicted, sum(is_canceled) AS tp, (SELECT sum(is_canceled) FROM d_lp) AS positives
FROM (SELECT DISTINCT probability FROM d_lp) s JOIN d_lp x ON x.probability >= s.probability GROUP BY 1"""


def lp_fixed(target: float, tag: str) -> str:
    return fixed_precision_sql(target, tag).replace("d_points", "d_lp_points").replace(", 9)", ", 6)")


_LP_NET = "probability * 2000.0::DOUBLE * 0.55::DOUBLE - 150.0::DOUBLE - (1.0::DOUBLE - probability) * 50.0::DOUBLE > 0"
oracle("labeled_performance", f"""
SELECT (SELECT {r("sum(a.n * b.n * CASE WHEN a.probability > b.probability THEN 1.0::DOUBLE WHEN a.probability = b.probability THEN 0.5::DOUBLE ELSE 0 END) / (any_value(a.total) * any_value(b.total))")} FROM
    (SELECT probability, count(*) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS total FROM d_lp WHERE is_canceled = 1 GROUP BY 1) a,
    (SELECT probability, count(*) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS total FROM d_lp WHERE is_canceled = 0 GROUP BY 1) b) AS roc_auc,
  (SELECT {r("sum((recall - coalesce(earlier, 0)) * precision)")} FROM (SELECT recall, precision, lag(recall) OVER (ORDER BY threshold DESC) AS earlier FROM (
    SELECT threshold, tp / CAST(positives AS DOUBLE) AS recall, tp / CAST(predicted AS DOUBLE) AS precision FROM d_lp_points))) AS pr_auc,
  {r('brier')} AS brier, {r('2 * tp / CAST(predicted + positives AS DOUBLE)')} AS f1, {r('tp / CAST(predicted AS DOUBLE)')} AS precision,
  {r('tp / CAST(positives AS DOUBLE)')} AS recall, {lp_fixed(0.80, '80')}, {lp_fixed(0.90, '90')},
  {r('(caught * 1100.0::DOUBLE - held * 150.0::DOUBLE - (held - caught) * 50.0::DOUBLE) / n * 1000')} AS net_savings_per_1000_orders, n AS labeled_observations
FROM (SELECT count(*) AS n, sum(is_canceled) AS positives, count(*) FILTER (probability >= m) AS predicted, count(*) FILTER (probability >= m AND is_canceled = 1) AS tp,
    avg((probability - is_canceled) * (probability - is_canceled)) AS brier, count(*) FILTER ({_LP_NET}) AS held, count(*) FILTER (is_canceled = 1 AND {_LP_NET}) AS caught
  FROM d_lp, (SELECT quantile_cont(threshold, 0.5) AS m FROM d_lp))""")
oracle("seed_report", """
SELECT (SELECT count(*) FROM d_items) AS raw_rows, (SELECT count(*) FROM d_valid) AS valid_item_rows,
  (SELECT count(*) FROM d_flagged WHERE row_reason <> '' OR copy_no > 1) AS quarantined_item_rows, count(*) AS order_rows,
  count(*) FILTER (is_canceled = 0) AS complete_orders, count(*) FILTER (is_canceled = 1) AS canceled_orders FROM d_orders""")
oracle("queue_mix", f"""
SELECT {", ".join(r(f"count(*) FILTER (band = '{b}') / CAST(count(*) AS DOUBLE)", 9) + f' AS "{b}"' for b in ("LOW", "MEDIUM", "HIGH"))}
FROM (SELECT {_BAND} AS band FROM d_labeled)""")
oracle("feature_domains", """
SELECT DISTINCT 'category_name_1' AS feature, category_name_1 AS value FROM d_kept WHERE category_name_1 IS NOT NULL
UNION ALL SELECT DISTINCT 'payment_method', payment_method FROM d_kept WHERE payment_method IS NOT NULL""")

# ---- cumulative and latest-wins ----

for _name in ("customer_history_rows", "customer_history_hot"):
    oracle(_name, "SELECT order_id, customer_id, prev_orders, prev_cancellations, customer_cancel_rate FROM d_history")
oracle("duplicate_rows", """
SELECT increment_id, sku, created_at, count(*) - 1 AS extra_copies FROM d_flagged
GROUP BY increment_id, customer_id, created_at, sku, price, qty_ordered, grand_total, discount_amount, payment_method, category_name_1, status HAVING count(*) > 1""")
oracle("latest_per_order", """
SELECT prediction_id, order_id, predicted_at, probability FROM (SELECT *, row_number() OVER (
  PARTITION BY coalesce(order_id, prediction_id) ORDER BY predicted_at DESC, prediction_id DESC) AS rn FROM d_pred) WHERE rn = 1""")
oracle("latest_decision", "SELECT decision_id, prediction_id, decided_at, manager_decision FROM d_last_decision")
TABLES["d_merged"] = """
SELECT order_id, created_at, customer_id, is_canceled, CASE WHEN is_canceled = 1 THEN 'canceled' ELSE 'complete' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY created_at DESC, src DESC) AS rn FROM (
  SELECT order_id, created_at, customer_id, is_canceled, 0 AS src FROM d_orders WHERE created_at < TIMESTAMP '2000-01-01'
  UNION ALL SELECT order_id, created_at, customer_id, is_canceled, 1 FROM d_orders WHERE created_at >= TIMESTAMP '2000-01-01'
  UNION ALL SELECT order_id, created_at + INTERVAL 400 DAY, customer_id, 1 - is_canceled, 1 FROM d_orders
    WHERE created_at < TIMESTAMP '2000-01-01' AND payment_method = 'Payaxis')) WHERE rn = 1"""
for _name in ("cumulative_snapshot", "extended_snapshot"):
    oracle(_name, _HISTORY.format(source="d_merged"))
oracle("active_version", "SELECT dataset_version, created_at, source_batch_id, row_count, order_count, active FROM d_version_states WHERE active")
oracle("split_manifest", """
SELECT split, count(*) AS orders, CAST(sum(is_canceled) AS BIGINT) AS canceled, min(created_at) AS first_at, max(created_at) AS last_at FROM d_split GROUP BY 1""")
oracle("temporal_split", "SELECT order_id, split FROM d_split")
oracle("quick_sample", """
SELECT order_id, created_at FROM d_split WHERE n <= 1000 OR pos IN (SELECT (i * (n - 1)) // 999 FROM (SELECT unnest(range(1000)) AS i, (SELECT count(*) FROM d_labeled) AS n))""")
oracle("health_checks", _WALK + "SELECT model_version, checked_at, severe_drift FROM recorded")
oracle("kept_checks", _WALK + "SELECT model_version, checked_at, severe_drift FROM recorded ORDER BY checked_at DESC, model_version DESC LIMIT 200")
oracle("sustained_drift", _WALK + "SELECT model_version, recent_checks, sustained_drift FROM sustained")
oracle("open_request", """
SELECT model_version, dataset_version, trigger_type, request_id, status, created_at FROM (SELECT *, row_number() OVER (
  PARTITION BY model_version, dataset_version, trigger_type ORDER BY created_at DESC, request_id DESC) AS rn
  FROM d_requests WHERE status IN ('RETRAINING_REQUIRED', 'RUNNING', 'CANDIDATE_READY')) WHERE rn = 1""")
oracle("select_candidate", f"SELECT model_id, qualified, {r('score', 9)} AS selection_score, selected_candidate FROM d_selection")

# ---- newest first ----

TABLES["d_decision_log"] = """
SELECT decision_id, d.prediction_id, order_id, decided_at, manager_decision, recommendation, probability, threshold, actual_outcome, model_name, model_version,
  net_expected_savings, 2000.0::DOUBLE AS avoidable_fulfillment_cost, 0.55::DOUBLE AS intervention_effectiveness, 150.0::DOUBLE AS intervention_cost,
  50.0::DOUBLE AS false_positive_friction_cost FROM d_decisions d JOIN d_pred p ON d.prediction_id = p.prediction_id"""
oracle("decision_log", "SELECT * FROM d_decision_log")
oracle("decision_history", """
SELECT decision_id, decided_at, order_id, probability, threshold, recommendation, manager_decision, actual_outcome, net_expected_savings, model_name, model_version
FROM d_decision_log ORDER BY decided_at DESC, decision_id DESC LIMIT 500""")
oracle("recent_events", "SELECT * FROM d_system ORDER BY created_at DESC, event_id DESC LIMIT 10")
oracle("version_history", "SELECT dataset_version, created_at, source_batch_id, row_count, order_count, sample, active FROM d_version_states")
oracle("risk_trend", f"""
SELECT date_trunc('day', predicted_at)::TIMESTAMP AS window_start, count(*) AS predictions, {r('avg(probability)', 9)} AS average_risk FROM d_pred WHERE eligible GROUP BY 1""")
ORACLES["stream_risk_trend"] = ORACLES["risk_trend"]
ORACLES["stream_lifecycle"] = ORACLES["order_lifecycle"]

# ---- samples ----

oracle("sample_orders", """
SELECT increment_id, sku, price FROM d_items WHERE increment_id IN (
  SELECT increment_id FROM (SELECT DISTINCT increment_id FROM d_items WHERE increment_id IS NOT NULL) ORDER BY md5(increment_id || '#42') LIMIT 500)""")
oracle("reference_sample", "SELECT order_id, is_canceled FROM d_split WHERE split = 'train' ORDER BY md5(order_id || '#42') LIMIT 2000")
oracle("stratified_sample", f"""
SELECT order_id, band AS simulation_risk_band, md5(order_id || '#42-queue') AS queue_position FROM (
  SELECT *, row_number() OVER (PARTITION BY chosen ORDER BY md5(order_id || '#42-fill')) AS fill_rn, count(*) FILTER (chosen) OVER () AS taken, count(*) OVER () AS n FROM (
    SELECT *, rn <= CASE band WHEN 'MEDIUM' THEN least(2400, n0) * 0.30 ELSE least(2400, n0) * 0.35 END AS chosen FROM (
      SELECT order_id, band, row_number() OVER (PARTITION BY band ORDER BY md5(order_id || '#42')) AS rn, count(*) OVER () AS n0
      FROM (SELECT order_id, {_BAND} AS band FROM d_labeled))))
WHERE chosen OR fill_rn <= least(2400, n) - taken""")

# ---- explanations ----

_DRIVER = """
SELECT order_id, f AS feature, p - 0.5::DOUBLE * (1.0::DOUBLE + z2 / (1.0::DOUBLE + abs(z2))) AS impact FROM (
  SELECT order_id, p, '{f}' AS f, -6.0::DOUBLE + 2.5::DOUBLE * {a} + 0.00001::DOUBLE * {b} + 3.0::DOUBLE * {c} AS z2
  FROM d_scored)"""


def _base(c: str) -> str:
    return f"(SELECT number FROM d_baseline WHERE feature = '{c}')"


oracle("risk_drivers", f"""
SELECT order_id, CAST(place AS INTEGER) AS place, feature, {r('impact', 9)} AS impact FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY impact DESC, feature) - 1 AS place FROM (
    {_DRIVER.format(f='is_cod', a=_base('is_cod'), b='grand_total', c='customer_cancel_rate')}
    UNION ALL {_DRIVER.format(f='grand_total', a='is_cod', b=_base('grand_total'), c='customer_cancel_rate')}
    UNION ALL {_DRIVER.format(f='customer_cancel_rate', a='is_cod', b='grand_total', c=_base('customer_cancel_rate'))}) WHERE impact > 0) WHERE place < 3""")

# ---- models and retraining ----

oracle("top_importances", """
SELECT feature, CAST(abs(sum(is_canceled) * any_value(t.n) - count(*) * any_value(t.c)) AS DOUBLE) AS importance
FROM (SELECT 'category_name_1=' || category_name_1 AS feature, is_canceled FROM d_history
  UNION ALL SELECT 'payment_method=' || payment_method, is_canceled FROM d_history) l,
  (SELECT count(*) AS n, sum(is_canceled) AS c FROM d_history) t
GROUP BY feature ORDER BY importance DESC, feature LIMIT 15""")
oracle("support_set", """
SELECT name AS support_table, least(n, most) AS n_rows, least(n, most) AS n_orders, CAST(0 AS BIGINT) AS n_outside
FROM (VALUES ('test_predictions', 'test', 9223372036854775807), ('reference_orders', 'train', 20000), ('historical_orders', 'test', 2500),
  ('queue_orders', 'test', 2400)) k(name, part, most) JOIN (SELECT split, count(*) AS n FROM d_split GROUP BY 1) s ON s.split = k.part""")
oracle("split_check", "SELECT split, count(*) AS rows, count(DISTINCT is_canceled) = 2 AS both_classes FROM d_split GROUP BY 1")
oracle("preprocess", """
SELECT l.order_id, l.split, CAST((SELECT 10 + count(DISTINCT 'C' || CAST(o_custkey % 7 AS VARCHAR)) + count(DISTINCT CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL
  ELSE o_orderpriority END) FROM orders JOIN d_split t ON t.order_id = CAST(o_orderkey AS VARCHAR) WHERE t.split = 'train') AS INTEGER) AS width FROM d_split l""")
oracle("qualify_models", "SELECT model_id, roc_gate, pr_gate, calibration_gate, recall_gate, business_gate, qualified FROM d_gates")
oracle("legacy_score", f"SELECT model_id, {r('0.40::DOUBLE * test_roc_auc + 0.40::DOUBLE * test_pr_auc + 0.20::DOUBLE * (1 - test_brier)', 9)} AS score FROM d_models")
oracle("model_comparison", """
SELECT CASE status WHEN 'PRODUCTION' THEN 'Current Production' ELSE 'Candidate' END AS role, model_id, test_roc_auc AS roc_auc, test_pr_auc AS pr_auc, test_brier AS brier,
  test_recall_at_90_precision AS recall_at_90_precision FROM d_models JOIN d_model_status USING (model_id) WHERE status <> 'READY'""")
oracle("model_lifecycle", "SELECT * FROM d_model_status")
oracle("confirmed_degradation", f"SELECT model_version, {_REASONS} AS reasons FROM d_signals")
oracle("retraining_trigger", _WALK + f"""
SELECT s.model_version, eligible >= 100 AND (prediction_psi >= 0.25 OR severe >= 2) AS severe_drift, sustained_drift,
  CASE WHEN {_REASONS} <> '' THEN 'CONFIRMED_PERFORMANCE_DEGRADATION' WHEN sustained_drift THEN 'SUSTAINED_DATA_DRIFT' END AS trigger_type,
  {_REASONS} <> '' OR sustained_drift AS triggered FROM d_signals s JOIN sustained u ON s.model_version = u.model_version""")
oracle("new_data_request", """
SELECT 'retrain_' || sha256('m1|' || dataset_version) AS request_id, 'm1' AS model_version, dataset_version, 'NEW_DATA_VERSION' AS trigger_type,
  'dataops' AS source, 'RETRAINING_REQUIRED' AS status, created_at AS updated_at FROM d_versions""")
oracle("needed_requests", """
SELECT DISTINCT model_version, dataset_version, trigger_type FROM (
  SELECT model_version, dataset_version, trigger_type FROM d_request_log
  UNION ALL SELECT model_version, dataset_version, 'MANUAL_REQUEST' FROM d_request_log) l WHERE NOT EXISTS (
  SELECT 1 FROM d_requests q WHERE q.status IN ('RETRAINING_REQUIRED', 'RUNNING', 'CANDIDATE_READY')
    AND q.model_version = l.model_version AND q.dataset_version = l.dataset_version AND q.trigger_type = l.trigger_type)""")
oracle("request_status", "SELECT * FROM d_requests")
oracle("training_snapshot", """
SELECT order_id, created_at, is_canceled FROM d_split
WHERE n <= 6000 OR pos IN (SELECT i * (m - 1) // 5999 FROM range(6000) x(i), (SELECT count(*) AS m FROM d_labeled))""")

# ---- streams and the flagship ----

oracle("stream_score", f"""
SELECT order_id, p AS probability, recommendation, 'api' AS scoring_mode FROM (SELECT order_id, p, {econ('p')} FROM (
  SELECT order_id, 0.5::DOUBLE * (1.0::DOUBLE + z / (1.0::DOUBLE + abs(z))) AS p FROM (
    SELECT CAST(o_orderkey AS VARCHAR) AS order_id, -6.0::DOUBLE + 2.5::DOUBLE * (CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)
      + 0.00001::DOUBLE * o_totalprice + 3.0::DOUBLE * ((o_custkey % 100) / 100.0::DOUBLE) AS z FROM orders)))""")
oracle("stream_ingest", "SELECT order_id, created_at, is_canceled, prev_orders, prev_cancellations FROM d_history")
oracle("savings_by_category", f"""
SELECT category_name_1, recommendation, count(*) AS orders, {r('avg(p)', 4)} AS average_risk, {r('sum(net_expected_savings)', 4)} AS net_expected_savings
FROM (SELECT category_name_1, p, {econ('p')} FROM d_scored) GROUP BY 1, 2""")
