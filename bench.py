"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every query
runs once unmeasured, so that the figures do not hold JVM start-up, then once measured. ``queries``
are whole chains from the base tables, as registered; ``operators`` are the item operators alone, on
inputs that are built outside the clock; ``fits`` are training and evaluation at default budgets.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalog import QUERIES  # noqa: E402
from checks.tables import Tables  # noqa: E402
from orderlight.operators.orders import aggregate_to_orders, customer_history  # noqa: E402
from orderlight.operators.validation import checked_rows  # noqa: E402
from orderlight.plans.scoring import by_expression, scored_orders, softsign_score  # noqa: E402
from orderlight.session import local_session, stored  # noqa: E402

# Query -> table whose rows it processes, for rows per second.
HEADLINES = {
    "validate_items": "lineitem",
    "order_snapshot": "lineitem",
    "customer_history_rows": "lineitem",
    "cumulative_snapshot": "lineitem",
    "score_batch": "lineitem",
    "policy_backtest": "orders",
    "sensitivity_grid": "orders",
    "temporal_split": "orders",
    "quick_sample": "orders",
    "average_precision": "orders",
    "roc_auc": "orders",
    "best_f1_threshold": "orders",
    "classification_metrics": "orders",
    "stratified_sample": "orders",
    "psi": "events",
    "feature_drift": "events",
    "runtime_summary": "events",
    "business_impact": "events",
    "order_lifecycle": "events",
    "labeled_performance": "events",
}


FITS = ("train_lr", "train_rf", "train_gbt")


def item_operators(spark, sf: str) -> dict:
    """The item operators on stored inputs."""
    t = Tables(spark, sf)
    items, kept, history = stored(t.raw_items, "items"), stored(t.kept, "kept"), stored(t.history, "history")
    return {
        "validate_items": lambda: checked_rows(items),
        "order_snapshot": lambda: aggregate_to_orders(kept),
        "customer_history_rows": lambda: customer_history(t.orders, prepared=True),
        "score_batch": lambda: scored_orders(history, by_expression(softsign_score), 0.41),
    }


def timed(build) -> float:
    started = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def shuffle_bytes(spark) -> int:
    """Bytes written to shuffles so far, from the status store of the session."""
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    quantiles = gateway.new_array(gateway.jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, quantiles, none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    sizes = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in set(HEADLINES.values())}
    seconds, rate, moved = {}, {}, {}
    for name, table in HEADLINES.items():
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        try:
            before = shuffle_bytes(spark)
        except Exception:
            before = None
        seconds[name] = timed(lambda: QUERIES[name](spark, sf))
        rate[name] = round(sizes[table] / seconds[name])
        if before is not None:
            moved[name] = shuffle_bytes(spark) - before
    operators = {}
    for name, build in item_operators(spark, sf).items():
        timed(build)
        operators[name] = timed(build)
    fits = {name: timed(lambda: QUERIES[name](spark, sf)) for name in FITS}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")), "rows_per_sec": rate, "shuffle_bytes": moved,
        "operators": operators, "fits": fits,
    }))


if __name__ == "__main__":
    main()
