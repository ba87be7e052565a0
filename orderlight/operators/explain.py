"""Which features raise an order's risk: replace one feature at a time by its baseline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlight.contract import CATEGORICAL_FEATURES, FEATURES, NUMERIC_FEATURES
from orderlight.operators.quantiles import exact_quantiles


def feature_baseline(reference: DataFrame) -> dict[str, float | str]:
    """Median per numeric feature, smallest most frequent text per categorical feature."""
    medians = exact_quantiles(reference, NUMERIC_FEATURES, [0.5])
    base: dict[str, float | str] = {c: m[0] if m else 0.0 for c, m in medians.items()}
    for c in CATEGORICAL_FEATURES:
        # Counting per value first keeps a high-cardinality column out of a single buffer.
        top = (
            reference.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
            .agg(F.min_by("v", F.struct(-F.col("n"), F.col("v")))).first()[0]
        )
        base[c] = top if top is not None else "unknown"
    return base


def baselines_without(reference: DataFrame, fold: str, folds: int) -> list[dict[str, float | str]]:
    """For each fold the :func:`feature_baseline` of the rows outside it, in the passes of one."""
    part = F.col(fold)
    wide = reference.select(*[F.when(part != f, F.col(c)).alias(f"{c}_{f}") for f in range(folds) for c in NUMERIC_FEATURES])
    medians = exact_quantiles(wide, wide.columns, [0.5])
    out: list[dict[str, float | str]] = [
        {c: medians[f"{c}_{f}"][0] if medians[f"{c}_{f}"] else 0.0 for c in NUMERIC_FEATURES} for f in range(folds)]
    for c in CATEGORICAL_FEATURES:
        counts = reference.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(
            *[F.count_if(part != f).alias(f"n{f}") for f in range(folds)])
        top = counts.agg(*[
            F.min_by("v", F.when(F.col(f"n{f}") > 0, F.struct(-F.col(f"n{f}"), F.col("v")))) for f in range(folds)]).first()
        for base, v in zip(out, top):
            base[c] = v if v is not None else "unknown"
    return out


def baseline_table(reference: DataFrame) -> DataFrame:
    base = feature_baseline(reference)
    rows = [(c, float(v), None) if c in NUMERIC_FEATURES else (c, None, v) for c, v in base.items()]
    return reference.sparkSession.createDataFrame(rows, "feature STRING, number DOUBLE, text STRING")


def feature_domains(orders: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, value): the texts that occur in each column, for choosing from. One pass; copies of a
    pair combine before the shuffle."""
    columns = columns or CATEGORICAL_FEATURES
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    return orders.select(F.inline(pairs)).filter("value IS NOT NULL").distinct()


def top_drivers(impacts: Column, k: int = 3) -> Column:
    """Largest positive impacts of an array<struct<feature, impact>>."""
    positive = F.filter(impacts, lambda x: x["impact"] > 0)
    by_impact = F.array_sort(
        positive,
        lambda a, b: F.when(a["impact"] > b["impact"], -1).when(a["impact"] < b["impact"], 1)
        .when(a["feature"] < b["feature"], -1).otherwise(1),
    )
    return F.slice(by_impact, 1, k)


def risk_drivers(
    orders: DataFrame, score: Callable[[dict[str, Column]], Column], baseline: dict[str, float | str], k: int = 3
) -> DataFrame:
    """Drivers for a score that is a column expression of the features: all twelve variants
    are computed in the row, without copying or moving it."""
    own = {c: F.col(c) for c in FEATURES}
    p = score(own)
    impacts = F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            (p - score({**own, c: F.lit(baseline[c])})).alias("impact"),
        )
        for c in FEATURES
    ])
    return orders.withColumns({"probability": p, "drivers": top_drivers(impacts, k)})


def model_risk_drivers(
    orders: DataFrame, transform: Callable[[DataFrame], DataFrame], baseline: dict[str, float | str],
    key: str = "order_id", k: int = 3,
) -> DataFrame:
    """Drivers for a fitted model: thirteen variants per order go through one ``transform``
    that adds ``probability``, then meet again by order key (thirteen rows each)."""
    def variant(c: str | None) -> Column:
        fields = []
        for f in FEATURES:
            kind = "double" if f in NUMERIC_FEATURES else "string"
            fields.append((F.lit(baseline[f]) if f == c else F.col(f)).cast(kind).alias(f))
        return F.struct(F.lit(c or "").alias("_changed"), *fields)

    wide = orders.select(key, F.explode(F.array(variant(None), *[variant(c) for c in FEATURES])).alias("_v"))
    scored = transform(wide.select(key, "_v.*"))
    return (
        scored.groupBy(key).agg(
            F.max(F.when(F.col("_changed") == "", F.col("probability"))).alias("probability"),
            F.collect_list(F.struct(F.col("_changed").alias("feature"), F.col("probability").alias("p"))).alias("_all"),
        )
        .withColumn("_impacts", F.transform(
            F.filter("_all", lambda x: x["feature"] != ""),
            lambda x: F.struct(x["feature"].alias("feature"), (F.col("probability") - x["p"]).alias("impact")),
        ))
        .select(key, "probability", top_drivers(F.col("_impacts"), k).alias("drivers"))
    )
