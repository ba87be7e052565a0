"""Ranking and threshold metrics of labeled scores.

Everything starts from one row per distinct score (ties are one point of every curve) with
its row and positive counts. Prefix sums over the scores then give ROC, precision-recall,
average precision and fixed-precision recall in one small aggregate. ``by`` evaluates many
models or splits in the same pass.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlight.operators.ordering import running_totals
from orderlight.operators.quantiles import exact_quantiles

# Candidate F1 thresholds, .05 to .95 in 181 steps, with numpy's rounding.
F1_THRESHOLDS = [float(t) for t in np.linspace(0.05, 0.95, 181)]


def score_counts(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """(by, score, n, pos) per distinct score."""
    return (
        df.groupBy(*(by or []), F.col(p).cast("double").alias("score"))
        .agg(F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos"))
    )


def curve_points(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """One row per distinct score, highest first: counts at and above the score, group totals."""
    by = by or []
    run = running_totals(score_counts(df, y, p, by), by, ["score"], ["n", "pos"], descending=True, totals=True)
    run = run.withColumnsRenamed({"total_n": "rows", "total_pos": "positives"}).withColumns({
        "tp": F.col("before_pos") + F.col("pos"),
        "predicted": F.col("before_n") + F.col("n"),
    })
    return run.withColumns({
        "precision": F.col("tp") / F.col("predicted"),
        "recall": F.try_divide(F.col("tp"), F.col("positives")),
        "fp": F.col("predicted") - F.col("tp"),
    })


def roc_points(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    return points.select(
        *(by or []), F.col("score").alias("threshold"),
        F.try_divide(F.col("fp"), F.col("rows") - F.col("positives")).alias("fpr"),
        F.col("recall").alias("tpr"),
    )


def pr_points(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    return points.select(*(by or []), F.col("score").alias("threshold"), "precision", "recall")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def _fixed_precision(target: float, tag: str) -> list[Column]:
    """Recall never falls as the threshold goes down, so the lowest threshold that meets the
    target is also the one with the most recall."""
    ok = F.col("precision") >= target
    at = F.when(ok, F.col("score"))
    met = F.count_if(ok) > 0
    return [
        F.when(met, F.min_by("recall", at)).otherwise(F.lit(0.0)).alias(f"recall_at_{tag}_precision"),
        F.when(met, F.min_by("precision", at)).otherwise(F.max("precision")).alias(f"precision_at_{tag}_precision"),
        F.when(met, F.min(at)).otherwise(F.lit(1.0)).alias(f"threshold_at_{tag}_precision"),
    ]


def _rank_metrics() -> dict[str, Column]:
    neg = (F.col("n") - F.col("pos")).cast("double")
    area = F.sum(neg * (F.col("before_pos") + F.col("tp")).cast("double") / 2.0)
    pos, rows = F.max("positives").cast("double"), F.max("rows").cast("double")
    return {
        "roc_auc": F.try_divide(area, pos * (rows - pos)),
        "pr_auc": F.try_divide(F.sum(F.col("pos") * F.col("precision")), pos),
        "brier": F.sum(
            F.col("pos") * F.pow(1.0 - F.col("score"), 2.0) + neg * F.pow(F.col("score"), 2.0)
        ) / rows,
    }


def roc_auc(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    return points.groupBy(*(by or [])).agg(_rank_metrics()["roc_auc"].alias("roc_auc"))


def average_precision(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    return points.groupBy(*(by or [])).agg(_rank_metrics()["pr_auc"].alias("pr_auc"))


def recall_at_precision(points: DataFrame, targets: tuple[float, ...] = (0.80, 0.90), by: list[str] | None = None) -> DataFrame:
    cols = [c for t in targets for c in _fixed_precision(t, str(int(round(t * 100))))]
    return points.groupBy(*(by or [])).agg(*cols)


def classification_metrics(points: DataFrame, threshold: Column | str, by: list[str] | None = None) -> DataFrame:
    """ROC-AUC, average precision, Brier, F1/precision/recall at a threshold (a literal or a
    column of ``points``), and recall at 80% and 90% precision."""
    cut = F.col(threshold) if isinstance(threshold, str) else threshold
    hit = F.col("score") >= cut
    tp = F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0))
    predicted = F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))
    pos = F.max("positives")
    return points.groupBy(*(by or [])).agg(
        *[c.alias(k) for k, c in _rank_metrics().items()],
        _ratio(2.0 * tp, predicted + pos).alias("f1"),
        _ratio(tp, predicted).alias("precision"),
        _ratio(tp, pos).alias("recall"),
        *_fixed_precision(0.80, "80"),
        *_fixed_precision(0.90, "90"),
    )


def point_metrics(df: DataFrame, y: str, p: str, threshold: float) -> DataFrame:
    """F1, precision, recall and Brier at one threshold: a single aggregate over the rows."""
    hit, yes = F.col(p) >= threshold, F.col(y) == 1
    tp, predicted, pos = F.count_if(hit & yes), F.count_if(hit), F.count_if(yes)
    return df.agg(
        _ratio(2.0 * tp, predicted + pos).alias("f1"),
        _ratio(tp, predicted).alias("precision"),
        _ratio(tp, pos).alias("recall"),
        F.avg(F.pow(F.col(p) - F.col(y), 2.0)).alias("brier"),
    )


def _thresholds_reached(p: Column) -> Column:
    """How many F1 thresholds are <= p: computed from the step, then corrected by one using
    the exact literals."""
    table = F.array(*[F.lit(t) for t in F1_THRESHOLDS])
    last = len(F1_THRESHOLDS)
    step = (F1_THRESHOLDS[-1] - F1_THRESHOLDS[0]) / (last - 1)
    near = F.greatest(F.lit(0), F.least(F.lit(last), F.floor((p - F1_THRESHOLDS[0]) / step).cast("int") + 1))
    up = (near < last) & (F.try_element_at(table, near + 1) <= p)
    down = (near > 0) & (F.try_element_at(table, F.greatest(near, F.lit(1))) > p)
    return F.when(up, near + 1).when(down, near - 1).otherwise(near)


def f1_by_threshold(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """F1 at each of the 181 thresholds from one grouped pass (at most 182 rows per group)."""
    by = by or []
    reached = (
        df.groupBy(*by, _thresholds_reached(F.col(p)).alias("reached"))
        .agg(F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos"))
    )
    # Rows that reach threshold i count for thresholds 1..i, so at most 181 x 182 small rows.
    return (
        reached.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("reached"))))
        .groupBy(*by, "i").agg(F.sum("n").alias("predicted"), F.sum("pos").alias("tp"))
        .withColumn("positives", F.max("tp").over(Window.partitionBy(*by)))
        .filter(F.col("i") > 0)
        .select(
            *by,
            F.element_at(F.array(*[F.lit(t) for t in F1_THRESHOLDS]), F.col("i")).alias("threshold"),
            _ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("positives")).alias("f1"),
        )
    )


def best_f1_threshold(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """First threshold with the highest F1. Thresholds no score reaches have F1 = 0, so the
    answer is the first threshold when nothing scores above zero."""
    by = by or []
    best = f1_by_threshold(df, y, p, by).groupBy(*by).agg(
        F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("threshold"),
        F.max("f1").alias("f1"),
    )
    first = F.lit(F1_THRESHOLDS[0])
    none = F.coalesce(F.col("f1"), F.lit(0.0)) == 0
    return best.select(
        *by,
        F.when(none, first).otherwise(F.col("threshold")).alias("threshold"),
        F.coalesce(F.col("f1"), F.lit(0.0)).alias("f1"),
    )


def calibration_bins(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Mean score and positive rate per quantile bin; empty bins are left out. A score on an
    inner edge belongs to the lower bin."""
    edges = exact_quantiles(df, [p], [i / bins for i in range(bins + 1)])[p] or []
    bin_ = F.lit(0)
    for e in edges[1:-1]:
        bin_ = bin_ + (F.col(p) > F.lit(e)).cast("int")
    return (
        df.groupBy(bin_.alias("bin"))
        .agg(
            F.count("*").alias("rows"),
            F.avg(p).alias("mean_predicted"),
            F.avg(F.col(y).cast("double")).alias("fraction_positive"),
        )
    )


def prediction_summary(df: DataFrame, p: str) -> DataFrame:
    """Rows, mean, median and 95th percentile of a score column."""
    quantiles = exact_quantiles(df, [p], [0.5, 0.95])[p] or [math.nan, math.nan]
    return df.agg(
        F.count("*").alias("holdout_rows"),
        F.avg(p).alias("mean_probability"),
        F.lit(quantiles[0]).alias("median_probability"),
        F.lit(quantiles[1]).alias("p95_probability"),
    )
