"""Population stability and category shift between a reference and current traffic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlight.contract import CATEGORICAL_FEATURES, MIN_MONITORING_ROWS, NUMERIC_FEATURES
from orderlight.functions.labels import psi_label, tv_label
from orderlight.operators.binning import cell_counts
from orderlight.operators.quantiles import exact_quantiles
from orderlight.session import stored

MIN_ROWS = 20
FLOOR = 1e-6
MISSING = "<missing>"
PROFILE_SCHEMA = "feature STRING, edges ARRAY<DOUBLE>, counts ARRAY<BIGINT>, category STRING, n BIGINT"


def _bins(df: DataFrame, inner: dict[str, list[float]]) -> dict[str, list[int]]:
    """Values per right-closed bin of each feature. At most features x bins x 2 rows come
    back: cells 2i (before edge i) and 2i + 1 (on edge i) form bin i."""
    bins = {c: [0] * (len(e) + 1) for c, e in inner.items()}
    for r in cell_counts(df, inner).collect():
        bins[r["feature"]][r["cell"] // 2] += r["n"]
    return bins


def _stability_index(reference: list[int], current: list[int], distinct_edges: int) -> float | None:
    if sum(reference) < MIN_ROWS or sum(current) < MIN_ROWS:
        return None
    if distinct_edges < 3:
        return 0.0
    total = 0.0
    for a, b in zip(reference, current):
        r, c = max(a / sum(reference), FLOOR), max(b / sum(current), FLOOR)
        total += (c - r) * math.log(c / r)
    return total


def _numeric_profile(reference: DataFrame, features: list[str], bins: int, sketches: DataFrame | None = None) -> dict[str, tuple]:
    """Feature -> (distinct quantile edges, values per bin), from a few scans of ``reference``."""
    quantiles = exact_quantiles(reference, features, [i / bins for i in range(bins + 1)], sketches=sketches)
    edges = {c: sorted(set(quantiles[c] or [])) for c in features}
    counts = _bins(reference, {c: e[1:-1] for c, e in edges.items()})
    return {c: (edges[c], counts[c]) for c in features}


def _psi_rows(profile: dict[str, tuple], current: DataFrame) -> DataFrame:
    """(feature, psi) from one scan of the current side."""
    cur = _bins(current, {c: edges[1:-1] for c, (edges, _) in profile.items()})
    rows = [(c, _stability_index(counts, cur[c], len(edges))) for c, (edges, counts) in profile.items()]
    return current.sparkSession.createDataFrame(rows, "feature STRING, psi DOUBLE")


def psi_table(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """(feature, psi) over reference quantile bins. NULL with fewer than 20 values on either
    side, 0 when the reference has fewer than three distinct edges. The reference's columns are
    written once and scanned a few times, the current side once; the arithmetic sees ten numbers
    per feature and side."""
    narrow = stored(reference.select(*features), "reference")
    return _psi_rows(_numeric_profile(narrow, features, bins), current)


def _categories(df: DataFrame, features: list[str]) -> DataFrame:
    cells = [
        F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("category"))
        for c in features
    ]
    return df.select(F.inline(F.array(*cells))).groupBy("feature", "category").agg(F.count("*").alias("n"))


def _shift(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(feature, total_variation) of two tables (feature, category, n)."""
    zero = F.lit(0).cast("bigint")
    both = stored(
        reference.select("feature", "category", F.col("n").alias("ref"), zero.alias("cur"))
        .unionByName(current.select("feature", "category", zero.alias("ref"), F.col("n").alias("cur")))
        .groupBy("feature", "category").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur")),
        "categories",
    )
    # One row per feature.
    rows = both.groupBy("feature").agg(F.sum("ref").alias("ref_rows"), F.sum("cur").alias("cur_rows"))
    gap = F.abs(F.try_divide("ref", "ref_rows") - F.try_divide("cur", "cur_rows"))
    enough = (F.min("ref_rows") >= MIN_ROWS) & (F.min("cur_rows") >= MIN_ROWS)
    return both.join(F.broadcast(rows), "feature").groupBy("feature").agg(
        F.when(enough, 0.5 * F.sum(gap)).alias("total_variation"))


def _unseen(spark: SparkSession, features: list[str]) -> DataFrame:
    """A row without copies per feature, so that a side without rows still names its features."""
    return spark.createDataFrame([(c, MISSING, 0) for c in features], "feature STRING, category STRING, n BIGINT")


def total_variation_table(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """(feature, total_variation): half the summed share differences over the union of the
    categories. A missing value is a category of its own. NULL with fewer than 20 rows on either
    side. Each side is scanned once."""
    known = _categories(reference, features).unionByName(_unseen(reference.sparkSession, features))
    return _shift(known, _categories(current, features))


def reference_profile(reference: DataFrame, bins: int = 10, sketches: DataFrame | None = None) -> DataFrame:
    """All that drift needs of a reference, to be kept with it: per numeric feature one row of edges and
    bin counts, per text feature one row per category. With a kept profile the reference is not read again.
    ``sketches`` are those of ``quantile_sketches`` of the same rows; they spare the first scan."""
    spark = reference.sparkSession
    numeric = [c for c in NUMERIC_FEATURES if c in reference.columns]
    texts = [c for c in CATEGORICAL_FEATURES if c in reference.columns]
    narrow = stored(reference.select(*numeric, *texts), "reference")
    found = _numeric_profile(narrow, numeric, bins, sketches) if numeric else {}
    out = spark.createDataFrame([(c, e, n, None, None) for c, (e, n) in found.items()], PROFILE_SCHEMA)
    if texts:
        seen = _categories(narrow, texts).unionByName(_unseen(spark, texts))
        out = out.unionByName(seen, allowMissingColumns=True)
    return out


def profile_drift(profile: DataFrame, current: DataFrame) -> DataFrame:
    """``feature_drift`` against a kept ``reference_profile``: two scans of the current side's columns."""
    spark = profile.sparkSession
    numbers = {r["feature"]: (r["edges"], r["counts"]) for r in profile.filter("edges IS NOT NULL").collect()}
    names = {r["feature"] for r in profile.filter("edges IS NULL").select("feature").distinct().collect()}
    numeric = [c for c in NUMERIC_FEATURES if c in numbers and c in current.columns]
    texts = [c for c in CATEGORICAL_FEATURES if c in names and c in current.columns]
    out = spark.createDataFrame([], "feature STRING, metric STRING, drift_score DOUBLE, status STRING")
    # Read twice below, and often parsed from text: write the narrow columns once.
    current = stored(current.select(*numeric, *texts), "current")
    if current.isEmpty():
        return out
    if numeric:
        psi = _psi_rows({c: numbers[c] for c in numeric}, current)
        out = out.unionByName(psi.select(
            "feature", F.lit("PSI").alias("metric"), F.col("psi").alias("drift_score"),
            psi_label(F.col("psi")).alias("status")))
    if texts:
        kept = profile.filter(F.col("edges").isNull() & F.col("feature").isin(texts))
        tv = _shift(kept, _categories(current, texts))
        out = out.unionByName(tv.select(
            "feature", F.lit("Total variation").alias("metric"), F.col("total_variation").alias("drift_score"),
            tv_label(F.col("total_variation")).alias("status")))
    return out


def feature_drift(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(feature, metric, drift_score, status) for the contract features both sides have. An
    empty current side gives an empty table, as nothing was observed."""
    both = [c for c in reference.columns if c in current.columns]
    return profile_drift(reference_profile(reference.select(*both)), current)


def severe_drift(drift: DataFrame, eligible_rows: Column, prediction_psi: Column) -> DataFrame:
    """One row: drifted features, and whether drift is severe enough to act on."""
    return drift.agg(F.count_if(F.col("status") == "DRIFT").alias("severe_feature_drift_count")).select(
        "severe_feature_drift_count",
        (
            (eligible_rows >= MIN_MONITORING_ROWS)
            & (F.coalesce(prediction_psi >= 0.25, F.lit(False)) | (F.col("severe_feature_drift_count") >= 2))
        ).alias("severe_drift"),
    )
