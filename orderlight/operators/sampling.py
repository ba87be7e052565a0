"""Repeatable samples. Rows are ordered by a hash of their key and a seed, so the same data
gives the same sample on any cluster and any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlight.contract import SEED
from orderlight.functions.cleaning import clean_id, quoted
from orderlight.functions.labels import risk_band
from orderlight.operators.ordering import global_rank
from orderlight.operators.quantiles import order_statistics
from orderlight.session import BROADCAST_ROWS

BANDS = ["LOW", "MEDIUM", "HIGH"]
BAND_SHARES = (0.35, 0.30, 0.35)
TOP_ROWS = 100_000  # rows that one task may merge into a sample


def hash_order(key: Column, seed: int | str = SEED) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def first_by_hash(df: DataFrame, key: str, n: int, seed: int | str = SEED, rows: int | None = None) -> DataFrame:
    """The ``n`` rows with the smallest hash. ``key`` must be unique in ``df``.

    A plain top-n would send n rows per task to one merging task. The hash is uniform, so rows
    above a generous cut can never be among the first n; if the cut ever keeps fewer than n
    rows, it is dropped. Beyond ``TOP_ROWS`` no single task merges the rows: they are ranked over
    sorted ranges. The result is always the exact first n.
    """
    rows = df.count() if rows is None else rows
    if n <= 0 or rows == 0:
        return df.limit(0)
    if n >= rows:
        return df
    ranked = df.withColumn("_h", hash_order(quoted(key), seed))
    share = (2.0 * n + 1000.0) / rows
    if share < 1.0:
        cut = format(int(share * 16**12), "012x")
        near = ranked.filter(F.col("_h") < cut)
        if near.count() >= n:
            ranked = near
    if n > TOP_ROWS:
        places = global_rank(ranked.withColumn("_k", quoted(key)), ["_h", "_k"], "_place")
        return places.filter(F.col("_place") < n).drop("_h", "_k", "_place")
    return ranked.orderBy("_h", quoted(key)).limit(n).drop("_h")


def sample_orders(items: DataFrame, order_column: str, n: int, seed: int = SEED) -> DataFrame:
    """All items of ``n`` sampled orders. Items without an order id are never part of it."""
    ids = (
        items.select(clean_id(quoted(order_column)).alias("_id"))
        .filter("_id IS NOT NULL").distinct()
    )
    chosen = first_by_hash(ids, "_id", n, seed)
    # Bounded by the requested n.
    chosen = F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen
    return items.join(chosen, clean_id(quoted(order_column)) == F.col("_id"), "left_semi")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    return first_by_hash(df, key, n, seed)


def band_quotas(total: int, shares: tuple[float, float, float] = BAND_SHARES) -> list[int]:
    if len(shares) != 3 or min(shares) < 0 or sum(shares) <= 0:
        raise ValueError("give one share per risk band, none negative, not all zero")
    scaled = [s / sum(shares) for s in shares]
    quotas = [math.floor(s * total) for s in scaled]
    largest_first = sorted(range(3), key=lambda i: -scaled[i])
    for i in largest_first[: total - sum(quotas)]:
        quotas[i] += 1
    return quotas


def stratified_sample(
    df: DataFrame, key: str, p: str, max_rows: int = 2400,
    shares: tuple[float, float, float] = BAND_SHARES, seed: int = SEED,
) -> DataFrame:
    """Queue with a fixed share per risk band; a short band is filled from the unused rows.
    ``queue_position`` mixes the bands."""
    rated = df.withColumns({"simulation_probability": F.col(p), "simulation_risk_band": risk_band(F.col(p))})
    sizes = {r["simulation_risk_band"]: r["count"] for r in rated.groupBy("simulation_risk_band").count().collect()}
    rows = sum(sizes.values())
    total = min(int(max_rows), rows)
    parts, left = [], total
    for band, quota in zip(BANDS, band_quotas(total, shares)):
        take = min(quota, sizes.get(band, 0))
        if take:
            pool = rated.filter(F.col("simulation_risk_band") == band)
            parts.append(first_by_hash(pool, key, take, seed, sizes[band]))
            left -= take
    if not parts:
        return rated.limit(0).withColumn("queue_position", F.lit(None).cast("string"))
    picked = parts[0]
    for part in parts[1:]:
        picked = picked.unionByName(part)
    if left > 0:
        used = picked.select(quoted(key).alias("_used"))
        used = F.broadcast(used) if total <= BROADCAST_ROWS else used
        unused = rated.join(used, quoted(key) == F.col("_used"), "left_anti")
        picked = picked.unionByName(first_by_hash(unused, key, left, f"{seed}-fill", rows - (total - left)))
    return picked.withColumn("queue_position", hash_order(quoted(key), f"{seed}-queue"))


def queue_mix(df: DataFrame, band: str = "simulation_risk_band") -> DataFrame:
    """Share of each band; absent bands have share 0."""
    share = [F.coalesce(F.try_divide(F.count_if(F.col(band) == b), F.count("*")), F.lit(0.0)).alias(b) for b in BANDS]
    return df.agg(*share)


def time_spanning_sample(df: DataFrame, n: int, time: str = "created_at", key: str = "order_id") -> DataFrame:
    """``n`` rows spread evenly over (time, key) order, first and last included: position r is
    kept iff r = floor(i * (rows - 1) / (n - 1)) for some i. Only the keys are ranked."""
    rows = df.count()
    if rows <= n:
        return df
    if n < 2:
        return df.orderBy(F.col(time).asc_nulls_last(), key).limit(n)
    ranked = global_rank(df.select(quoted(time).alias("_t"), quoted(key).alias("_k")), ["_t", "_k"], "_r")
    # Only an index next to r * (n - 1) / (rows - 1) can map onto position r.
    span, steps = rows - 1, n - 1
    near = ranked.withColumn("_i", F.expr(f"_r * {steps} DIV {span}"))
    hit = F.lit(False)
    for shift in (0, 1):
        hit = hit | F.expr(f"_i + {shift} <= {steps} AND (_i + {shift}) * {span} DIV {steps} = _r")
    kept = near.filter(hit).select("_k")
    kept = F.broadcast(kept) if n <= BROADCAST_ROWS else kept
    return df.join(kept, quoted(key) == F.col("_k"), "left_semi")


def _boundaries(keys: DataFrame, positions: list[int], known: int, rows: int) -> dict[int, tuple[int | None, str]]:
    """(time, key) at 0-based positions of (time, key) order, missing times last.

    Order statistics are over doubles, which keep the order of times but merge neighbours beyond
    2^53 microseconds. All rows that share the double of a wanted position are therefore ranked by
    their whole times and keys."""
    inside = sorted({p for p in positions if p < rows})
    if not inside:
        return {}
    dated = [p for p in inside if p < known]
    found = order_statistics(keys, {"_t": dated}, {"_t": known}) if dated else {}
    times = {p: found[("_t", p)] if p < known else None for p in inside}
    rounded = F.col("_t").cast("double")
    distinct = sorted({t for t in times.values() if t is not None})
    if None in times.values():
        distinct.append(None)

    def at(t: float | None) -> Column:
        return F.col("_t").isNull() if t is None else F.coalesce(rounded == t, F.lit(False))

    tied = F.lit(False)
    for t in distinct:
        tied = tied | at(t)
    size = keys.agg(
        *[F.count_if(at(t)).alias(f"n{i}") for i, t in enumerate(distinct)],
        *[(F.count("_t") if t is None else F.count_if(rounded < t)).alias(f"b{i}") for i, t in enumerate(distinct)],
    ).first()
    starts, start = {}, 0
    for i, t in enumerate(distinct):
        starts[t] = start - size[f"b{i}"]
        start += size[f"n{i}"]
    places = {starts[times[p]] + p: p for p in inside}
    ranked = global_rank(keys.filter(tied), ["_t", "_k"], "_r").filter(F.col("_r").isin(list(places)))
    return {places[r["_r"]]: (r["_t"], r["_k"]) for r in ranked.collect()}


def temporal_split(
    df: DataFrame, train: float = 0.70, validation: float = 0.15, time: str = "created_at", key: str = "order_id"
) -> DataFrame:
    """Adds ``split`` by position in (time, key) order.

    Two positions decide everything. They are found by counting scans over the times, so the
    rows themselves are neither sorted nor moved: each is compared with two boundary keys.
    """
    keys = df.select(F.unix_micros(quoted(time)).alias("_t"), quoted(key).alias("_k"))
    size = keys.agg(F.count("*").alias("rows"), F.count("_t").alias("known")).first()
    rows, known = size["rows"], size["known"]
    micros = F.unix_micros(quoted(time))

    if rows == 0:
        return df.withColumn("split", F.lit(None).cast("string"))
    cuts = [int(rows * train), int(rows * (train + validation))]
    edges = _boundaries(keys, cuts, known, rows)

    def before(position: int) -> Column:
        if position >= rows:
            return F.lit(True)
        at, k = edges[position]
        if at is None:
            return micros.isNotNull() | (quoted(key) < F.lit(k))
        return F.coalesce((micros < at) | ((micros == at) & (quoted(key) < F.lit(k))), F.lit(False))

    return df.withColumn(
        "split", F.when(before(cuts[0]), "train").when(before(cuts[1]), "validation").otherwise("test"))
