"""Embedding near-duplicates through an inverted multi-index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlight.llm.base import smallest_hashes, table
from orderlight.llm.components import connected, forest
from orderlight.session import small_side, stored

COSINE = 0.93
SAMPLE = 20_000  # vectors that the codebooks are fitted on, at most
RECALL = 0.99  # of links, that the number of visited cells is set for
HOT = 2048  # vectors of one cell that a task compares with as many others


def usable(vector):
    """Whether a vector can be linked: not null, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def codebook(points: np.ndarray, size: int, rounds: int = 10) -> np.ndarray:
    """Centres of ``points`` by k-means, started from evenly spaced points."""
    centres = points[np.linspace(0, len(points) - 1, min(size, len(points))).astype(np.int64)].copy()
    for _ in range(rounds):
        near = nearest(points, centres).argmin(axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, without the points' own norms."""
    return (centres * centres).sum(axis=1) - 2 * points @ centres.T


def traversal(vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray], visits: int) -> np.ndarray:
    """The ``visits`` nearest cells of each vector in the product grid, nearest first: the multi-sequence order.

    Both halves' centres are ranked; the cell of ranks (i, j) has (i+1)(j+1) cells that are no farther, so only those
    with a product of at most ``visits`` can be among the first ``visits``."""
    half = books[0].shape[1]
    one, two = nearest(vectors[:, :half], books[0]), nearest(vectors[:, half:], books[1])
    first, second = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
    i, j = np.array([(i, j) for i in range(min(visits, len(books[0]))) for j in range(min(visits // (i + 1), len(books[1])))]).T
    total = np.take_along_axis(one, first[:, i], 1) + np.take_along_axis(two, second[:, j], 1)
    order = np.argsort(total, axis=1, kind="stable")[:, :visits]
    cell = first[:, i] * len(books[1]) + second[:, j]
    return np.take_along_axis(cell, order, 1).astype(np.int32)


def visits_for(sample: np.ndarray, books, cosine: float, recall: float, most: int = 512) -> int:
    """Cells to visit so that ``recall`` of links at the least cosine are met from one end or the other: measured
    on partners that are made at just that cosine from sample vectors, the hardest there are. Where ``most`` cells
    don't reach it, twice as many are tried, up to the whole grid."""
    rng = np.random.default_rng(5)
    some = sample[rng.permutation(len(sample))[:1000]]
    side = rng.standard_normal(some.shape)
    side -= (side * some).sum(axis=1, keepdims=True) * some
    norm = np.sqrt((side * side).sum(axis=1, keepdims=True))
    partner = cosine * some + math.sqrt(1 - cosine**2) * side / np.maximum(norm, 1e-300)
    cells = len(books[0]) * len(books[1])
    while True:
        most = min(most, cells)
        a, b = (traversal(v, books, most) for v in (some, partner))
        rank = lambda lists, goal: np.where((lists == goal[:, None]).any(axis=1), (lists == goal[:, None]).argmax(axis=1), most)  # noqa: E731,B023
        need = np.quantile(np.minimum(rank(a, b[:, 0]), rank(b, a[:, 0])), recall, method="higher")
        if need < most or most == cells:
            return int(min(cells, need + 1))
        most *= 2


def fit(classes: DataFrame, dim: int, n: int, cosine: float = COSINE, recall: float = RECALL, rows: int = SAMPLE):
    """Codebooks of both halves from at most ``rows`` vectors, and the number of cells to visit. The grid has about
    one cell for 32 vectors of a label on average, so cells stay small as the table grows."""
    sample = smallest_hashes(classes.select("cid", "embedding"), F.xxhash64("cid"), rows).toPandas()["embedding"]
    sample = unit(np.array(sample.tolist(), np.float64).reshape(-1, dim))
    size = max(2, min(1024, math.ceil(math.sqrt(n / 32))))
    half = dim // 2
    books = codebook(sample[:, :half], size), codebook(sample[:, half:], size)
    return books, visits_for(sample, books, cosine, recall)


def _placed(classes: DataFrame, books, visits: int) -> DataFrame:
    schema = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("label", pa.string()), ("vec", pa.binary()), ("cells", pa.list_(pa.int32()))])

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                v = unit(np.array(batch.column("embedding").to_pylist(), np.float64))
                cells = traversal(v, books, visits)
                vec = [x.tobytes() for x in v]
                yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("n"), batch.column("label"), pa.array(vec, pa.binary()), pa.array(list(cells), pa.list_(pa.int32()))], schema=schema)

    return classes.mapInArrow(place, "cid long, n long, label string, vec binary, cells array<int>")


def _verify(cosine: float):
    """Whole cells -> rows (a, b): b null: ``add`` links of a; else a link of a spanning forest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("add", pa.int64())])

    def work(batches):
        rows = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not rows:
            return
        rows = pa.concat_tables(rows)
        cell, role, cid, n = (rows.column(c).to_numpy() for c in ("cell", "role", "cid", "n"))
        label, part = rows.column("label").to_pylist(), rows.column("part").to_numpy()
        vec = np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.float64).reshape(len(cid), -1)
        cells = np.array(rows.column("cells").to_pylist(), np.int32)
        nodes, place = np.unique(cid, return_inverse=True)
        root, found = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
        groups: dict[tuple, list] = {}
        for i, k in enumerate(zip(label, cell.tolist(), part.tolist())):
            groups.setdefault(k, []).append(i)
        for members in groups.values():
            members = np.array(members)
            home, asks = members[role[members] != 1], members[role[members] != 0]
            for q in range(0, len(asks), 1024):
                for r in range(0, len(home), 1024):
                    one, two = asks[q : q + 1024], home[r : r + 1024]
                    x, y = np.nonzero(vec[one] @ vec[two].T >= cosine)
                    x, y = one[x], two[y]
                    # A pair is met in both cells if each end visits the other's; the smaller cell, or id, has it.
                    same = cells[x, 0] == cells[y, 0]
                    back = ~same & (cells[x, 0] < cells[y, 0]) & (cells[y] == cells[x, 0][:, None]).any(axis=1)
                    keep = np.where(same, cid[x] < cid[y], ~back)
                    x, y = x[keep], y[keep]
                    if len(x):
                        np.add.at(found, place[x], n[y])
                        np.add.at(found, place[y], n[x])
                        every = np.arange(len(nodes))
                        root = forest(len(nodes), np.concatenate([place[x], every]), np.concatenate([place[y], root]))
        tied, some = np.flatnonzero(root != np.arange(len(nodes))), np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([nodes[some], nodes[tied]])),
            pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(nodes[root[tied]])]),
            pa.array(np.concatenate([found[some], np.zeros(len(tied), np.int64)])),
        ], schema=schema)

    return work


def met(classes: DataFrame, dim: int, cosine: float = COSINE, hot: int = HOT, recall: float = RECALL) -> DataFrame:
    """Links among ``classes`` (cid, label, embedding, n; one dimension), as rows of ``_verify``.

    Each vector lies in its nearest cell and asks the cells it visits, of its own label only. A cell with more than
    ``hot`` vectors or askers is dealt out as a grid of blocks, so no task compares more than ``hot`` times ``hot`` and
    no vector is left out."""
    books, visits = fit(classes, dim, max(1, classes.count()), cosine, recall)
    placed = stored(_placed(classes, books, visits), "placed")
    rows = placed.select("*", F.posexplode("cells").alias("_at", "cell")).withColumn("role", F.when(F.col("_at") == 0, 2).otherwise(1)).drop("_at")
    counts = rows.groupBy("label", "cell").agg(F.count_if(F.col("role") == 2).alias("h"), F.count("*").alias("q")).where(F.col("h") > 0)
    counts = stored(counts.select(F.col("label").alias("_label"), F.col("cell").alias("_cell"), F.ceil(F.col("h") / hot).cast("int").alias("_h"), F.ceil(F.col("q") / hot).cast("int").alias("_q")), "cells")
    # Cells without a vector of the label have nobody to meet.
    rows = rows.join(small_side(counts), (F.col("label") == F.col("_label")) & (F.col("cell") == F.col("_cell")))
    own = lambda cut, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(cut)).cast("int")
    asks = F.transform(F.sequence(F.lit(0), F.col("_h") - 1), lambda i: F.struct((i * F.col("_q") + own("_q", 1)).alias("part"), F.lit(1).alias("role")))
    home = F.transform(F.sequence(F.lit(0), F.col("_q") - 1), lambda j: F.struct((own("_h", 2) * F.col("_q") + j).alias("part"), F.lit(0).alias("role")))
    once = F.array(F.struct(F.lit(0).alias("part"), F.col("role").alias("role")))
    block = F.when((F.col("_h") == 1) & (F.col("_q") == 1), once).when(F.col("role") == 1, asks).otherwise(F.concat(asks, home))
    dealt = rows.select("cid", "n", "label", "vec", "cells", "cell", F.inline(block))
    parts = max(16, math.ceil(rows.count() / 40_000))
    return dealt.repartition(parts, "label", "cell", "part").mapInArrow(_verify(cosine), "a long, b long, add long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, hot: int = HOT, recall: float = RECALL) -> DataFrame:
    """Rows of ``vectors`` (vec_id, embedding, label) -> vec_id, n_links, component_id, kept.

    Only rows of equal, non-null label and of equal dimension can link. Equal vectors of a label are one class, so any
    number of copies costs one search; they link with each other if they are usable. Unusable vectors (see ``usable``)
    link with nothing. A null vec_id counts as a link of others, never names a component unless alone, and is kept if
    its component has no other id. An empty table gives none.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    fine = usable(F.col("embedding")) & F.col("label").isNotNull()
    classes = rows.where(fine).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    links = None
    for (dim,) in classes.select(F.size("embedding")).distinct().collect():
        some = classes.where(F.size("embedding") == dim)
        found = met(some, dim, cosine, hot, recall)
        links = found if links is None else links.unionByName(found)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = stored(links, "met")
    counts = links.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("add").alias("others"))
    groups = connected(links.where("b is not null")).select(F.col("node").alias("cid"), F.col("component").alias("_group"))
    known = classes.join(counts, "cid", "left").join(groups, "cid", "left").withColumn("_group", F.coalesce("_group", "cid"))
    named = known.groupBy("_group").agg(F.min("least").alias("component_id"))
    known = known.join(named, "_group").select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("_links"), F.col("component_id").alias("_component"))
    joined = rows.join(known, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")), "left")
    component = F.coalesce("_component", "vec_id")
    return joined.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_multiindex(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
