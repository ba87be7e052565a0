"""Boosted trees over binned rows.

Spark's own learner keeps a dense vector of doubles per row and walks it value by value for every level of every tree. Here
a row is a few code words: numbers are cut into at most ``BINS`` bins, as there, and features with few bins share a word, so
one count over a word serves all its features. A level of a tree is one pass over the words; tasks hand back sums per node
and bin, the driver chooses the splits. The rows are held once, with the scores of the trees so far.

Trees, loss and sampling are those of Spark's learner: the first tree follows the labels, each later one four times the
label over 1 + exp(2 label score); splits lower the variance most; leaves hold means. The sample of a tree follows a hash
of the row's key. The result is a model of Spark's own class.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32
WORD = 1024  # codes of a word that several features share
CHUNK = 1 << 16  # rows counted at once: keys and sums stay in a processor's cache
BLOCK_ROWS, PART_ROWS = 1 << 18, 1 << 23
ONE_TASK_ROWS = 400_000  # up to it one task grows all trees: a job a level would take longer than the counting
COLLECTED_PARTS = 64  # beyond it the sums of tasks meet in a tree first
MOST_CELLS = 1 << 22  # sums of one level; deeper or wider trees go to Spark's learner
LEAST_GAIN = 1e-12


@dataclass
class Layout:
    """Thresholds of the numbers, values of the texts, and the features that share a word."""

    edges: list[np.ndarray]
    labels: list[list[str]]
    words: list[list[int]]

    @cached_property
    def sizes(self) -> list[int]:
        return [len(e) + 1 for e in self.edges] + [max(1, len(v)) for v in self.labels]

    def width(self, word: int) -> int:
        return int(np.prod([self.sizes[f] for f in self.words[word]]))

    def bins(self, feature: int) -> tuple[int, np.ndarray]:
        """Word of a feature, and its bin in each code of the word."""
        word = next(w for w, fs in enumerate(self.words) if feature in fs)
        stride = 1
        for f in self.words[word]:
            if f == feature:
                break
            stride *= self.sizes[f]
        return word, np.arange(self.width(word)) // stride % self.sizes[feature]


def shared_words(sizes: list[int], most: int = WORD) -> list[list[int]]:
    """Features dealt to words, wide ones first, each to the fullest word that still holds it."""
    words: list[list[int]] = []
    full: list[int] = []
    for f in sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)):
        fits = [w for w in range(len(words)) if full[w] * sizes[f] <= most]
        if fits:
            w = max(fits, key=lambda w: full[w])
            words[w].append(f)
            full[w] *= sizes[f]
        else:
            words.append([f])
            full.append(sizes[f])
    return words


def layout_of(rows: DataFrame, numbers: list[str], labels: list[list[str]]) -> Layout:
    """Thresholds between all values of a column with few of them, else at its quantiles."""
    points = [i / BINS for i in range(1, BINS)]
    seen = rows.agg(
        *[F.percentile_approx(c, points, 10_000).alias(f"q{i}") for i, c in enumerate(numbers)],
        *[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(numbers)],
    ).first()
    few = [i for i in range(len(numbers)) if seen[f"n{i}"] <= 2 * BINS]
    values: dict[int, list[float]] = {i: [] for i in few}
    if few:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(numbers[i]).alias("v")) for i in few])
        for r in rows.select(F.inline(pairs)).distinct().collect():
            values[r["i"]].append(r["v"])
    edges = []
    for i in range(len(numbers)):
        v = np.unique(np.array(values.get(i, []), np.float64))
        if 0 < len(v) <= BINS:
            low, high = v[:-1], v[1:]
            middle = low + (high - low) / 2
            edges.append(np.where((middle >= low) & (middle < high), middle, low))
        else:
            edges.append(np.unique(np.array(seen[f"q{i}"] or [], np.float64)))
    sizes = Layout(edges, labels, []).sizes
    return Layout(edges, labels, shared_words(sizes))


def coded_blocks(
    rows: DataFrame, numbers: list[str], texts: list[str], label: str, key: Column, layout: Layout, seed: int, parts: int,
) -> RDD:
    """Blocks (words, label is 1, hash of the key, scores of 0), dealt evenly to ``parts`` tasks."""
    sizes, words = layout.sizes, layout.words
    kinds = [np.uint16 if layout.width(w) <= 1 << 16 else np.uint32 for w in range(len(words))]

    def coded(batches):
        import pickle

        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            found = [np.searchsorted(e, batch.column(i).to_numpy(zero_copy_only=False)) for i, e in enumerate(layout.edges)]
            for i, values in enumerate(layout.labels):
                at = pc.index_in(batch.column(len(layout.edges) + i), value_set=pa.array(values, pa.string()))
                found.append(at.to_numpy(zero_copy_only=False))
            codes = []
            for word, kind in zip(words, kinds):
                code = np.zeros(batch.num_rows, np.int64)
                for f in reversed(word):
                    code = code * sizes[f] + found[f]
                codes.append(code.astype(kind))
            y = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).astype(np.uint8)
            h = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps((codes, y, h), 5)], pa.binary())})

    def joined(found):
        import pickle

        held, count = [], 0

        def block():
            codes = [np.concatenate([b[0][w] for b in held]) for w in range(len(words))]
            return codes, np.concatenate([b[1] for b in held]), np.concatenate([b[2] for b in held]), np.zeros(count)

        for r in found:
            held.append(pickle.loads(r[0]))
            count += len(held[-1][1])
            if count >= BLOCK_ROWS:
                yield block()
                held, count = [], 0
        if held:
            yield block()

    hashed = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 32)).cast("bigint")
    wide = rows.select(
        *[F.col(c).cast("double") for c in numbers], *[F.col(c).cast("string") for c in texts],
        F.col(label).cast("int").alias("_y"), hashed.alias("_h"))
    return wide.mapInArrow(coded, "block binary").repartition(parts).rdd.mapPartitions(joined, True)


def sampled(h: np.ndarray, tree: int, rate: float) -> np.ndarray:
    """Rows of a tree's sample: the hash of the key, mixed anew for each tree."""
    x = h ^ np.uint32((tree * 0x9E3779B1 + 0x7F4A7C15) & 0xFFFFFFFF)
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(times)
    x ^= x >> np.uint32(16)
    return x < np.uint32(min(rate * 2.0**32, 2.0**32 - 1))


def turns(levels: list[tuple[np.ndarray, np.ndarray]], layout: Layout) -> list[list[tuple[int, int, np.ndarray]]]:
    """Per level (word, its width, 1 where a node's rows with that code go right)."""
    out = []
    for feature, cut in levels:
        tables: dict[int, np.ndarray] = {}
        for node in np.flatnonzero(feature >= 0):
            word, bins = layout.bins(int(feature[node]))
            table = tables.setdefault(word, np.zeros((len(feature), layout.width(word)), np.int64))
            table[node] = bins > cut[node] if feature[node] < len(layout.edges) else bins == cut[node]
        out.append([(w, t.shape[1], t.ravel()) for w, t in sorted(tables.items())])
    return out


def nodes_of(codes: list[np.ndarray], tables) -> np.ndarray:
    node = np.zeros(len(codes[0]), np.int64)
    for level in tables:
        right = None
        for word, width, table in level:
            way = table[node * width + codes[word]]
            right = way if right is None else right + way
        node = 2 * node if right is None else 2 * node + right
    return node


def pull(y: np.ndarray, score: np.ndarray, first: bool) -> np.ndarray:
    """What a tree follows."""
    sign = 2.0 * y - 1.0
    return sign if first else 4.0 * sign / (1.0 + np.exp(2.0 * sign * score))


def level_sums(blocks, layout: Layout, levels, tree: int, rate: float, weights: tuple[float, float]) -> np.ndarray:
    """(rows, weight, weighted pull) per node and bin, the bins of all features side by side, over sampled rows."""
    tables, nodes = turns(levels, layout), 1 << len(levels)
    widths = [layout.width(w) for w in range(len(layout.words))]
    even = weights[0] == weights[1]
    sums = [np.zeros((2 if even else 3, (nodes + 1) * g)) for g in widths]
    for codes, y, h, score in blocks:
        for at in range(0, len(y), CHUNK):
            part = slice(at, at + CHUNK)
            words, own = [c[part] for c in codes], y[part]
            w = np.where(own == 1, weights[1], weights[0])
            g = w * pull(own, score[part], tree == 0)
            node = nodes_of(words, tables)
            if rate < 1.0:
                node = np.where(sampled(h[part], tree, rate), node, nodes)
            for i, width in enumerate(widths):
                k = node * width + words[i]
                sums[i][0] += np.bincount(k, minlength=(nodes + 1) * width)
                sums[i][1] += np.bincount(k, g, (nodes + 1) * width)
                if not even:
                    sums[i][2] += np.bincount(k, w, (nodes + 1) * width)
    cells: list[np.ndarray | None] = [None] * len(layout.sizes)
    for i, word in enumerate(layout.words):
        shape = [layout.sizes[f] for f in reversed(word)]
        whole = sums[i].reshape(len(sums[i]), nodes + 1, *shape)[:, :nodes]
        for place, f in enumerate(reversed(word)):
            cells[f] = whole.sum(axis=tuple(2 + k for k in range(len(shape)) if k != place))
    out = np.concatenate(cells, axis=2)
    rows, g, w = out[0], out[1], out[0] * weights[0] if even else out[2]
    return np.stack([rows, w, g])


def best_splits(cells: np.ndarray, layout: Layout, least_rows: int) -> list[tuple | None]:
    """Per node (gain, feature, cut, left sums, right sums) of the split that lowers the variance most; the first
    of equal ones."""
    sizes, out = layout.sizes, []
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for node in range(cells.shape[1]):
        total = cells[:, node, : sizes[0]].sum(axis=1)
        best = None
        for f in range(len(sizes)):
            own = cells[:, node, starts[f]:starts[f + 1]]
            if f < len(layout.edges):
                left = np.cumsum(own, axis=1)[:, :-1]
                right = total[:, None] - left
            else:
                right = own
                left = total[:, None] - right
            ok = (left[0] >= least_rows) & (right[0] >= least_rows) & (left[1] > 0) & (right[1] > 0)
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (left[2] ** 2 / left[1] + right[2] ** 2 / right[1] - total[2] ** 2 / total[1]) / total[1]
            gain = np.where(ok, gain, -np.inf)
            cut = int(np.argmax(gain))
            if gain[cut] > LEAST_GAIN and (best is None or gain[cut] > best[0]):
                best = (float(gain[cut]), f, cut, left[:, cut], right[:, cut])
        out.append(best)
    return out


@dataclass
class Tree:
    """``levels``: feature and cut of each node, -1 where a node stays whole; ``sums`` and ``gains`` by level."""

    levels: list[tuple[np.ndarray, np.ndarray]]
    sums: list[np.ndarray]
    gains: list[np.ndarray]

    def leaves(self) -> np.ndarray:
        """Mean pull at the last level; nodes that stay whole pass theirs to the left."""
        rows, w, g = self.sums[-1].T
        return np.divide(g, w, out=np.zeros(len(g)), where=w > 0)


def scored_blocks(blocks, trees: list[tuple], layout: Layout):
    """Blocks with the scores of (levels, weighted leaves) added."""
    ready = [(turns(levels, layout), leaves) for levels, leaves in trees]
    for codes, y, h, score in blocks:
        score = score.copy()
        for at in range(0, len(y), CHUNK):
            part = slice(at, at + CHUNK)
            words = [c[part] for c in codes]
            for tables, leaves in ready:
                score[part] += leaves[nodes_of(words, tables)]
        yield codes, y, h, score


def _summed(found: RDD) -> np.ndarray:
    if found.getNumPartitions() > COLLECTED_PARTS:
        return found.treeReduce(lambda a, b: a + b)
    return np.sum(found.collect(), axis=0)


def grown_tree(sums_of: Callable[[list], np.ndarray], layout: Layout, depth: int, least_rows: int) -> Tree:
    """``sums_of`` gives the sums below the levels so far."""
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    sums, gains = [], []
    for d in range(depth):
        cells = sums_of(list(levels))
        if d == 0:
            sums.append(cells[:, :, : layout.sizes[0]].sum(axis=2).T)
        splits = best_splits(cells, layout, least_rows)
        feature, cut = np.full(1 << d, -1), np.full(1 << d, -1)
        gain, below = np.zeros(1 << d), np.zeros((2 << d, 3))
        for node, s in enumerate(splits):
            below[2 * node] = sums[d][node]
            if s:
                gain[node], feature[node], cut[node], below[2 * node], below[2 * node + 1] = s
        levels.append((feature, cut))
        gains.append(gain)
        sums.append(below)
        if (feature < 0).all():
            break
    return Tree(levels, sums, gains)


def boosted(
    blocks: RDD, layout: Layout, trees: int, step: float, depth: int, least_rows: int, rate: float,
    weights: tuple[float, float] = (1.0, 1.0),
) -> list[Tree]:
    """Rows of one part are few, and one task grows all trees; else each level is a job over all parts. The scores are then
    those of an earlier held state with the trees since, so that few states build on each other."""
    def step_of(t: int, tree: Tree) -> tuple:
        return tree.levels, (1.0 if t == 0 else step) * tree.leaves()

    if blocks.getNumPartitions() == 1:
        def all_of(held):
            held, out = list(held), []
            for t in range(trees):
                out.append(grown_tree(lambda v, t=t: level_sums(held, layout, v, t, rate, weights), layout, depth, least_rows))
                held = list(scored_blocks(held, [step_of(t, out[-1])], layout))
            return [out]

        return blocks.mapPartitions(all_of, True).collect()[0]

    kept = StorageLevel.MEMORY_AND_DISK
    stride = max(1, int(np.ceil(np.sqrt(trees))))
    base = state = blocks.persist(kept)
    out: list[Tree] = []
    pending: list[tuple] = []
    try:
        for t in range(trees):
            before = state
            if pending:
                added = list(pending)
                state = base.mapPartitions(lambda b, added=added: scored_blocks(b, added, layout), True).persist(kept)

            def sums_of(levels: list, t: int = t, state: RDD = state) -> np.ndarray:
                return _summed(state.mapPartitions(lambda b: [level_sums(b, layout, levels, t, rate, weights)], True))

            tree = grown_tree(sums_of, layout, depth, least_rows)
            if before not in (base, state):
                before.unpersist()
            if t and t % stride == 0:
                base.unpersist()
                base, pending = state, []
            out.append(tree)
            pending.append(step_of(t, tree))
    finally:
        for held in (base, state):
            held.unpersist()
    return out


def as_model(spark, trees: list[Tree], layout: Layout, step: float, estimator: GBTClassifier) -> GBTClassificationModel:
    """Spark's model of these trees, over the numbers followed by one place per text value. Of the variance statistics
    only rows, weight and sum are known; the sums of squares are NaN."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    # Each name is looked up once: a lookup costs as much as making a node.
    leaf, inner, threshold = (getattr(jvm.org.apache.spark.ml.tree, n) for n in ("LeafNode", "InternalNode", "ContinuousSplit"))
    variance, cutout = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator, jvm.java.util.Arrays.copyOfRange
    first = np.concatenate([[0], np.cumsum([len(v) for v in layout.labels])]) + len(layout.edges)
    sums = np.concatenate([s for tree in trees for s in tree.sums])
    flat = np.stack([sums[:, 1], sums[:, 2], np.full(len(sums), np.nan)], 1).astype(">f8")
    numbers = gateway.new_array(jvm.double, flat.size)
    jvm.java.nio.ByteBuffer.wrap(bytearray(flat.tobytes())).asDoubleBuffer().get(numbers)

    def node(tree: Tree, level: int, at: int, starts: list[int]):
        rows, weight, total = (float(x) for x in tree.sums[level][at])
        place = 3 * (starts[level] + at)
        held = variance(cutout(numbers, place, place + 3), int(rows))
        mean = total / weight if weight else 0.0
        if level == len(tree.levels) or tree.levels[level][0][at] < 0:
            return leaf(mean, float("nan"), held)
        feature, cut = int(tree.levels[level][0][at]), int(tree.levels[level][1][at])
        if feature < len(layout.edges):
            split = threshold(feature, float(layout.edges[feature][cut]))
        else:
            split = threshold(int(first[feature - len(layout.edges)]) + cut, 0.5)
        left, right = node(tree, level + 1, 2 * at, starts), node(tree, level + 1, 2 * at + 1, starts)
        return inner(mean, float("nan"), float(tree.gains[level][at]), left, right, split, held)

    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    made, steps = gateway.new_array(kind, len(trees)), gateway.new_array(jvm.double, len(trees))
    start = 0
    for i, tree in enumerate(trees):
        starts = list(start + np.cumsum([0] + [len(s) for s in tree.sums]))
        made[i] = kind(f"tree_{i}", node(tree, 0, 0, [int(x) for x in starts]), int(first[-1]))
        steps[i] = step if i else 1.0
        start = int(starts[-1])
    java = jvm.org.apache.spark.ml.classification.GBTClassificationModel(estimator.uid, made, steps, int(first[-1]), 2)
    estimator._to_java().copyValues(java, jvm.org.apache.spark.ml.param.ParamMap.empty())
    return estimator._copyValues(GBTClassificationModel(java))


def fit_boosted(
    rows: DataFrame, numbers: list[str], texts: list[str], labels: list[list[str]], label: str, key: Column,
    weights: tuple[float, float], estimator: GBTClassifier, seed: int, count: int,
) -> GBTClassificationModel | None:
    """Model with the parameters of ``estimator``; None if its trees are too deep or too wide for sums on the driver.
    ``rows`` have no missing values, ``labels`` hold all values of ``texts``."""
    layout = layout_of(rows, numbers, labels)
    depth = estimator.getMaxDepth()
    if sum(layout.width(w) for w in range(len(layout.words))) << depth > MOST_CELLS:
        return None
    spark = rows.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    parts = 1 if count <= ONE_TASK_ROWS else tasks * -(-count // (PART_ROWS * tasks))
    blocks = coded_blocks(rows, numbers, texts, label, key, layout, seed, parts)
    trees = boosted(
        blocks, layout, estimator.getMaxIter(), estimator.getStepSize(), depth,
        estimator.getMinInstancesPerNode(), estimator.getSubsamplingRate(), weights)
    return as_model(spark, trees, layout, estimator.getStepSize(), estimator)
