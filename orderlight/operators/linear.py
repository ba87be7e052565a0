"""Logistic regressions by Newton's method, many models in the same passes.

The penalized likelihood is that of Spark's own learner (mean weighted loss plus half the penalty times the squared weights
of the scaled features; the intercept is free), so the optimum is the same. A pass over the rows gives the gradient and the
curvature of every model that is still open; a handful of passes suffices where a learner that only sees gradients takes
dozens for each model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.sql import DataFrame

TOLERANCE = 1e-10  # of the mean loss: what a further step could still gain
MOST_WIDTH = 400  # features whose curvature is kept; wider models go to Spark's learner
HALVINGS = 30
ROWS = 1 << 13  # rows encoded at once
COLLECTED_PARTS = 64


@dataclass
class Task:
    """One model: its rows (a 0/1 column), missing values, encoding, class weights and penalty."""

    rows: str
    fill: dict
    mean: np.ndarray
    scale: np.ndarray
    labels: list[list[str]]
    weights: tuple[float, float]
    penalty: float
    iterations: int

    @property
    def width(self) -> int:
        return len(self.mean) + sum(len(v) for v in self.labels)

    def encoding(self) -> str:
        """Models with the same text share the encoded rows of a pass."""
        return repr((self.rows, sorted(self.fill.items()), self.mean.tolist(), self.scale.tolist(), self.labels))


def _encoded(batch, task: Task, numbers: list[str], texts: list[str], at: dict[str, int]) -> np.ndarray:
    """Scaled numbers, one column per text value, and ones for the intercept."""
    import pyarrow as pa
    import pyarrow.compute as pc

    out = np.zeros((batch.num_rows, task.width + 1))
    for i, c in enumerate(numbers):
        v = batch.column(at[c]).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        out[:, i] = (np.where(np.isnan(v), float(task.fill[c]), v) - task.mean[i]) * task.scale[i]
    start = len(numbers)
    for c, values in zip(texts, task.labels):
        found = pc.index_in(batch.column(at[c]).cast(pa.string()).fill_null(str(task.fill[c])), value_set=pa.array(values, pa.string()))
        code = found.fill_null(-1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(code >= 0)
        out[known, start + code[known]] = 1.0
        start += len(values)
    out[:, -1] = 1.0
    return out


def _slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Weight, loss, gradient and curvature, side by side."""
    z = x @ beta
    loss = np.logaddexp(0.0, z) - y * z
    p = 0.5 * (1.0 + np.tanh(0.5 * z))
    bent = x * np.sqrt(w * p * (1.0 - p))[:, None]
    return np.concatenate([[w.sum(), w @ loss], x.T @ (w * (p - y)), (bent.T @ bent).ravel()])


def _pass(table: DataFrame, tasks: list[Task], betas: dict[int, np.ndarray], numbers: list[str], texts: list[str], label: str) -> dict[int, np.ndarray]:
    """Sums of :func:`_slopes` for the models ``betas``."""
    shared: dict[str, list[int]] = {}
    for i in betas:
        shared.setdefault(tasks[i].encoding(), []).append(i)
    flags = list(dict.fromkeys(tasks[i].rows for i in betas))
    columns = [*numbers, *texts, label, *flags]
    at = {c: i for i, c in enumerate(columns)}
    used = {i: tasks[i] for i in betas}

    def sums(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        total: dict[int, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                for members in shared.values():
                    first = used[members[0]]
                    own = batch.filter(pc.equal(batch.column(at[first.rows]), 1))
                    if not own.num_rows:
                        continue
                    x = _encoded(own, first, numbers, texts, at)
                    y = own.column(at[label]).to_numpy(zero_copy_only=False).astype(np.float64)
                    for i in members:
                        w = np.where(y == 1.0, used[i].weights[1], used[i].weights[0])
                        found = _slopes(x, y, w, betas[i])
                        total[i] = total[i] + found if i in total else found
        yield pa.RecordBatch.from_pydict({
            "model": pa.array(list(total), pa.int64()), "sums": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    # A task hands over one row a model: its width squared numbers. Those of many tasks meet before the driver.
    found = table.select(*columns).mapInArrow(sums, "model BIGINT, sums BINARY").rdd.map(lambda r: (r[0], np.frombuffer(r[1])))
    if found.getNumPartitions() > COLLECTED_PARTS:
        return found.reduceByKey(lambda a, b: a + b, len(used)).collectAsMap()
    out: dict[int, np.ndarray] = {}
    for i, own in found.collect():
        out[i] = out[i] + own if i in out else own
    return out


def newton(table: DataFrame, tasks: list[Task], numbers: list[str], texts: list[str], label: str) -> list[np.ndarray]:
    """Weights of the scaled features and the intercept of each model. A step that does not lower the loss is halved; a
    model is done when a further step can gain next to nothing, or after its iterations."""
    best = [np.zeros(t.width + 1) for t in tasks]
    trial = {i: b for i, b in enumerate(best)}
    state: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
    step: dict[int, np.ndarray] = {}
    share, steps = dict.fromkeys(trial, 1.0), dict.fromkeys(trial, 0)
    while trial:
        found, again = _pass(table, tasks, trial, numbers, texts, label), {}
        for i, beta in trial.items():
            d, penalty = tasks[i].width, np.append(np.full(tasks[i].width, tasks[i].penalty), 0.0)
            weight, loss = found[i][:2]
            value = loss / weight + 0.5 * penalty @ beta**2
            if i in state and not value <= state[i][0]:
                share[i] /= 2
                if share[i] > 2.0**-HALVINGS:
                    again[i] = best[i] - share[i] * step[i]
                continue
            gradient = found[i][2:d + 3] / weight + penalty * beta
            curved = found[i][d + 3:].reshape(d + 1, d + 1) / weight + np.diag(penalty)
            best[i], state[i] = beta, (value, gradient, curved)
            # Columns without any spread, or the intercept of columns that always add up to one, have no slope of their own.
            step[i] = np.linalg.lstsq(curved, gradient, rcond=1e-13)[0]
            share[i] = 1.0
            if 0.5 * gradient @ step[i] > TOLERANCE and steps[i] < tasks[i].iterations:
                steps[i] += 1
                again[i] = beta - step[i]
        trial = again
    return best


def as_model(spark, beta: np.ndarray, estimator: LogisticRegression) -> LogisticRegressionModel:
    """Spark's model with these weights and the parameters of ``estimator``."""
    jvm = spark._jvm
    weights = spark.sparkContext._gateway.new_array(jvm.double, len(beta) - 1)
    for i, b in enumerate(beta[:-1].tolist()):
        weights[i] = b
    vector = jvm.org.apache.spark.ml.linalg.DenseVector(weights)
    java = jvm.org.apache.spark.ml.classification.LogisticRegressionModel(estimator.uid, vector, float(beta[-1]))
    estimator._to_java().copyValues(java, jvm.org.apache.spark.ml.param.ParamMap.empty())
    return estimator._copyValues(LogisticRegressionModel(java))
