"""Multi-label linear heads, fitted on executors: one sigmoid a label, all at once.

Each step needs the sums of the gradients over all rows. Tasks sum them over Arrow batches and send one small matrix each, as numbers by place, which Spark
adds up by partial sums; the driver gets as many numbers as the heads have. The curvature of all labels is bounded by a quarter of the
features' second moments, which are summed once, so a step solves one system of equations and can't overshoot. A part of the rows, by hash,
only validates; the heads of the best validated step are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialens.functions.frames import ship, small_side
from medialens.functions.metrics import logistic
from medialens.functions.vectors import dot
from medialens.operators.graph import stored

RIDGE, STEPS, PATIENCE, LEAST_GAIN = 1e-3, 100, 3, 1e-5
#: Of a hundred rows, so many validate.
VALIDATION = 20


@dataclass
class Heads:
    """labels; weights (label, feature, the constant last); the mean loss of each step on the training and the other part; the step that was kept."""

    labels: list[str]
    weights: np.ndarray
    losses: list[tuple[float, float]] = field(default_factory=list)
    step: int = 0


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    x = np.asarray(batch["v"].flatten()).reshape(n, -1)
    return np.hstack([x, np.ones((n, 1))]), np.asarray(batch["hot"].flatten()).reshape(n, -1)


def _sums(batches: Iterator[pa.RecordBatch], what) -> Iterator[pa.RecordBatch]:
    """(place, value) of the sum of what(x, y) over a task's batches."""
    total = None
    for batch in batches:
        if batch.num_rows:
            part = what(*_arrays(batch))
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["place", "value"])


def _summed(rows: DataFrame, what, size: int) -> np.ndarray:
    sums = rows.select("v", "hot").mapInArrow(partial(_sums, what=what), "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for r in sums.collect():
        out[r.place] = r.value
    return out


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.append(x.T @ x, len(x))


def _gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ weights.T
    loss = (np.logaddexp(0, z) - y * z).sum()
    return np.concatenate([((1 / (1 + np.exp(-z)) - y).T @ x).ravel(), [loss, len(x)]])


def train(rows: DataFrame, labels: Sequence[str], vec: str = "v", hot: str = "hot", key: str = "id", ridge: float = RIDGE, steps: int = STEPS, patience: int = PATIENCE, validation: int = VALIDATION, least_gain: float = LEAST_GAIN) -> Heads:
    """Heads of the labels from rows: key, vec (features) and hot (for each label whether the row has it, as multi_hot() makes it).

    The loss is the mean over rows of the labels' cross entropies, plus ridge / 2 times the squared weights (constants apart). It ends when the
    validation part has not gained for `patience` steps, or the training loss falls by less than `least_gain` of itself. Rows with a null in either column are left
    out; without rows all weights are 0, and without a validation part the last step counts.
    """
    ship(rows.sparkSession)
    plain = rows.filter(F.col(vec).isNotNull() & F.col(hot).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"), F.transform(F.col(hot), lambda x: x.cast("int").cast("double")).alias("hot"), (F.pmod(F.xxhash64(F.col(key), F.lit("validation")), F.lit(100)) < validation).alias("validates"))
    plain = stored(plain.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.forall("hot", lambda x: x.isNotNull())))
    fits, other = plain.filter("NOT validates"), plain.filter("validates")
    head = fits.select(F.size("v").alias("n")).first()
    if head is None:
        return Heads(list(labels), np.zeros((len(labels), 1)))
    size, count = head.n + 1, len(labels)
    moments = _summed(fits, _moments, size * size + 1)
    n = moments[-1]
    held = np.diag([ridge] * (size - 1) + [0.0])
    curvature = 0.25 * moments[:-1].reshape(size, size) / n + held + 1e-9 * np.eye(size)
    weights = np.zeros((count, size))
    out, best, losses = Heads(list(labels), weights), np.inf, []
    for step in range(steps):
        sums = _summed(fits, partial(_gradient, weights=weights), count * size + 2)
        penalty = ridge / 2 * (weights[:, :-1] ** 2).sum()
        there = _summed(other, partial(_gradient, weights=weights), count * size + 2)
        losses.append((sums[-2] / n + penalty, there[-2] / there[-1] if there[-1] else sums[-2] / n))
        if losses[-1][1] < best:
            best, out.weights, out.step = losses[-1][1], weights, step
        if step - out.step >= patience or step and losses[-2][0] - losses[-1][0] < least_gain * abs(losses[-2][0]):
            break
        gradient = sums[:-2].reshape(count, size) / n + weights @ held
        weights = weights - np.linalg.solve(curvature, gradient.T).T
    out.losses = losses
    return out


def head_table(spark, heads: Heads) -> DataFrame:
    """label_key, weights, bias."""
    rows = [(k, [float(x) for x in w[:-1]], float(w[-1])) for k, w in zip(heads.labels, heads.weights, strict=True)]
    return spark.createDataFrame(rows, "label_key string, weights array<double>, bias double")


def probabilities(rows: DataFrame, heads: DataFrame, key: str, vec: str) -> DataFrame:
    """key, label_key, p of each row and head (label_key, weights, bias)."""
    z = dot(F.col(vec), F.col("weights")) + F.col("bias")
    return rows.select(key, F.col(vec).cast("array<double>").alias(vec)).crossJoin(small_side(heads)).select(key, "label_key", logistic(z).alias("p"))


def scored_pairs(rows: DataFrame, heads: DataFrame, truth: DataFrame, key: str, vec: str) -> DataFrame:
    """key, label_key, p, truth for the sweeps: truth (key, label_key, truth) has the labels that people set; others do not count."""
    return probabilities(rows, heads, key, vec).join(truth.select(key, "label_key", "truth").filter("truth IS NOT NULL"), [key, "label_key"])
