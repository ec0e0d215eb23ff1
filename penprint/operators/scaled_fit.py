"""A Gaussian head whose deviation depends on the input, fitted by iterated weighted least squares.

Every output dimension has a mean ``x w + b`` and a logarithm of its variance ``x v + c``. One step is one aggregation:
tasks boil their rows down to the sums that weighted least squares needs for the means (rows weigh by the inverse of
their variance) and Fisher scoring for the variances. These sums depend on the dimensions only; they are added per
matrix line on the executors, and one small system per dimension is solved on the driver. A step that does not
lower the loss is halved, so the loss falls from step to step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.functions import vectors as vx

# Most steps, the fall of the mean loss that counts as settled, a little weight on every diagonal, and the range that
# the logarithm of a variance of a standardized target may take.
STEPS, SETTLED, RIDGE = 50, 1e-9, 1e-9
LOWEST, HIGHEST = -20.0, 20.0


@dataclass
class ScaledHead:
    """Per output dimension: weights and bias of the mean, and of the log-variance; the mean loss after every step."""

    weights: np.ndarray
    bias: np.ndarray
    log_weights: np.ndarray
    log_bias: np.ndarray
    losses: list[float]


def _stacked(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.stack(batch.column(column).to_numpy(zero_copy_only=False)).astype(float)


def _scales(df: DataFrame, columns: tuple[str, str]) -> list[tuple[np.ndarray, np.ndarray]]:
    vectors = df.select(*[array_to_vector(vx.as_double(F.col(c))).alias(c) for c in columns])
    parts = [Summarizer.metrics("mean", "variance").summary(F.col(c)).alias(c) for c in columns]
    row = vectors.agg(*parts).first()
    found = []
    for c in columns:
        deviation = np.sqrt(row[c]["variance"].toArray())
        found.append((row[c]["mean"].toArray(), np.where(deviation > 0, deviation, 1.0)))
    return found


class _Sums:
    """What one pass over the rows adds up, laid out as lines of one table."""

    def __init__(self, d: int, k: int):
        self.gram, self.cross = np.zeros((k, d, d)), np.zeros((k, d))
        self.info, self.score = np.zeros((d, d)), np.zeros((k, d))
        self.loss = np.zeros((1, 2))

    def parts(self) -> list[np.ndarray]:
        return [self.gram.reshape(-1, self.gram.shape[2]), self.cross, self.info, self.score, self.loss]

    def add(self, x: np.ndarray, y: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> None:
        log = np.clip(x @ spread.T, LOWEST, HIGHEST)
        weight = np.exp(-log)
        scaled = (y - x @ mean.T) ** 2 * weight
        for j in range(y.shape[1]):
            self.gram[j] += (x * weight[:, j, None]).T @ x
        self.cross += (weight * y).T @ x
        self.info += x.T @ x
        self.score += (scaled - 1).T @ x
        self.loss += [[0.5 * float((scaled + log).sum()), len(x)]]

    def lines(self) -> list[list[float]]:
        return [row.tolist() for part in self.parts() for row in part]

    @classmethod
    def of(cls, lines: list[list[float]], d: int, k: int) -> _Sums:
        sums, at = cls(d, k), 0
        for part in sums.parts():
            part[:] = lines[at : at + len(part)]
            at += len(part)
        return sums


def fit_scaled_gaussian(
    df: DataFrame, features: str = "features", target: str = "target", steps: int = STEPS, settled: float = SETTLED
) -> ScaledHead:
    """The head of highest likelihood for rows of two arrays of numbers, neither of them null."""
    (x_mean, x_scale), (y_mean, y_scale) = _scales(df, (features, target))
    d, k = len(x_mean) + 1, len(y_mean)

    def passed(mean: np.ndarray, spread: np.ndarray) -> _Sums:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = _Sums(d, k)
            for batch in batches:
                if batch.num_rows:
                    x = (_stacked(batch, features) - x_mean) / x_scale
                    sums.add(np.hstack([x, np.ones((len(x), 1))]), (_stacked(batch, target) - y_mean) / y_scale, mean, spread)
            lines = sums.lines()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int32()), pa.array(lines, pa.list_(pa.float64()))], ["line", "sums"])

        parts = df.select(features, target).mapInArrow(work, "line int, sums array<double>")
        total = parts.groupBy("line").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        return _Sums.of([r.sums for r in total.orderBy("line").collect()], d, k)

    small = RIDGE * np.eye(d)
    mean, spread = np.zeros((k, d)), np.zeros((k, d))
    sums = passed(mean, spread)
    rows = max(sums.loss[0, 1], 1.0)
    losses = [sums.loss[0, 0] / rows / k]
    for _ in range(steps):
        to_mean = np.linalg.solve(sums.gram + small * rows, sums.cross[..., None])[..., 0] - mean
        to_spread = np.linalg.solve(sums.info + small * rows, sums.score.T).T
        size = 1.0
        while size > 1e-4:
            after = passed(mean + size * to_mean, spread + size * to_spread)
            if after.loss[0, 0] / rows / k < losses[-1]:
                break
            size /= 2
        else:
            break
        mean, spread, sums = mean + size * to_mean, spread + size * to_spread, after
        losses.append(sums.loss[0, 0] / rows / k)
        if losses[-2] - losses[-1] < settled:
            break
    weights = mean[:, :-1] / x_scale * y_scale[:, None]
    log_weights = spread[:, :-1] / x_scale
    bias = mean[:, -1] * y_scale + y_mean - weights @ x_mean
    log_bias = spread[:, -1] + 2 * np.log(y_scale) - log_weights @ x_mean
    # The loss was that of standardized targets.
    return ScaledHead(weights, bias, log_weights, log_bias, [v + float(np.log(y_scale).mean()) for v in losses])


def apply_scaled_gaussian(df: DataFrame, head: ScaledHead, features: str = "features") -> DataFrame:
    """Adds ``mu`` and ``sigma``, one number per output dimension. The head travels with the task."""

    def predicted(weights: np.ndarray, bias: np.ndarray, of):
        @F.pandas_udf("array<double>")
        def numbers(x: pd.Series) -> pd.Series:
            if x.empty:
                return pd.Series([], dtype=object)
            return pd.Series(list(of(np.stack(x.to_numpy()).astype(float) @ weights.T + bias)))

        return numbers(F.col(features))

    return df.withColumns({"mu": predicted(head.weights, head.bias, lambda v: v), "sigma": predicted(head.log_weights, head.log_bias, lambda v: np.exp(v / 2))})


def head_rows(df: DataFrame, head: ScaledHead) -> DataFrame:
    """``dim, weights, bias, log_weights, log_bias`` as a table."""
    rows = [(j, head.weights[j].tolist(), float(head.bias[j]), head.log_weights[j].tolist(), float(head.log_bias[j])) for j in range(len(head.bias))]
    return df.sparkSession.createDataFrame(rows, "dim int, weights array<double>, bias double, log_weights array<double>, log_bias double")
