"""Models fitted by rounds of sums: every round adds up gradients of all models over the rows, and the driver holds only the models.

Rows are written once and stay where they are; a task makes one partial sum for each model. What the driver gets in
a round is a few numbers a model and task, or a model where that would be many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.interim import written

SUMS = "m int, k int, v double"
#: Partial sums of up to so many numbers are added by the driver; of more, in Spark.
DRIVER_NUMBERS = 1 << 20


def summed(rows: DataFrame, columns: Sequence[str], kernel: Callable[[int, np.ndarray], np.ndarray], width: int, models: int) -> np.ndarray:
    """models x width: for each model the sum of kernel(model, its rows) over the rows.

    rows has columns and `first` and `last`, the models that a row belongs to: one, or a run of them. kernel
    gets rows x columns, nulls as NaN, and gives one vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((models, width))
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(len(columns))])
            first, last = (b.column(len(columns) + k).to_numpy() for k in (0, 1))
            for m in range(int(first.min()), int(last.max()) + 1):
                mine = (first <= m) & (m <= last)
                if mine.any():
                    total[m] += kernel(m, x[mine])
        m, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[m, k])], names=["m", "k", "v"])

    partial = rows.select(*columns, "first", "last").mapInArrow(run, SUMS)
    if rows.rdd.getNumPartitions() * models * width > DRIVER_NUMBERS:
        partial = partial.groupBy("m", "k").agg(F.sum("v").alias("v"))
    got, out = partial.toArrow(), np.zeros((models, width))
    np.add.at(out, (got["m"].to_numpy(), got["k"].to_numpy()), got["v"].to_numpy())
    return out


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (np.where(np.isnan(x), mean, x) - mean) / scale


def descend(rows: DataFrame, features: Sequence[str], target: str, models: int, iterations: int, rate: float, l2: float) -> list[dict]:
    """Logistic models by full-batch descent, each of features standardised over its own rows.

    A missing feature counts as the mean; scales are population deviations, 1 where there is none or one value.
    A model without rows has coefficients and intercept 0. All models take each step together.
    """
    rows = written(rows.select(*features, target, "first", "last"))
    p = len(features)
    columns = [*features, target]

    def counts(m: int, x: np.ndarray) -> np.ndarray:
        seen = ~np.isnan(x[:, :p])
        return np.concatenate([seen.sum(axis=0), np.where(seen, x[:, :p], 0).sum(axis=0), [len(x), x[:, p].sum()]])

    made = summed(rows, columns, counts, 2 * p + 2, models)
    seen, n = made[:, :p], made[:, 2 * p]
    means = made[:, p : 2 * p] / np.maximum(seen, 1)
    squares = summed(rows, columns, lambda m, x: np.nansum((x[:, :p] - means[m]) ** 2, axis=0), p, models)
    scales = np.sqrt(squares / np.maximum(seen, 1))
    scales[(scales == 0) | (seen < 2)] = 1.0
    share = np.clip(made[:, 2 * p + 1] / np.maximum(n, 1), 1e-6, 1 - 1e-6)
    trained = n > 0
    intercept = np.where(trained, np.log(share / (1 - share)), 0.0)
    weights = np.zeros((models, p))
    for _ in range(iterations if trained.any() else 0):
        w, b = weights.copy(), intercept.copy()

        def slopes(m: int, x: np.ndarray, w=w, b=b) -> np.ndarray:
            z = _standard(x[:, :p], means[m], scales[m])
            errors = 1 / (1 + np.exp(-np.clip(b[m] + z @ w[m], -35, 35))) - x[:, p]
            return np.append(z.T @ errors, errors.sum())

        total = summed(rows, columns, slopes, p + 1, models) / np.maximum(n, 1)[:, None]
        intercept = np.where(trained, intercept - rate * total[:, p], 0.0)
        weights = np.where(trained[:, None], weights - rate * (total[:, :p] + l2 * weights), 0.0)
    return [{"means": means[m].tolist(), "scales": scales[m].tolist(), "coefficients": weights[m].tolist(), "intercept": float(intercept[m]), "rows": int(n[m])} for m in range(models)]


#: Sizes of a step that are tried in one round.
HALVINGS = 20


def damped_newton(rows: DataFrame, anchors: np.ndarray, pulls: np.ndarray, active: np.ndarray) -> np.ndarray:
    """models x 2: (alpha, beta) of logistic fits on (logit, outcome, weight), drawn to (anchor, 1) by pulls (of alpha, of beta).

    A round sums slopes, curvature and, for the step it leads to, the costs of HALVINGS sizes; the largest that
    lowers the cost enough is taken. Models that are not active, or have come to rest, take no steps.
    """
    rows = written(rows.select("logit", "outcome", "weight", "first", "last"))
    models = len(anchors)
    columns = ["logit", "outcome", "weight"]
    n = summed(rows, columns, lambda m, x: np.array([float(len(x))]), 1, models)[:, 0]
    target = np.column_stack([anchors, np.ones(models)])
    theta, moving = target.copy(), active & (n > 0)

    def around(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def kernel(m: int, x: np.ndarray) -> np.ndarray:
            z, y, w = x.T
            p = 1 / (1 + np.exp(-(at[m, 0] + at[m, 1] * z)))
            e, c = w * (p - y), w * p * (1 - p)
            return np.array([e.sum(), (e * z).sum(), c.sum(), (c * z).sum(), (c * z * z).sum()])

        s = summed(rows, columns, kernel, 5, models) / np.maximum(n, 1)[:, None]
        slope = pulls * (at - target) + s[:, :2]
        curve = np.array([np.diag(pulls) + [[a, b], [b, c]] for a, b, c in s[:, 2:]])
        return slope, curve

    def costs(at: np.ndarray, step: np.ndarray, first: int) -> np.ndarray:
        """models x (1 + HALVINGS): at no step, and at sizes 2 ** -first and on."""
        sizes = np.r_[0.0, 0.5 ** np.arange(first, first + HALVINGS)]
        places = at[:, None, :] + sizes[None, :, None] * step[:, None, :]

        def kernel(m: int, x: np.ndarray) -> np.ndarray:
            z, y, w = x.T
            s = places[m, :, 0] + z[:, None] * places[m, :, 1]
            return (w[:, None] * (np.logaddexp(0, s) - y[:, None] * s)).sum(axis=0)

        own = summed(rows, columns, kernel, 1 + HALVINGS, models) / np.maximum(n, 1)[:, None]
        return own + 0.5 * (pulls * (places - target[:, None, :]) ** 2).sum(axis=2)

    for _ in range(100):
        if not moving.any():
            break
        slope, curve = around(theta)
        moving &= np.hypot(slope[:, 0], slope[:, 1]) >= 1e-10
        step = np.array([-np.linalg.solve(c, g) if np.linalg.det(c) > 1e-14 else -g for c, g in zip(curve, slope, strict=True)])
        step[~moving] = 0
        seeking, first = moving.copy(), 0
        while seeking.any() and 0.5**first > 1e-12:
            cost = costs(theta, step, first)
            sizes = 0.5 ** np.arange(first, first + HALVINGS)
            enough = cost[:, 1:] <= cost[:, :1] + 1e-4 * sizes * (slope * step).sum(axis=1)[:, None]
            for m in np.flatnonzero(seeking & enough.any(axis=1)):
                theta[m] += sizes[enough[m].argmax()] * step[m]
                seeking[m] = False
            first += HALVINGS
        moving &= ~seeking
    return theta
