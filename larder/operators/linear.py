"""Linear fits from moments: one pass over the rows for any number of penalties.

The pass sums, per task, centred products of all features and the target; Spark adds the tasks' sums. What reaches the
driver is one number per pair of columns, whatever the rows. Every fit is then solved on that matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegressionModel
from pyspark.ml.util import Identifiable
from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Moments:
    """Rows, and means and population covariances of the features with the target as the last column."""

    n: int
    mean: np.ndarray
    cov: np.ndarray


@dataclass(frozen=True)
class Fit:
    """Minimises |y - a - X b|^2 / 2n + l1 * |b|_1 + l2 * |b|^2 / 2."""

    coefficients: np.ndarray
    intercept: float
    l1: float
    l2: float


def moments(df: DataFrame, features, label) -> Moments:
    """One scan. Rows without a target do not count; features must not be null."""
    columns = [*features, label]
    size = len(columns) + 1

    def run(batches):
        import numpy as np
        import pyarrow as pa

        n, mean, spread = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            # The leading ones carry the number of rows and the sums.
            x = np.column_stack([np.ones(k), *(c.to_numpy(zero_copy_only=False) for c in batch.columns)])
            middle = x.mean(axis=0)
            x -= middle
            step = middle - mean
            spread += x.T @ x + np.outer(step, step) * (n * k / (n + k))
            mean += step * (k / (n + k))
            n += k
        if n:
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(spread[i, j]), pa.array(n * mean[i] * mean[j])], ["i", "j", "spread", "cross"]
            )

    rows = df.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double") for c in columns])
    sums = rows.mapInArrow(run, "i INT, j INT, spread DOUBLE, cross DOUBLE").groupBy("i", "j").agg(F.sum("spread").alias("spread"), F.sum("cross").alias("cross"))
    spread, cross = np.zeros((size, size)), np.zeros((size, size))
    for r in sums.collect():  # one row per pair of columns
        spread[r["i"], r["j"]] = spread[r["j"], r["i"]] = r["spread"]
        cross[r["i"], r["j"]] = cross[r["j"], r["i"]] = r["cross"]
    n = round(cross[0, 0])
    if not n:
        return Moments(0, np.zeros(size - 1), np.zeros((size - 1, size - 1)))
    mean = cross[0] / n
    # Spread inside the tasks, and of the tasks' means around the common mean.
    cov = (spread + cross) / n - np.outer(mean, mean)
    return Moments(n, mean[1:], cov[1:, 1:])


def _descend(c: np.ndarray, r: np.ndarray, l1: float, l2: float, sweeps: int, tolerance: float) -> np.ndarray:
    """Cyclic coordinate descent on the covariance matrix."""
    b, left, own = np.zeros(len(r)), r.copy(), np.diag(c)
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(own > 0):
            pull = left[j] + own[j] * b[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (own[j] + l2)
            if new != b[j]:
                left -= c[:, j] * (new - b[j])
                moved = max(moved, abs(new - b[j]) * np.sqrt(own[j]))
                b[j] = new
        if moved <= tolerance:
            break
    return b


def solve(m: Moments, kind="ols", alpha=1.0, l1_ratio=0.5, sweeps=20_000) -> Fit:
    """``ols`` (least norm in units of deviation where features are collinear), ``ridge``, ``lasso`` or ``elasticnet``.

    Penalties are those of the usual formulation: ridge adds alpha * |b|^2 to the sum of squares, lasso and elastic net
    add alpha to the halved mean square. The intercept is never penalised; a constant feature gets 0.
    """
    if not m.n:
        return Fit(np.zeros(len(m.mean) - 1), 0.0, 0.0, 0.0)
    c, r = m.cov[:-1, :-1], m.cov[:-1, -1]
    l1, l2 = {"ols": (0.0, 0.0), "ridge": (0.0, alpha / m.n), "lasso": (alpha, 0.0), "elasticnet": (alpha * l1_ratio, alpha * (1 - l1_ratio))}[kind]
    deviation = np.sqrt(np.maximum(np.diag(c), 0.0))
    live = deviation > 1e-9 * (1 + np.abs(m.mean[:-1]))
    scale = np.where(live, deviation, 1.0)
    b = np.zeros(len(r))
    part = np.ix_(live, live)
    if l1:
        b[live] = _descend(c[part], r[live], l1, l2, sweeps, 1e-11 * np.sqrt(max(m.cov[-1, -1], 1e-300)))
    elif l2:
        b[live] = np.linalg.solve(c[part] + l2 * np.eye(live.sum()), r[live])
    else:
        scaled = c[part] / np.outer(scale[live], scale[live])
        b[live] = np.linalg.lstsq(scaled, r[live] / scale[live], rcond=1e-10)[0] / scale[live]
    return Fit(b, float(m.mean[-1] - m.mean[:-1] @ b), l1, l2)


def as_pipeline(fit: Fit, features, label, prediction) -> PipelineModel:
    """A fitted pipeline that can be saved, loaded and applied like any other."""
    context = SparkSession.active().sparkContext
    build = context._jvm.org.apache.spark.ml.regression.LinearRegressionModel
    java = build(Identifiable.__name__ + "_moments", _py2java(context, Vectors.dense(fit.coefficients)), float(fit.intercept))
    model = LinearRegressionModel(java)
    model._resetUid(java.uid())
    model = model.setFeaturesCol("features").setPredictionCol(prediction)
    return PipelineModel([VectorAssembler(inputCols=list(features), outputCol="features"), model])


def optimality(df: DataFrame, features, label, fits: dict[str, Fit]) -> DataFrame:
    """(model, n_rows, n_features, violation): how far each fit is from its optimality conditions on the rows themselves.

    At the minimum, the mean product of a feature with the residual equals l2 * b + l1 * sign(b), or lies within +-l1 where b is
    0. ``violation`` is the largest departure over the features, in units of the feature's and the target's deviation.
    """
    names = list(fits)
    weights = np.column_stack([np.append(fits[k].intercept, fits[k].coefficients) for k in names])
    columns, size = [*features, label], len(features) + 1

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total, squares, n = np.zeros((size, len(names))), np.zeros((2, size + 1)), 0
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) for c in batch.columns)])
            left = x[:, -1:] - x[:, :-1] @ weights
            total += x[:, :-1].T @ left
            squares += np.stack([x.sum(axis=0), (x * x).sum(axis=0)])
            n += len(x)
        place = np.arange(size + 1, dtype=np.int32)
        whole = np.vstack([total, np.zeros((1, len(names)))])
        yield pa.RecordBatch.from_arrays(
            [pa.array(place), pa.array(np.full(size + 1, n)), pa.array(squares[0]), pa.array(squares[1]), *(pa.array(whole[:, k]) for k in range(len(names)))],
            ["place", "n", "s", "ss", *(f"m{k}" for k in range(len(names)))],
        )

    rows = df.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double") for c in columns])
    schema = "place INT, n LONG, s DOUBLE, ss DOUBLE, " + ", ".join(f"m{k} DOUBLE" for k in range(len(names)))
    found = sorted(rows.mapInArrow(run, schema).groupBy("place").sum().drop("sum(place)").collect())  # one row per column
    out = []
    for k, name in enumerate(names):
        fit, n = fits[name], found[0][1] if found else 0
        worst = 0.0
        spread = [max(r[3] / n - (r[2] / n) ** 2, 0.0) ** 0.5 if n else 0.0 for r in found]
        for j in range(1, size):
            if not n or spread[j] == 0 or spread[-1] == 0:
                continue
            pull, b = found[j][4 + k] / n, fit.coefficients[j - 1]
            gap = abs(pull - fit.l2 * b - fit.l1 * np.sign(b)) if b else max(abs(pull) - fit.l1, 0.0)
            worst = max(worst, gap / (spread[j] * spread[-1]))
        out.append((name, int(n or 0), len(features), float(worst)))
    return SparkSession.active().createDataFrame(out, "model STRING, n_rows LONG, n_features INT, violation DOUBLE")
