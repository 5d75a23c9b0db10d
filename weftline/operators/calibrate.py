"""Calibrator fit: population standardization and a penalized logistic regression by Newton steps.

Each step is one aggregate over the rows: fifteen sums, whatever their number. The driver solves five equations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.expr import sigmoid


def fit(rows: DataFrame, features: list[Column], target: Column, c: float = 1.0, steps: int = 50, tolerance: float = 1e-12) -> DataFrame:
    """One row: mean, scale (1 where the variance is 0), coefficients, intercept, rows. The penalty is |w|^2 / (2 c), not on the intercept."""
    k = len(features)
    x = rows.select(*[f.alias(f"x{i}") for i, f in enumerate(features)], target.cast("double").alias("y"))
    m = x.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(k)]).first()
    if not m["n"] or not 0 < m["pos"] < m["n"]:
        raise ValueError("both classes must be present to fit a calibrator")
    mean, scale = [float(m[f"m{i}"]) for i in range(k)], [float(m[f"s{i}"]) or 1.0 for i in range(k)]
    z = x.select(*[((F.col(f"x{i}") - mean[i]) / scale[i]).alias(f"z{i}") for i in range(k)], F.lit(1.0).alias(f"z{k}"), "y")
    w = np.zeros(k + 1)
    penalty = np.diag([1 / c] * k + [0.0])
    for _ in range(steps):
        v = sum((F.col(f"z{i}") * float(w[i]) for i in range(k + 1)), F.lit(0.0))
        p = sigmoid(v)
        one = z.select("*", p.alias("p")).agg(
            *[F.sum((F.col("y") - F.col("p")) * F.col(f"z{i}")).alias(f"g{i}") for i in range(k + 1)],
            *[F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)],
        ).first()
        g = np.array([one[f"g{i}"] for i in range(k + 1)]) - penalty @ w
        h = np.array([[one[f"h{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) + penalty
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < tolerance:
            break
    return rows.sparkSession.createDataFrame([(mean, scale, [float(a) for a in w[:k]], float(w[k]), int(m["n"]))], "mean array<double>, scale array<double>, coefficients array<double>, intercept double, rows long")


def gradient(rows: DataFrame, features: list[Column], target: Column, fitted, c: float = 1.0) -> list[float]:
    """Slopes of the penalized log-likelihood at a fitted row of fit(): of each coefficient, then of the intercept. All are 0 at the optimum."""
    w = [*fitted["coefficients"], fitted["intercept"]]
    z = [(f - m) / s for f, m, s in zip(features, fitted["mean"], fitted["scale"], strict=True)] + [F.lit(1.0)]
    gap = target.cast("double") - sigmoid(sum((x * float(a) for x, a in zip(z, w, strict=True)), F.lit(0.0)))
    got = rows.agg(*[F.sum(gap * x).alias(f"g{i}") for i, x in enumerate(z)]).first()
    return [got[f"g{i}"] - (a / c if i < len(w) - 1 else 0.0) for i, a in enumerate(w)]
