"""What the classifiers share: label folds, bounded fit samples, small logistic fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Of the rows that may teach, those whose hash has this remainder calibrate and the others fit.
CALIBRATE_MOD = 4


def teaching(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y, calibrates) of the labels that may teach: not held out, label 0 or 1.  Of several for one id the largest counts."""
    rows = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), 4, 2))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    return rows.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(CALIBRATE_MOD)) == 0)


def bounded(teach: DataFrame, of_each: int) -> DataFrame:
    """At most of_each ids of each label, for fitting and for calibrating: a broadcast of bounded size."""
    parts = [teach.where((F.col("y") == y) & (F.col("calibrates") == c)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y in (0, 1) for c, n in ((False, of_each), (True, of_each // 2))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return F.broadcast(out)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the intercept: Newton steps on the penalised likelihood (the intercept is free)."""
    x1 = np.column_stack([x, np.ones(len(x))]) if len(x) else np.zeros((0, x.shape[1] + 1))
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    loss = lambda w: float(weight @ np.logaddexp(0, (1 - 2 * y) * (x1 @ w))) + 0.5 * float(penalty @ (w * w))
    now = loss(w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -40, 40)))
        g = x1.T @ (weight * (p - y)) + penalty * w
        h = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * (1 + abs(now)):
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
