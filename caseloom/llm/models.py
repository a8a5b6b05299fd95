"""Small models that are fitted on bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, columns: list[str], most: int) -> DataFrame:
    """At most ``most`` distinct rows, the first by a hash of ``columns``.

    Rows far down in hash order are left out where they are read, so about
    ``most`` rows are sorted and sent on however many there are; copies of a
    row count once.
    """
    n = rows.count()
    digest = F.xxhash64(*[F.col(c).cast("string") for c in columns])
    if n > 2 * most:
        rows = rows.where(digest < F.lit(int(-(2**63) + 2**64 * min(1.0, 1.5 * most / n))))
    return rows.distinct().orderBy(digest, *columns).limit(most)


class Logistic:
    """Logistic regression by Newton steps with a ridge penalty."""

    def __init__(self, features: list[str], ridge: float = 1e-2):
        self.features, self.ridge = features, ridge
        self.weights = np.zeros(len(features) + 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        """One class only, or no rows, leave a constant model."""
        x = np.column_stack([np.asarray(x, float).reshape(len(y), len(self.features)), np.ones(len(y))])
        if len(y) == 0 or y.min() == y.max():
            self.weights[-1] = 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
            return self
        w = np.zeros(x.shape[1])
        penalty = self.ridge * len(y) * np.eye(len(w)) / 100
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty + 1e-6 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        return self

    def fit_rows(self, rows: DataFrame, label: str, most: int) -> Logistic:
        """Fit on at most ``most`` rows of ``rows``, the only ones that are fetched."""
        got = bounded_sample(rows.select(*self.features, label), [*self.features, label], most).collect()
        x = np.array([[float(r[f] or 0) for f in self.features] for r in got]).reshape(len(got), len(self.features))
        return self.fit(x, np.array([float(r[label]) for r in got]))

    def odds(self) -> Column:
        """The log odds as an expression over the feature columns."""
        total = F.lit(float(self.weights[-1]))
        for f, w in zip(self.features, self.weights):
            total = total + F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * float(w)
        return total
