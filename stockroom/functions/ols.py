"""Least squares from aggregated moments.

A regression with k regressors needs only the (k+1) x (k+1) cross-product
matrix, which Spark computes in one aggregate (partial sums per task, then a
tiny final merge).  Solving that small matrix is O(k^3) on the driver
(global fit) or per group inside ``applyInPandas`` on a frame with one row
per group (grouped fits).  No rows of the data leave the executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _terms(xs: list[str]) -> list[tuple[str, Column]]:
    cols = [("1", F.lit(1.0))] + [(x, F.col(x).cast("double")) for x in xs]
    return cols


def moment_aggs(y: str, xs: list[str]) -> list[Column]:
    t = _terms(xs)
    aggs = []
    for i, (ni, ci) in enumerate(t):
        for j in range(i, len(t)):
            nj, cj = t[j]
            aggs.append(F.sum(ci * cj).alias(f"xx_{i}_{j}"))
        aggs.append(F.sum(ci * F.col(y).cast("double")).alias(f"xy_{i}"))
    return aggs


def _solve(row: dict, k: int, ridge: float = 0.0) -> np.ndarray:
    a = np.zeros((k, k))
    b = np.zeros(k)
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"xx_{i}_{j}"] or 0.0
        b[i] = row[f"xy_{i}"] or 0.0
    if ridge:
        a[1:, 1:] += ridge * np.eye(k - 1)
    return np.linalg.lstsq(a, b, rcond=None)[0]


def ols(df: DataFrame, y: str, xs: list[str], ridge: float = 0.0) -> dict[str, float]:
    """Global OLS fit y ~ 1 + xs; returns {'intercept': b0, x: b, ...}."""

    row = df.where(F.col(y).isNotNull()).agg(*moment_aggs(y, xs)).first().asDict()
    beta = _solve(row, len(xs) + 1, ridge)
    return {"intercept": float(beta[0]), **{x: float(b) for x, b in zip(xs, beta[1:])}}


def gram_matrices(df: DataFrame, columns: list[str], by: Column | None = None) -> dict:
    """{group: matrix} of sums of products of (1, *columns) over rows without a null in them.

    One aggregate for all groups; ``by`` has few values, since a matrix a group reaches the driver.
    """

    cells = [F.lit(1.0), *(F.col(c).cast("double") for c in columns)]
    places = [(i, j) for i in range(len(cells)) for j in range(i, len(cells))]
    group = F.lit(0) if by is None else by
    whole = df.dropna(subset=columns).groupBy(group.alias("group"))
    out = {}
    for row in whole.agg(*(F.sum(cells[i] * cells[j]).alias(f"g{i}_{j}") for i, j in places)).collect():
        matrix = np.zeros((len(cells), len(cells)))
        for i, j in places:
            matrix[i, j] = matrix[j, i] = row[f"g{i}_{j}"]
        out[row.group] = matrix
    return out


def partial_out(gram: np.ndarray, target: int, on: list[int]) -> np.ndarray:
    """Coefficients ``c`` over all columns of the matrix such that the residual of ``target`` after
    least squares on ``on`` is the sum of ``c`` times the columns."""

    scale = np.sqrt(np.maximum(np.diag(gram)[on], np.finfo(float).tiny))
    inner = gram[np.ix_(on, on)] / scale[:, None] / scale
    out = np.zeros(len(gram))
    out[on] = -np.linalg.lstsq(inner, gram[on, target] / scale, rcond=None)[0] / scale
    out[target] += 1.0
    return out


def grouped_ols(df: DataFrame, keys: list[str], y: str, xs: list[str], ridge: float = 0.0) -> DataFrame:
    """OLS per group: one aggregate of moments, then a per-group solve.

    The moment frame has one row per group; ``applyInPandas`` solves each
    group's small system with NumPy.  Output: keys + intercept + one column
    per regressor (``coef_<x>``).
    """

    k = len(xs) + 1
    moments = df.where(F.col(y).isNotNull()).groupBy(*keys).agg(*moment_aggs(y, xs))
    key_fields = [f for f in moments.schema.fields if f.name in keys]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields] + ["intercept double"] + [f"coef_{x} double" for x in xs])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in pdf.iterrows():
            beta = _solve(r.to_dict(), k, ridge)
            out.append([r[c] for c in keys] + [float(b) for b in beta])
        return pd.DataFrame(out, columns=keys + ["intercept"] + [f"coef_{x}" for x in xs])

    return moments.groupBy(*keys).applyInPandas(solve, schema)


def predict(coefs: dict[str, float], xs: list[str]) -> Column:
    """Column expression b0 + sum(b_i x_i) for a global fit."""

    out = F.lit(coefs["intercept"])
    for x in xs:
        out = out + F.lit(coefs[x]) * F.col(x).cast("double")
    return out
