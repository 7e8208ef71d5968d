"""Pearson correlations and principal components, from one set of sums."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadUserInput
from ..functions.special import betainc, norm_ppf
from ..plans.rounds import WIDE, Round, gram, gram_columns, unpack_gram


def _numbers(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`").cast("double") for c in names]


def pearson_correlation(df: DataFrame, y: list[str], x: list[str] | None = None, alpha: float = 0.95) -> dict[str, Any]:
    """Correlations (a row a y, a column an x), p values and Fisher intervals at 1 - alpha."""
    x = list(x or y)
    xs, ys = _numbers(x), _numbers(y)
    s = Round().sum("n", F.lit(1)).sum("x", *xs).sum("y", *ys).sum("xx", *[c * c for c in xs]).sum("yy", *[c * c for c in ys]).sum("xy", *[b * a for b in ys for a in xs]).run(df)
    n = s["n"][0]
    if n == 0:
        raise BadUserInput("Cannot compute Pearson correlation on empty data.")
    if n <= 2:
        raise BadUserInput("Not enough observations to compute Pearson correlation.")
    spread = lambda q, t: np.sqrt(np.maximum(n * q - t * t, 0))
    d = spread(s["yy"], s["y"])[:, None] * spread(s["xx"], s["x"])[None, :]
    cov = n * s["xy"].reshape(len(y), len(x)) - s["y"][:, None] * s["x"][None, :]
    r = np.clip(np.divide(cov, d, out=np.zeros_like(cov), where=d != 0), -1, 1)
    dof = n - 2
    p = np.array([[0.0 if abs(v) == 1 else betainc(dof / 2, 0.5, min(1.0, dof / (dof + v * v * dof / ((1 - v) * (1 + v))))) for v in row] for row in r])
    with np.errstate(divide="ignore", invalid="ignore"):
        half = norm_ppf(1 - alpha / 2) / math.sqrt(n - 3) if n > 3 else math.inf
        low, high = np.tanh(np.arctanh(r) - half), np.tanh(np.arctanh(r) + half)
    table = lambda m: {"variables": x, **{name: row for name, row in zip(y, m.tolist(), strict=True)}}
    return {"title": "Pearson Correlation Coefficient", "n_obs": int(n), "correlations": table(r), "p_values": table(p), "ci_lo": table(low), "ci_hi": table(high)}


def pca(df: DataFrame, y: list[str]) -> dict[str, Any]:
    """Eigenvalues, descending, and eigenvectors (rows) of the correlation matrix."""
    columns = _numbers(y)
    return _components(df, columns, y)


def _components(df: DataFrame, columns: list[Column], names: list[str]) -> dict[str, Any]:
    """Products are summed about a first round's means: far from zero, raw sums of squares would cancel."""
    p = len(columns)
    r = Round().sum("n", F.lit(1)).sum("x", *columns).run(df)
    n = r["n"][0]
    if n < 2:
        raise BadUserInput("Not enough observations for PCA.")
    centred = [c - F.lit(float(m)) for c, m in zip(columns, r["x"] / n, strict=True)]
    if p <= WIDE:
        s = Round().sum("x", *centred).sum("g", *gram_columns(centred)).run(df)
        total, g = s["x"], unpack_gram(s["g"], p)
    else:
        g = gram(df, [F.lit(1.0), *centred])
        total, g = g[0, 1:], g[1:, 1:]
    cov = (g - np.outer(total, total) / n) / (n - 1)
    sigma = np.sqrt(np.maximum(np.diag(cov), 0))
    sigma = np.where(sigma == 0, 1.0, sigma)
    values, vectors = np.linalg.eigh(cov / np.outer(sigma, sigma))
    order = np.argsort(values)[::-1]
    return {"title": "Eigenvalues and Eigenvectors", "n_obs": int(n), "eigenvalues": values[order].tolist(), "eigenvectors": vectors[:, order].T.tolist()}


def pca_with_transformation(df: DataFrame, y: list[str], data_transformation: dict[str, list[str]] | None = None) -> dict[str, Any]:
    """Logs, exponentials, then standardised or centred columns, and their principal components."""
    wanted = dict(data_transformation or {})
    if unknown := set(wanted) - {"log", "exp", "center", "standardize"}:
        raise BadUserInput(f"Unknown data transformation: {sorted(unknown)}.")
    columns = dict(zip(y, _numbers(y), strict=True))
    logs = [c for c in wanted.get("log", []) if c in columns]
    if logs:
        low = Round().min("m", *[columns[c] for c in logs]).run(df)["m"]
        if (low <= 0).any():
            # fixed text: clients match this message
            raise BadUserInput(f"Log transformation cannot be applied to non-positive values in column '{logs[int(np.argmax(low <= 0))]}'.")
    for c in logs:
        columns[c] = F.log(columns[c])
    for c in wanted.get("exp", []):
        if c in columns:
            columns[c] = F.exp(columns[c])
    moved = [c for c in y if c in {*wanted.get("standardize", []), *wanted.get("center", [])}]
    if moved:
        s = Round().sum("n", F.lit(1)).sum("x", *[columns[c] for c in moved]).sum("q", *[columns[c] * columns[c] for c in moved]).run(df)
        n = s["n"][0]
        for c, t, q in zip(moved, s["x"], s["q"], strict=True):
            columns[c] = columns[c] - F.lit(float(t / n))
            if c in wanted.get("standardize", []):
                sd = math.sqrt(max(q - t * t / n, 0) / (n - 1)) if n > 1 else 0.0
                if sd == 0:
                    # fixed text: clients match this message
                    raise BadUserInput(f"Standardization cannot be applied to column '{c}' because its standard deviation is zero.")
                columns[c] = columns[c] / F.lit(sd)
    return _components(df, [columns[c] for c in y], y)
