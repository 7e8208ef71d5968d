"""Lloyd's algorithm with uniformly drawn starting centres; one aggregation an iteration."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest(columns: list[Column], centres: np.ndarray) -> Column:
    """0-based nearest centre, the lowest of equals."""
    d = F.array(*[sum(((c - F.lit(float(v))) * (c - F.lit(float(v))) for c, v in zip(columns, row, strict=True)), F.lit(0.0)) for row in centres])
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def lloyd_step(df: DataFrame, columns: list[Column], centres: np.ndarray) -> np.ndarray:
    """New centres; one without rows becomes the origin."""
    names = [f"v{k}" for k in range(len(columns))]
    got = df.select(nearest(columns, centres).alias("k"), *[c.alias(n) for c, n in zip(columns, names, strict=True)]).groupBy("k").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names]).collect()
    out = np.zeros_like(centres)
    for r in got:
        out[r.k] = [r[n] / r.n for n in names]
    return out


def kmeans(df: DataFrame, y: list[str], k: int, tol: float = 1e-4, maxiter: int = 100, seed: int = 123) -> dict[str, Any]:
    """Centres in the alphabetical order of the columns."""
    names = sorted(y)
    columns = [F.col(f"`{c}`").cast("double") for c in names]
    row = df.agg(F.count("*").alias("n"), *[F.min(c).alias(f"lo{i}") for i, c in enumerate(columns)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(columns)]).first()
    if not row.n:
        return {"title": "K-Means Centers", "n_obs": 0, "centers": []}
    low, high = (np.array([row[f"{e}{i}"] for i in range(len(names))], float) for e in ("lo", "hi"))
    centres = np.random.RandomState(seed).uniform(low, high, (k, len(names)))
    rows = df.select(*names).persist()
    columns = [F.col(f"`{c}`").cast("double") for c in names]
    for _ in range(maxiter):
        new = lloyd_step(rows, columns, centres)
        moved = float(np.linalg.norm(new - centres))
        centres = new
        if moved <= tol:
            break
    rows.unpersist()
    return {"title": "K-Means Centers", "n_obs": int(row.n), "centers": centres.tolist()}
