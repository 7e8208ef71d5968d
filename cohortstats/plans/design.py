"""Design matrices as column expressions: intercept, dummies, numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def observed_levels(df: DataFrame, names: list[str]) -> dict[str, list]:
    """Sorted distinct non-null values of each categorical, all in one job."""
    if not names:
        return {}
    row = df.agg(*[F.sort_array(F.collect_set(f"`{c}`")).alias(f"l{k}") for k, c in enumerate(names)]).first()
    return {c: list(row[f"l{k}"]) for k, c in enumerate(names)}


def split_variables(df: DataFrame, x: list[str], categorical: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Categorical and numerical variables of x, in order; strings are categorical unless told."""
    kinds = dict(df.dtypes)
    chosen = set(categorical) if categorical is not None else {c for c in x if kinds[c] in ("string", "boolean")}
    return [c for c in x if c in chosen], [c for c in x if c not in chosen]


def design(levels: dict[str, list], numerical: list[str]) -> tuple[list[str], list[Column]]:
    """Labels and expressions: Intercept; name[level] for all levels but the first; the numbers."""
    labels, columns = ["Intercept"], [F.lit(1.0)]
    for name, values in levels.items():
        for v in values[1:]:
            labels.append(f"{name}[{v}]")
            columns.append(F.when(F.col(f"`{name}`") == F.lit(v), 1.0).otherwise(0.0))
    for name in numerical:
        labels.append(name)
        columns.append(F.col(f"`{name}`").cast("double"))
    return labels, columns


def linear(columns: list[Column], coefficients) -> Column:
    out = F.lit(0.0)
    for c, b in zip(columns, coefficients, strict=True):
        out = out + c * F.lit(float(b))
    return out
