"""Averages and standard deviations as small result tables; also as algorithms to plug into an engine."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import Algorithm
from ..specs import Spec, Variable


def _table(title: str, **columns: list) -> dict[str, Any]:
    kind = lambda values: "STR" if any(isinstance(v, str) for v in values) else "FLOAT"
    return {"title": title, "columns": [{"name": k, "data": v, "type": kind(v)} for k, v in columns.items()]}


def compute_average(df: DataFrame, y: list[str]) -> dict[str, Any]:
    """The mean of each variable's values that aren't null; NaN where there is none."""
    got = df.agg(*[F.avg(F.col(f"`{v}`").cast("double")).alias(f"m{k}") for k, v in enumerate(y)]).first()
    return _table("Average", variable=list(y), average=[float("nan") if v is None else v for v in got])


def standard_deviation(df: DataFrame, y: str) -> dict[str, Any]:
    """The population's standard deviation over all sites, about the mean; 0 for fewer than two values."""
    got = df.agg(F.stddev_pop(F.col(f"`{y}`").cast("double"))).first()[0]
    return _table("Standard Deviation", variable=[y], std_deviation=[got or 0.0])


class ComputeAverage(Algorithm):
    spec = Spec("compute_average", Variable(numerical=True, multiple=True), label="Average")
    drop_na_rows = False

    def run(self, call) -> dict[str, Any]:
        return compute_average(call.rows, call.y)


class StandardDeviation(Algorithm):
    spec = Spec("standard_deviation", Variable(numerical=True), label="Standard deviation")

    def run(self, call) -> dict[str, Any]:
        return standard_deviation(call.rows, call.y[0])
