"""The rows that a request asks for, as a lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InsufficientDataError
from . import filters as rules

DATASET, SITE = "dataset", "site"
MIN_ROWS = 10


@dataclass(frozen=True)
class InputData:
    data_model: str = ""
    datasets: tuple[str, ...] = ()
    y: tuple[str, ...] = ()
    x: tuple[str, ...] = ()
    filters: dict[str, Any] | None = None
    validation_datasets: tuple[str, ...] = ()

    @classmethod
    def of(cls, given: dict[str, Any]) -> InputData:
        lists = {k: tuple(given.get(k) or ()) for k in ("datasets", "y", "x", "validation_datasets")}
        return cls(data_model=given.get("data_model", ""), filters=given.get("filters"), **lists)

    @property
    def variables(self) -> list[str]:
        """x and y in order, each once."""
        return list(dict.fromkeys((*self.x, *self.y)))


@dataclass
class Cohort:
    """``rows`` holds the variables (sorted by name), and dataset and site where the table has them."""

    rows: DataFrame
    inputdata: InputData
    min_rows: int = MIN_ROWS
    enumerations: dict[str, list[str]] = field(default_factory=dict)


def select_rows(table: DataFrame, data: InputData, *, dropna: bool = True, extra: tuple[str, ...] = (), keep: tuple[str, ...] = (DATASET, SITE)) -> DataFrame:
    """Dataset predicate, filter tree and not-null predicate, then only the columns that are used.

    All of them are plain conditions on the table, so a Parquet scan gets them pushed down.
    """
    out = table
    wanted = (*data.datasets, *data.validation_datasets)
    if wanted and DATASET in table.columns:
        out = out.where(F.col(DATASET).isin(*wanted))
    if (condition := rules.to_column(data.filters)) is not None:
        out = out.where(condition)
    names = list(dict.fromkeys((*data.variables, *extra)))
    if dropna:
        for name in names:
            out = out.where(F.col(f"`{name}`").isNotNull())
    kept = [k for k in keep if k in table.columns and k not in names]
    return out.select(*[F.col(f"`{c}`") for c in sorted(names)], *kept)


def gate(rows: DataFrame, min_rows: int, by: str = SITE) -> DataFrame:
    """Drops the rows of sites with fewer than ``min_rows``; raises if no site has as many.

    Sites are few (workers of a federation): their counts are one small aggregate, and the surviving
    names go into the plan as a literal predicate, so the rows themselves are not shuffled.
    """
    if by not in rows.columns:
        if rows.limit(min_rows).count() < min_rows:
            raise InsufficientDataError()
        return rows
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    good = [s for s, n in counts.items() if n >= min_rows]
    if not good:
        raise InsufficientDataError()
    return rows if len(good) == len(counts) else rows.where(F.col(by).isin(*good))


def gate_plan(rows: DataFrame, min_rows: int, by: str = SITE) -> DataFrame:
    """The same as one lazy plan (a broadcast semi-join), without raising."""
    return rows.join(rows.groupBy(by).count().where(F.col("count") >= min_rows).select(by), by, "left_semi")


def coerce_enumerations(rows: DataFrame, enumerations: dict[str, list]) -> DataFrame:
    """Categorical columns in the type of their enumeration's codes: whole numbers if all codes are and
    every value is integral, strings if the codes are strings."""
    for name, codes in enumerations.items():
        if name not in rows.columns or not codes:
            continue
        column = F.col(f"`{name}`")
        kind = dict(rows.dtypes)[name]
        if all(isinstance(c, int) for c in codes) and kind in ("string", "double", "float"):
            number = F.expr(f"try_cast(`{name}` as double)")
            bad = rows.where(column.isNotNull() & (number.isNull() | (number != F.floor(number)))).limit(1).count()
            if not bad:
                rows = rows.withColumn(name, number.cast("long"))
        elif all(isinstance(c, str) for c in codes) and kind != "string":
            text = F.when(column == F.floor(column), column.cast("long").cast("string")).otherwise(column.cast("string")) if kind in ("double", "float") else column.cast("string")
            rows = rows.withColumn(name, text)
    return rows
