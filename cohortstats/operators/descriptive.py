"""Descriptive statistics and histograms."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadUserInput
from ..plans.cohort import DATASET, MIN_ROWS


def _long(rows: DataFrame, names: list[str], kind: str) -> DataFrame:
    """One row a value: dataset, variable, value; so that all variables are summed in one job."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast(kind).alias("value")) for c in names]))
    return rows.select(DATASET, pairs.alias("p")).select(DATASET, "p.*")


def numeric_summary(rows: DataFrame, names: list[str]) -> DataFrame:
    """Per dataset and variable: num_dtps, num_na, num_total, sx, sxx, mean, std, min, q1, q2, q3, max."""
    v = F.col("value")
    quartiles = F.percentile(v, F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)]))
    out = _long(rows, names, "double").groupBy("variable", DATASET).agg(
        F.count(v).alias("num_dtps"), F.sum(F.when(v.isNull(), 1).otherwise(0)).alias("num_na"), F.count("*").alias("num_total"), F.sum(v).alias("sx"), F.sum(v * v).alias("sxx"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), quartiles.alias("q"), F.max(v).alias("max"),
    )
    return out.select("variable", DATASET, "num_dtps", "num_na", "num_total", "sx", "sxx", "mean", "std", "min", *[F.get("q", F.lit(k)).alias(f"q{k + 1}") for k in range(3)], "max")


def nominal_summary(rows: DataFrame, names: list[str]) -> DataFrame:
    """Per dataset, variable and level (null among them): n."""
    return _long(rows, names, "string").groupBy("variable", DATASET, "value").agg(F.count("*").alias("n"))


def _merge(records: list[dict[str, Any]], only_one: bool) -> dict[str, Any]:
    """All datasets' record from the datasets' records; it has no quartiles."""
    out: dict[str, Any] = {k: sum(r[k] for r in records) for k in ("num_dtps", "num_na", "num_total")}
    if "counts" in records[0]:
        counts: dict[str, int] = {}
        for r in records:
            for level, n in r["counts"].items():
                counts[level] = counts.get(level, 0) + n
        return out | {"counts": counts}
    n, sx, sxx = out["num_dtps"], sum(r["sx"] for r in records), sum(r["sxx"] for r in records)
    mean = sx / n
    std = records[0]["std"] if only_one else math.sqrt(max((sxx - n * mean * mean) / (n - 1), 0)) if n > 1 else None
    return out | {"sx": sx, "sxx": sxx, "mean": mean, "std": std, "min": min(r["min"] for r in records), "max": max(r["max"] for r in records)}


def descriptive_stats(rows: DataFrame, numerical: list[str], nominal: list[str], datasets: list[str] | None = None, min_rows: int = MIN_ROWS) -> dict[str, Any]:
    """Variable-based records (all rows) and model-based ones (rows complete in all variables), per
    dataset and over all; null where a dataset or its non-null values are fewer than ``min_rows``."""
    names = [*numerical, *nominal]
    rows = rows.select(DATASET, *[F.col(f"`{c}`") for c in names])
    out = {}
    for kind, part in (("variable_based", rows), ("model_based", rows.dropna(subset=names) if names else rows)):
        data: dict[tuple[str, str], dict[str, Any] | None] = {}
        if numerical:
            for r in numeric_summary(part, numerical).collect():
                record = r.asDict()
                key = record.pop("variable"), record.pop(DATASET)
                data[key] = record if record["num_total"] >= min_rows and record["num_dtps"] >= min_rows else None
        if nominal:
            found: dict[tuple[str, str], dict[str | None, int]] = {}
            for r in nominal_summary(part, nominal).collect():
                found.setdefault((r.variable, r[DATASET]), {})[r.value] = r.n
            for key, levels in found.items():
                total, na = sum(levels.values()), levels.pop(None, 0)
                data[key] = {"num_dtps": total - na, "num_na": na, "num_total": total, "counts": levels} if total >= min_rows and total - na >= min_rows else None
        wanted = list(datasets or sorted({d for _, d in data}))
        records = [{"variable": v, "dataset": d, "data": data.get((v, d))} for v in names for d in wanted]
        for v in names:
            some = [r["data"] for r in records if r["variable"] == v and r["data"]]
            records.append({"variable": v, "dataset": "all datasets", "data": _merge(some, len(some) == 1) if some else None})
        for r in records:
            r["data"] = {k: x for k, x in r["data"].items() if k not in ("sx", "sxx")} if r["data"] else None
        out[kind] = records
    return out


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    return np.linspace(low, high if high != low else low + 1.0, max(1, int(round(bins))) + 1).tolist()


def bin_of(value: Column, edges: list[float]) -> Column:
    """0-based bin by comparison with the inner edges as they are; the last bin is closed."""
    inner = edges[1:-1]
    return F.aggregate(F.array(*[F.lit(e) for e in inner]), F.lit(0), lambda n, e: n + F.when(value >= e, 1).otherwise(0)) if inner else F.lit(0)


def masked(count: Column, min_rows: int) -> Column:
    return F.when(count >= min_rows, count)


def _levels(rows: DataFrame, name: str, enumerations: dict[str, list] | None) -> list[str]:
    if enumerations and enumerations.get(name):
        return [str(c) for c in enumerations[name]]
    return [str(r[0]) for r in rows.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).collect()]


def _code(name: str) -> Column:
    """A value as its enumeration's code: whole floating numbers without the fraction."""
    c = F.col(f"`{name}`")
    number = F.expr(f"try_cast(`{name}` as double)")
    whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("long").cast("string")).otherwise(c.cast("string"))


def multiple_histograms(rows: DataFrame, y: str, x: list[str] | None = None, bins: int = 20, categorical: bool = False, enumerations: dict[str, list] | None = None, min_rows: int = MIN_ROWS) -> dict[str, Any]:
    """Counts of y by bin (or level), for all rows and by every level of every x; counts below ``min_rows`` are null."""
    x = list(x or [])
    if categorical:
        names = _levels(rows, y, enumerations)
        shown: list = names
        place = F.array_position(F.array(*[F.lit(n) for n in names]), _code(y)).cast("int") - 1
    else:
        v = F.col(f"`{y}`").cast("double")
        low, high, n = rows.agg(F.min(v), F.max(v), F.count(v)).first()
        if not n:
            raise BadUserInput("No data available to compute histogram.")
        shown = bin_edges(low, high, bins)
        names = shown[:-1]
        place = bin_of(v, shown)
    # the histogram and all the grouped ones in one job: each row counts once for itself and once an x
    keys = F.array(F.struct(F.lit(None).cast("string").alias("g"), F.lit(None).cast("string").alias("l")), *[F.struct(F.lit(c).alias("g"), _code(c).alias("l")) for c in x])
    counts = rows.select(place.alias("bin"), F.explode(keys).alias("k")).groupBy("k.g", "k.l", "bin").agg(F.count("*").alias("n")).collect()
    found = {(r.g, r.l, r.bin): r.n for r in counts}
    row = lambda g, level: [n if (n := found.get((g, level, k), 0)) >= max(min_rows, 0) else None for k in range(len(names))]
    out = [{"var": y, "grouping_var": None, "grouping_enum": None, "bins": shown, "counts": row(None, None)}]
    for g in x:
        out += [{"var": y, "grouping_var": g, "grouping_enum": level, "bins": shown, "counts": row(g, level)} for level in _levels(rows, g, enumerations)]
    return {"histogram": out}
