"""A round: all the sums, minima and maxima that a step needs, in one Spark aggregation."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Round:
    """Collects named expressions; ``run`` makes one job of them and returns arrays by name.

    >>> r = Round(); r.sum("n", F.lit(1.0)); r.max("top", F.col("v")); r.run(df)["top"]
    """

    def __init__(self) -> None:
        self._parts: dict[str, list[Column]] = {}

    def _add(self, name: str, how, columns: tuple[Column, ...]) -> Round:
        self._parts.setdefault(name, []).extend(how(c.cast("double")) for c in columns)
        return self

    def sum(self, name: str, *columns: Column) -> Round:
        return self._add(name, F.sum, columns)

    def min(self, name: str, *columns: Column) -> Round:
        return self._add(name, F.min, columns)

    def max(self, name: str, *columns: Column) -> Round:
        return self._add(name, F.max, columns)

    def columns(self) -> list[Column]:
        return [c.alias(f"{name}__{k}") for name, cs in self._parts.items() for k, c in enumerate(cs)]

    def _read(self, row) -> dict[str, np.ndarray]:
        return {name: np.array([0.0 if row[f"{name}__{k}"] is None else row[f"{name}__{k}"] for k in range(len(cs))], float) for name, cs in self._parts.items()}

    def run(self, df: DataFrame) -> dict[str, np.ndarray]:
        return self._read(df.agg(*self.columns()).first())

    def run_by(self, df: DataFrame, *keys: str) -> dict:
        """The same for every value of the keys (folds, sites, categories): still one job."""
        return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: self._read(r) for r in df.groupBy(*keys).agg(*self.columns()).collect()}


#: Columns up to which products are summed by generated code; beyond, blocks of rows are multiplied in numpy.
WIDE = 30


def gram_columns(columns: list[Column]) -> list[Column]:
    """Products of all pairs i <= j."""
    return [columns[i] * columns[j] for i, j in combinations_with_replacement(range(len(columns)), 2)]


def unpack_gram(values: Iterable[float], p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for (i, j), v in zip(combinations_with_replacement(range(p), 2), values, strict=True):
        out[i, j] = out[j, i] = v
    return out


def gram(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """X'X of the columns in one job."""
    p = len(columns)
    if p <= WIDE:
        return unpack_gram(Round().sum("g", *gram_columns(columns)).run(df)["g"], p)

    def partial(batches):
        import pyarrow as pa

        total = np.zeros((p, p))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1).astype(float) if b.num_rows else np.zeros((0, p))
            total += x.T @ x
        i, j = np.triu_indices(p)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(i), dtype=np.int32)), pa.array(total[i, j])], names=["k", "v"])

    each = df.select(*[c.cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(partial, "k int, v double")
    sums = {r.k: r.v for r in each.groupBy("k").agg(F.sum("v").alias("v")).collect()}
    return unpack_gram([sums.get(k, 0.0) for k in range(p * (p + 1) // 2)], p)


def summed(df: DataFrame, columns: list[Column], keys: Column, sums) -> dict[int, np.ndarray]:
    """For each key, the sum over its rows of a vector that ``sums(key, x)`` makes of a block of rows x.

    ``keys`` is an array of whole numbers a row, those that the row counts for. Blocks are multiplied in
    numpy where they are, and one row a key, task and place in the vector goes on.
    """
    p = len(columns)

    def partial(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:p]], 1).astype(float)
            of = b.column(p)
            row, key = pa.compute.list_parent_indices(of).to_numpy(), of.flatten().to_numpy()
            for k in np.unique(key).tolist():
                got = sums(k, x[row[key == k]])
                total[k] = total[k] + got if k in total else got
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["key", "at", "v"])

    each = df.select(*[c.cast("double").alias(f"c{k}") for k, c in enumerate(columns)], keys.cast("array<int>").alias("keys")).mapInArrow(partial, "key int, at int, v double")
    out: dict[int, dict[int, float]] = {}
    for r in each.groupBy("key", "at").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r.key, {})[r["at"]] = r.v
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}
