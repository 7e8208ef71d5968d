"""Naive Bayes, Gaussian and categorical: fits are grouped counts and sums, predictions column expressions.

Scores are sums of logarithms, not products, so that many features don't underflow.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.folds import with_fold

SMOOTHING, ALPHA = 1e-9, 1.0


def gaussian_sums(df: DataFrame, y: str, x: list[str], *by: str) -> DataFrame:
    values = [F.col(f"`{c}`").cast("double") for c in x]
    return df.groupBy(F.col(f"`{y}`").cast("string").alias("label"), *by).agg(F.count("*").alias("n"), *[f(v).alias(f"{p}{k}") for k, v in enumerate(values) for p, f in (("s", F.sum), ("q", lambda c: F.sum(c * c)))])


class GaussianNB:
    def __init__(self, labels: list[str], n: np.ndarray, s: np.ndarray, q: np.ndarray):
        keep = n > 0
        self.labels = [c for c, k in zip(labels, keep, strict=True) if k]
        n, s, q = n[keep], s[keep], q[keep]
        self.class_count, self.prior = n, n / n.sum() if n.sum() else n
        self.theta = s / n[:, None]
        var = (q - 2 * self.theta * s + n[:, None] * self.theta**2) / n[:, None]
        floor = SMOOTHING * var.max() if var.size else 0.0
        self.var = np.clip(var, floor if np.isfinite(floor) and floor > 0 else SMOOTHING, None)

    def scores(self, x: list[str]) -> list[Column]:
        out = []
        for c in range(len(self.labels)):
            total = F.lit(math.log(self.prior[c]))
            for k, name in enumerate(x):
                v = F.col(f"`{name}`").cast("double") - F.lit(float(self.theta[c, k]))
                total = total - F.lit(0.5 * math.log(2 * math.pi * self.var[c, k])) - v * v * F.lit(0.5 / float(self.var[c, k]))
            out.append(total)
        return out


class CategoricalNB:
    def __init__(self, labels: list[str], n: np.ndarray, counts: dict[str, dict[tuple[str, str], float]], categories: dict[str, list[str]]):
        keep = n > 0
        self.labels = [c for c, k in zip(labels, keep, strict=True) if k]
        self.class_count, self.categories, self.counts = n[keep], categories, counts
        self.prior = self.class_count / self.class_count.sum() if n.sum() else self.class_count

    def scores(self, x: list[str]) -> list[Column]:
        out = []
        for c, label in enumerate(self.labels):
            total = F.lit(math.log(self.prior[c]))
            for name in x:
                cats = self.categories[name]
                table = F.create_map(*[v for cat in cats for v in (F.lit(cat), F.lit(math.log((self.counts[name].get((label, cat), 0.0) + ALPHA) / (self.class_count[c] + ALPHA * len(cats)))))])
                total = total + F.try_element_at(table, F.col(f"`{name}`").cast("string"))
            out.append(total)
        return out


def predicted(model, x: list[str]) -> Column:
    """The label of the highest score, the first of equals; null without a model or a known category."""
    if not model.labels:
        return F.lit(None).cast("string")
    s = F.array(*model.scores(x))
    return F.get(F.array(*[F.lit(v) for v in model.labels]), (F.array_position(s, F.array_max(s)) - 1).cast("int"))


def fit_gaussian(df: DataFrame, y: str, x: list[str], labels: list[str] | None = None) -> GaussianNB:
    return _gaussian(gaussian_sums(df, y, x).collect(), x, labels)


def _gaussian(rows: list, x: list[str], labels: list[str] | None) -> GaussianNB:
    total: dict[str, np.ndarray] = {}
    for r in rows:
        if r.label is not None:
            total[r.label] = total.get(r.label, 0) + np.array([r.n, *[r[f"s{k}"] for k in range(len(x))], *[r[f"q{k}"] for k in range(len(x))]], float)
    names = list(labels or sorted(total))
    m = np.stack([total.get(c, np.zeros(1 + 2 * len(x))) for c in names]) if names else np.zeros((0, 1 + 2 * len(x)))
    return GaussianNB(names, m[:, 0], m[:, 1 : 1 + len(x)], m[:, 1 + len(x) :])


def categorical_counts(df: DataFrame, y: str, x: list[str], *by: str) -> DataFrame:
    """Per class, variable and category: n; variable null counts the class itself. All variables in one job."""
    pairs = F.array(F.struct(F.lit(None).cast("string").alias("v"), F.lit(None).cast("string").alias("c")), *[F.struct(F.lit(n).alias("v"), F.col(f"`{n}`").cast("string").alias("c")) for n in x])
    return df.select(F.col(f"`{y}`").cast("string").alias("label"), *by, F.explode(pairs).alias("p")).groupBy("label", *by, "p.v", "p.c").agg(F.count("*").alias("n"))


def fit_categorical(df: DataFrame, y: str, x: list[str], categories: dict[str, list[str]] | None = None, labels: list[str] | None = None) -> CategoricalNB:
    return _categorical(categorical_counts(df, y, x).collect(), x, categories, labels)


def _categorical(rows: list, x: list[str], categories: dict[str, list[str]] | None, labels: list[str] | None) -> CategoricalNB:
    n: dict[str, float] = {}
    counts: dict[str, dict[tuple[str, str], float]] = {v: {} for v in x}
    for r in rows:
        if r.label is None:
            continue
        if r.v is None:
            n[r.label] = n.get(r.label, 0) + r.n
        else:
            counts[r.v][r.label, r.c] = counts[r.v].get((r.label, r.c), 0) + r.n
    names = list(labels or sorted(n))
    cats = {v: list((categories or {}).get(v) or sorted({c for _, c in counts[v] if c is not None})) for v in x}
    return CategoricalNB(names, np.array([n.get(c, 0.0) for c in names]), counts, cats)


def multiclass_metrics(m: np.ndarray) -> dict[str, np.ndarray]:
    """One-against-rest accuracy, precision, recall and F of each class; 0 where undefined. Rows are truth."""
    tp, total = np.diag(m).astype(float), m.sum()
    fn, fp = m.sum(1) - tp, m.sum(0) - tp
    tn = total - tp - fn - fp
    with np.errstate(divide="ignore", invalid="ignore"):
        precision, recall = tp / (tp + fp), tp / (tp + fn)
        out = {"accuracy": (tp + tn) / total, "precision": precision, "recall": recall, "fscore": 2 * precision * recall / (precision + recall)}
    return {k: np.nan_to_num(v) for k, v in out.items()}


def multiclass_summary(metrics: list[dict[str, np.ndarray]], labels: list[str], n_obs: list[int]) -> dict[str, Any]:
    """metric, class, fold: value; with the average, and a deviation that counts the average as one value more."""
    out: dict[str, Any] = {}
    for name in ("accuracy", "precision", "recall", "fscore"):
        out[name] = {}
        for k, label in enumerate(labels):
            each = {f"fold{i}": float(m[name][k]) for i, m in enumerate(metrics)}
            each["average"] = float(np.mean(list(each.values())))
            each["stdev"] = float(np.std(list(each.values()), ddof=1))
            out[name][label] = each
    return out | {"n_obs": {f"fold{i}": int(n) for i, n in enumerate(n_obs)}}


def _cross_validate(rows: DataFrame, y: str, x: list[str], n_splits: int, models: dict[int, Any], train: dict[int, int]) -> dict[str, Any]:
    """One scoring pass: every row by the model that has not seen its fold."""
    labels = sorted({c for m in models.values() for c in m.labels})
    pred = F.lit(None).cast("string")
    for k, m in models.items():
        pred = F.when(F.col("fold") == k, predicted(m, x)).otherwise(pred)
    cells = np.zeros((n_splits, len(labels), len(labels)))
    for r in rows.select("fold", F.col(f"`{y}`").cast("string").alias("t"), pred.alias("p")).groupBy("fold", "t", "p").count().collect():
        if r.t in labels and r.p in labels:
            cells[r.fold, labels.index(r.t), labels.index(r.p)] += r["count"]
    return {"confusion_matrix": {"data": cells.sum(0).astype(int).tolist(), "labels": labels}, "classification_summary": multiclass_summary([multiclass_metrics(c) for c in cells], labels, [train[k] for k in range(n_splits)])}


def naive_bayes_gaussian_cv(df: DataFrame, y: str, x: list[str], n_splits: int, order: str) -> dict[str, Any]:
    rows = with_fold(df, n_splits, order).persist()
    sums = gaussian_sums(rows, y, x, "fold").collect()
    models = {k: _gaussian([r for r in sums if r.fold != k], x, None) for k in range(n_splits)}
    train = {k: int(sum(r.n for r in sums if r.fold != k)) for k in range(n_splits)}
    out = _cross_validate(rows, y, x, n_splits, models, train)
    rows.unpersist()
    return out


def naive_bayes_categorical_cv(df: DataFrame, y: str, x: list[str], n_splits: int, order: str, categories: dict[str, list[str]] | None = None) -> dict[str, Any]:
    rows = with_fold(df, n_splits, order).persist()
    counts = categorical_counts(rows, y, x, "fold").collect()
    cats = {v: list((categories or {}).get(v) or sorted({r.c for r in counts if r.v == v and r.c is not None})) for v in x}
    models = {k: _categorical([r for r in counts if r.fold != k], x, cats, None) for k in range(n_splits)}
    train = {k: int(sum(r.n for r in counts if r.fold != k and r.v is None)) for k in range(n_splits)}
    out = _cross_validate(rows, y, x, n_splits, models, train)
    rows.unpersist()
    return out
