"""Learners that fit within each site and are averaged: SVM, FedAvg, bagged boosted trees.

A site's rows meet in one task only as sums: the SVM is solved from sums of losses and slopes,
and trees are grown from histograms.
"""

from __future__ import annotations

import math
from itertools import combinations
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadUserInput
from ..plans.cohort import SITE
from ..plans.design import linear
from ..plans.rounds import Round


def fed_average(per_site: dict[str, dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Unweighted mean of each parameter over the sites."""
    names = next(iter(per_site.values())).keys() if per_site else ()
    return {n: np.mean([np.asarray(p[n], float) for p in per_site.values()], axis=0) for n in names}


def svm_linear(df: DataFrame, y: str, x: list[str], C: float = 1.0, gamma: float | None = None, site: str = SITE, iterations: int = 200) -> dict[str, Any]:  # noqa: N803
    """Hinge-loss linear SVM of each site and pair of its classes, and the mean over pairs and then sites.

    Solved by cutting planes: each round is one grouped aggregation for all sites and pairs that gives
    the loss and a subgradient at one point, and a small quadratic program over the planes so far gives
    the next, until the planes prove that the objective is within a thousandth of its minimum (or after
    ``iterations`` rounds). ``gamma`` has no part in a linear kernel. Of two classes the one that sorts
    last is positive, of more the first of a pair. Support vectors are summed up as their mean.
    """
    columns = [F.col(f"`{c}`").cast("double") for c in x]
    target = F.col(f"`{y}`").cast("string")
    df = df if site in df.columns else df.withColumn(site, F.lit("all"))
    classes = {r[0]: sorted(r[1]) for r in df.groupBy(site).agg(F.collect_set(target)).collect()}
    for s, found in classes.items():
        if len(found) < 2:
            raise BadUserInput(f"The number of classes has to be greater than one; site {s} has {len(found)}.")
    pairs = {s: list(combinations(f, 2)) for s, f in classes.items()}
    every = sorted({p for ps in pairs.values() for p in ps})
    sign = {p: F.when(target == p[1], 1.0).when(target == p[0], -1.0) for p in every}
    rows = df.select(site, *x, y).persist()
    r = Round().sum("n", F.lit(1)).sum("s", *columns).sum("q", *[c * c for c in columns])
    for k, p in enumerate(every):
        r.sum(f"p{k}", F.when(sign[p].isNotNull(), 1.0))
    stats = r.run_by(rows, site)
    mean = {s: v["s"] / v["n"][0] for s, v in stats.items()}
    sd = {s: np.sqrt(np.maximum(v["q"] / v["n"][0] - mean[s] ** 2, 0)) for s, v in stats.items()}
    sd = {s: np.where(v == 0, 1, v) for s, v in sd.items()}
    scaled = [_by_site(site, {s: (mean[s][k], sd[s][k]) for s in stats}, lambda p, c=c: (c - F.lit(float(p[0]))) / F.lit(float(p[1]))) for k, c in enumerate(columns)]
    fits = {(s, p): _Planes(1 / (C * stats[s][f"p{every.index(p)}"][0]), np.append(1 / sd[s] ** 2, 1.0)) for s in stats for p in pairs[s]}
    for _ in range(iterations):
        open_ = {key: m for key, m in fits.items() if not m.done}
        if not open_:
            break
        r = Round()
        for k, p in enumerate(every):
            if at := {s: m.point for (s, q), m in open_.items() if q == p}:
                margin = sign[p] * _by_site(site, at, lambda b: linear([*scaled, F.lit(1.0)], b))
                short = F.when(margin < 1, sign[p]).otherwise(F.when(margin.isNotNull(), 0.0))
                r.sum(f"l{k}", F.greatest(1 - margin, F.lit(0.0))).sum(f"g{k}", *[short * c for c in scaled], short)
        got = r.run_by(rows, site)
        for (s, p), m in open_.items():
            k, n = every.index(p), stats[s][f"p{every.index(p)}"][0]
            m.add(float(got[s][f"l{k}"][0]) / n, -got[s][f"g{k}"] / n)
    near = F.lit(False)
    for p in every:
        at = {s: m.best for (s, q), m in fits.items() if q == p}
        near |= F.coalesce(sign[p] * _by_site(site, at, lambda b: linear([*scaled, F.lit(1.0)], b)) <= 1 + 1e-3, F.lit(False))
    support = Round().sum("v", F.when(near, 1.0), *[F.when(near, c) for c in columns]).run_by(rows, site)
    rows.unpersist()
    per = {}
    for s in stats:
        toward = 1 if len(classes[s]) == 2 else -1
        w = [toward * fits[s, p].best[:-1] / sd[s] for p in pairs[s]]
        b = [toward * fits[s, p].best[-1] - (v * mean[s]).sum() for p, v in zip(pairs[s], w, strict=True)]
        v = support[s]["v"]
        per[s] = {"weights": np.mean(w, 0), "intercept": np.array([np.mean(b)]), "support": v[1:] / max(v[0], 1)}
    fit = {k: v.tolist() for k, v in fed_average(per).items()}
    total = int(sum(v["n"][0] for v in stats.values()))
    return {"title": "SVM Result", "n_obs": total, "coeff": fit["weights"], "support_vectors": fit["support"], "weights": fit["weights"], "intercept": fit["intercept"], "classes": sorted({c for f in classes.values() for c in f})}


class _Planes:
    """Cutting planes under a convex loss L: the w of least ``ridge``/2 sum(scale * w**2) + L(w)."""

    def __init__(self, ridge: float, scale: np.ndarray):
        self.ridge, self.scale = ridge, scale
        self.slopes, self.levels, self.weights = np.zeros((0, len(scale))), np.zeros(0), np.zeros(0)
        self.best, self.least, self.point, self.done = np.zeros(len(scale)), math.inf, np.zeros(len(scale)), False

    def add(self, loss: float, slope: np.ndarray) -> None:
        """The loss and a subgradient at ``point``; moves the point to between the best one and the planes' own."""
        value = loss + self.ridge / 2 * (self.scale * self.point**2).sum()
        if value < self.least:
            self.best, self.least = self.point, value
        self.slopes, self.levels = np.vstack((self.slopes, slope)), np.append(self.levels, loss - slope @ self.point)
        self.weights = np.append(self.weights, 0.0 if len(self.weights) else 1.0)
        own, bound = self._solve()
        self.done = self.least - bound <= 1e-3 * self.least
        self.point = (self.best + own) / 2

    def _solve(self) -> tuple[np.ndarray, float]:
        """The planes' own minimum, by its dual with an active set of planes, and a bound under the objective."""
        q = self.slopes @ (self.slopes / self.scale).T / self.ridge
        a = self.weights
        for _ in range(20 * len(a)):
            on = np.flatnonzero(a > 0)
            k = len(on)
            system = np.ones((k + 1, k + 1))
            system[:k, :k], system[k, k] = q[np.ix_(on, on)] + 1e-12 * np.trace(q) / len(a) * np.eye(k), 0
            want = np.linalg.lstsq(system, np.append(self.levels[on], 1), rcond=None)[0][:k]
            low = np.flatnonzero(want < 0)
            if len(low):  # as far as weights stay positive; the first that ends leaves the set
                far = a[on][low] / (a[on][low] - want[low])
                first = int(np.argmin(far))
                a[on] += far[first] * (want - a[on])
                a[on[low[first]]] = 0
                a[:] = np.maximum(a, 0) / np.maximum(a, 0).sum()
                continue
            a[on] = want / want.sum()
            g = self.levels - q @ a
            i = int(np.argmax(np.where(a > 0, -np.inf, g))) if k < len(a) else -1
            if i < 0 or g[i] <= g[a > 0].max() + 1e-9 * max(1.0, abs(self.least)):
                break
            # the new plane takes weight from the others as far as that helps
            d = -a.copy()
            d[i] += 1
            a += min(0.5, max(1e-12, (g @ d) / max(d @ q @ d, 1e-300))) * d
        self.weights = a
        return -(self.slopes.T @ a) / self.scale / self.ridge, float(self.levels @ a - a @ q @ a / 2)


def _by_site(site: str, values: dict, make) -> Column:
    out = F.lit(None).cast("double")
    for s, v in values.items():
        out = F.when(F.col(site) == F.lit(s), make(v)).otherwise(out)
    return out


def fedavg_logistic(df: DataFrame, columns: list[Column], target: Column, rounds: int = 5, site: str = SITE, step: float = 1.0, ridge: float = 1.0, evaluate: DataFrame | None = None) -> dict[str, Any]:
    """FedAvg: every site takes one penalised step from the shared weights, and the weights become the
    row-weighted mean of the sites'. One grouped aggregation a round serves all sites. The accuracy is
    that on ``evaluate``, if given and not empty, else on the training rows."""
    df = df if site in df.columns else df.withColumn(site, F.lit("all"))
    beta = np.zeros(len(columns))
    for _ in range(rounds):
        mu = 1 / (1 + F.exp(-linear(columns, beta)))
        w = mu * (1 - mu)
        got = Round().sum("n", F.lit(1)).sum("g", *[c * (target - mu) for c in columns]).sum("h", *[c * c * w for c in columns]).run_by(df, site)
        new, total = np.zeros(len(columns)), 0.0
        for r in got.values():
            own = beta + step * (r["g"] - ridge * beta) / (r["h"] + ridge)
            new += r["n"][0] * own
            total += r["n"][0]
        beta = new / total
    hit = F.when((linear(columns, beta) >= 0) == (target == 1), 1.0).otherwise(0.0)
    counts = Round().sum("a", F.lit(1), hit)
    s = counts.run(evaluate)["a"] if evaluate is not None else np.zeros(2)
    s = s if s[0] else counts.run(df)["a"]
    return {"accuracy": float(s[1] / s[0]), "coefficients": beta.tolist()}


def binary_auc(df: DataFrame, score: Column, target: Column, bins: int = 10_000) -> float:
    """Area under the ROC curve of a score in [0, 1] from its histogram; ties within a bin count half."""
    rows = df.select(F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int").alias("b"), target.alias("t")).groupBy("b").agg(F.sum("t").alias("p"), F.count("*").alias("n")).collect()
    area, negatives = 0.0, 0.0
    for r in sorted(rows, key=lambda r: r.b):
        area += r.p * (negatives + 0.5 * (r.n - r.p))
        negatives += r.n - r.p
    positives = sum(r.p for r in rows)
    return area / (positives * negatives) if positives and negatives else 0.0


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many cuts the value exceeds."""
    if not cuts:
        return F.lit(0)
    return F.aggregate(F.array(*[F.lit(float(e)) for e in cuts]), F.lit(0), lambda n, e: n + F.when(value > e, 1).otherwise(0))


def boosted_trees(df: DataFrame, x: list[str], target: Column, rounds: int = 5, depth: int = 8, rate: float = 0.1, bins: int = 32, site: str = SITE, ridge: float = 1.0) -> dict[str, Any]:
    """Bagged boosting: every round each site grows one histogram tree on its own rows and the trees'
    leaf values add up. Every level of all sites' trees is one pass, which sums gradients by site, node
    and bin in numpy where the rows are; the last level's sums also give the leaves."""
    df = df if site in df.columns else df.withColumn(site, F.lit("all"))
    values = [F.col(f"`{c}`").cast("double") for c in x]
    cuts = df.agg(*[F.percentile_approx(v, [k / bins for k in range(1, bins)], 10_000).alias(f"c{i}") for i, v in enumerate(values)]).first()
    cuts = [sorted(set(cuts[f"c{i}"] or [])) for i in range(len(x))]
    sites = sorted(r[0] for r in df.select(F.col(site).cast("string")).distinct().collect())
    number = F.array_position(F.array(*[F.lit(s) for s in sites]), F.col(site).cast("string")) - 1
    binned = df.select(number.cast("int").alias("s"), target.cast("double").alias("y"), *[_bin(v, c).cast("int").alias(f"b{i}") for i, (v, c) in enumerate(zip(values, cuts, strict=True))]).persist()
    done: list[list[tuple]] = []  # of each round the sites' trees: features, cuts and leaves by node
    aucs = []
    for k in range(rounds):
        trees = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in sites]
        for level in range(depth):
            sums = np.zeros((len(sites), 2**level, 2, len(x), bins))
            for r in binned.mapInArrow(_histograms(done, trees, level, len(x), bins), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
                sums.reshape(-1)[r["at"]] = r.v
            best = [[_best_split(*sums[s, at], ridge) for at in range(2**level)] for s in range(len(sites))]
            trees = [(np.append(f, [b[0] for b in best[s]]).astype(np.int64), np.append(c, [b[1] for b in best[s]]).astype(np.int64)) for s, (f, c) in enumerate(trees)]
        leaves = []
        for s in range(len(sites)):
            sides = []
            for at in range(2 ** (depth - 1)):
                f, c = best[s][at]
                g, h = sums[s, at, 0, f], sums[s, at, 1, f]
                sides += [-rate * g[: c + 1].sum() / (h[: c + 1].sum() + ridge), -rate * g[c + 1 :].sum() / (h[c + 1 :].sum() + ridge)]
            leaves.append(np.array(sides))
        done = [*done, [(f, c, v) for (f, c), v in zip(trees, leaves, strict=True)]]
        if k in (0, rounds - 1):
            aucs.append(binary_auc(binned.mapInArrow(_scores(done, len(x)), "score double, y double"), F.col("score"), F.col("y")))
    binned.unpersist()
    return {"AUC": aucs[-1], "initial_auc": aucs[0], "auc_ascending": "correct" if aucs[0] - aucs[-1] <= 0.15 else "not correct"}


def _walk(rows: np.ndarray, features: np.ndarray, cuts: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row of bins reaches after so many levels of a tree."""
    node, each = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for level in range(levels):
        k = 2**level - 1 + node
        node = 2 * node + (rows[each, features[k]] > cuts[k])
    return node


def _scored(done: list, rows: np.ndarray) -> np.ndarray:
    """The probability after these rounds; every site's trees score all rows, as the ensemble is shared."""
    score = np.zeros(len(rows))
    for trees in done:
        for f, c, v in trees:
            score += v[_walk(rows, f, c, (len(v) - 1).bit_length())]
    return 1 / (1 + np.exp(-score))


def _block(b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]], 1).astype(np.int64)


def _histograms(done: list, trees: list, level: int, width: int, bins: int):
    def run(batches):
        import pyarrow as pa

        total = np.zeros((len(trees), 2**level, 2, width, bins))
        for b in batches:
            s, y, rows = _block(b)
            p = _scored(done, rows)
            for k, (f, c) in enumerate(trees):
                mine = np.flatnonzero(s == k)
                node = _walk(rows[mine], f, c, level)
                for i, v in enumerate((p - y, p * (1 - p))):
                    for j in range(width):
                        total[k, :, i, j] += np.bincount(node * bins + rows[mine, j], v[mine], 2**level * bins).reshape(-1, bins)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total.reshape(-1)[some])], names=["at", "v"])

    return run


def _scores(done: list, width: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            _, y, rows = _block(b)
            yield pa.RecordBatch.from_arrays([pa.array(_scored(done, rows)), pa.array(y)], names=["score", "y"])

    return run


def _best_split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[int, int]:
    cg, ch = g.cumsum(1), h.cumsum(1)
    tg, th = cg[:, -1:], ch[:, -1:]
    gain = cg**2 / (ch + ridge) + (tg - cg) ** 2 / (th - ch + ridge) - tg**2 / (th + ridge)
    return tuple(int(v) for v in np.unravel_index(np.argmax(gain), gain.shape))
