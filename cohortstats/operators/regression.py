"""Linear and logistic regression, alone and cross-validated.

Ordinary least squares is two aggregations (the products, then the residuals). Newton's method is
one aggregation an iteration; cross-validation runs all folds of an iteration in the same one.
"""

from __future__ import annotations

import math
import statistics
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadUserInput
from ..functions.special import f_sf, norm_ppf, norm_sf, t_ppf, t_sf
from ..plans.design import design, linear, observed_levels, split_variables
from ..plans.folds import with_fold
from ..plans.rounds import WIDE, Round, gram, gram_columns, summed, unpack_gram

ALPHA, MAX_ITER, TOL = 0.05, 50, 1e-4


def matrix_of(df: DataFrame, x: list[str], categorical: list[str] | None = None) -> tuple[list[str], list[Column]]:
    cats, nums = split_variables(df, x, categorical)
    return design(observed_levels(df, cats), nums)


def linear_summary(beta: np.ndarray, inverse: np.ndarray, rss: float, tss: float, n: int, p: int) -> dict[str, Any]:
    """``p``: columns besides the intercept."""
    df_resid = n - p - 1
    if df_resid <= 0 or n <= 0:
        nan = [math.nan] * len(beta)
        return {"n_obs": n, "df_resid": float(df_resid), "df_model": float(p), "rse": math.nan, "r_squared": 0.0, "r_squared_adjusted": 0.0, "f_stat": math.nan, "f_pvalue": math.nan, "coefficients": beta.tolist(), "std_err": nan, "t_stats": nan, "pvalues": nan, "lower_ci": nan, "upper_ci": nan}
    rse = math.sqrt(rss / df_resid)
    se = np.sqrt(np.maximum(np.diag(inverse), 0)) * rse
    t = np.divide(beta, se, out=np.zeros_like(beta), where=se != 0)
    crit = t_ppf(1 - ALPHA / 2, df_resid)
    r2 = 1 - rss / tss if tss > 0 else 0.0
    f = math.inf if rss == 0 or p == 0 else (tss - rss) * df_resid / (p * rss)
    return {
        "n_obs": n, "df_resid": float(df_resid), "df_model": float(p), "rse": rse, "r_squared": r2, "r_squared_adjusted": 1 - (1 - r2) * (n - 1) / df_resid,
        "f_stat": f, "f_pvalue": 0.0 if math.isinf(f) else f_sf(f, p, df_resid), "coefficients": beta.tolist(), "std_err": se.tolist(), "t_stats": t.tolist(),
        "pvalues": [2 * t_sf(abs(v), df_resid) for v in t], "lower_ci": (beta - crit * se).tolist(), "upper_ci": (beta + crit * se).tolist(),
    }


def linear_regression(df: DataFrame, y: str, x: list[str], categorical: list[str] | None = None) -> dict[str, Any]:
    labels, columns = matrix_of(df, x, categorical)
    v = F.col(f"`{y}`").cast("double")
    g = gram(df, [*columns, v])
    n, p = int(round(g[0, 0])), len(columns) - 1
    inverse = np.linalg.pinv(g[:-1, :-1])
    beta = inverse @ g[:-1, -1]
    mean = g[0, -1] / n if n else 0.0
    residual = v - linear(columns, beta)
    s = Round().sum("r", residual * residual, (v - mean) * (v - mean)).run(df)
    return {"dependent_var": y, "indep_vars": labels, **linear_summary(beta, inverse, float(s["r"][0]), float(s["r"][1]), n, p)}


def _by_fold(values: dict[int, Any], make) -> Column:
    """A column whose value depends on the fold."""
    out = F.lit(None).cast("double")
    for k in sorted(values):
        out = F.when(F.col("fold") == k, make(values[k])).otherwise(out)
    return out


def linear_regression_cv(df: DataFrame, y: str, x: list[str], n_splits: int, order: str, categorical: list[str] | None = None) -> dict[str, Any]:
    """Contiguous k-fold errors. One pass sums products by fold; a fold's training sums are the total
    less its own, so no fold reads the data again but for the absolute residuals. What is named
    mean_sq_error is its root."""
    labels, columns = matrix_of(df, x, categorical)
    v, p = F.col(f"`{y}`").cast("double"), len(columns) - 1
    rows = with_fold(df, n_splits, order)
    m = len(columns) + 1
    if m > WIDE + 1:
        parts = {k: g.reshape(m, m) for k, g in summed(rows, [*columns, v], F.array("fold"), lambda _, b: (b.T @ b).ravel()).items()}
    else:
        parts = {k: unpack_gram(r["g"], m) for k, r in Round().sum("g", *gram_columns([*columns, v])).run_by(rows, "fold").items()}
    total = sum(parts.values())
    beta, n_train = {}, {}
    for k, g in parts.items():
        t = total - g
        beta[k], n_train[k] = np.linalg.pinv(t[:-1, :-1]) @ t[:-1, -1], int(round(t[0, 0]))
    residual = v - _by_fold(beta, lambda b: linear(columns, b))
    scored = Round().sum("n", F.lit(1)).sum("r", residual * residual, F.abs(residual)).sum("y", v, v * v).run_by(rows, "fold")
    rmse, r2, mae, fs = [], [], [], []
    for k in sorted(parts):
        n, (rss, ab), (sy, qy) = scored[k]["n"][0], scored[k]["r"], scored[k]["y"]
        tss, dof = qy - sy * sy / n if n else 0.0, n_train[k] - p - 1
        ok = dof > 0 and n and rss > 0 and tss > 0 and p > 0
        rmse.append(math.sqrt(rss / n) if ok else 0.0)
        r2.append(1 - rss / tss if ok else 0.0)
        mae.append(ab / n if ok else 0.0)
        fs.append((tss - rss) * dof / (p * rss) if ok else 0.0)
    both = lambda v: {"mean": float(np.mean(v)), "std": float(np.std(v, ddof=1))}
    return {"dependent_var": y, "indep_vars": labels, "n_obs": [n_train[k] for k in sorted(parts)], "mean_sq_error": both(rmse), "r_squared": both(r2), "mean_abs_error": both(mae), "f_stat": both(fs)}


def positive(y: str, positive_class) -> Column:
    """1 where y is the positive class, compared as text so that 1 and "1" are one class."""
    return F.when(F.col(f"`{y}`").cast("string") == F.lit(str(positive_class)), 1.0).otherwise(0.0)


def newton(rows: DataFrame, columns: list[Column], target: Column, held_out: list[int] | None = None) -> dict[int, dict[str, Any]]:
    """Newton's method from zero for one model (key -1), or for one model a held-out fold of column ``fold``.

    Each iteration is one aggregation for all models that still move. The gradient, Hessian and
    likelihood returned belong to the coefficients before the last step, the coefficients to after it.
    """
    keys = [-1] if held_out is None else list(held_out)
    p = len(columns)
    inside = {k: F.lit(True) if k == -1 else F.col("fold") != k for k in keys}
    first = Round()
    for k in keys:
        first.sum(f"m{k}", F.when(inside[k], 1.0), F.when(inside[k], target))
    sums = first.run(rows)
    out: dict[int, dict[str, Any]] = {}
    for k in keys:
        n, ones = sums[f"m{k}"]
        if n <= p:
            # fixed text: clients match this message
            raise BadUserInput("Logistic regression cannot run because the number of observations is smaller than the number of predictors.")
        if min(ones, n - ones) <= p:
            # fixed text: clients match this message
            raise BadUserInput("Logistic regression cannot run because the number of observations in one category is smaller than the number of predictors.")
        out[k] = {"n_obs": int(n), "y_sum": float(ones), "beta": np.zeros(p), "done": False}
    for _ in range(MAX_ITER):
        moving = [k for k in keys if not out[k]["done"]]
        if not moving:
            return out
        s = _wide_step(rows, columns, target, {k: out[k]["beta"] for k in moving}) if p > WIDE else _step(rows, columns, target, {k: out[k]["beta"] for k in moving}, inside)
        for k in moving:
            h = unpack_gram(s[f"h{k}"], p)
            try:
                inverse = np.linalg.inv(h)
            except np.linalg.LinAlgError:
                inverse = np.linalg.pinv(h)
            grad = s[f"g{k}"]
            out[k].update(beta=out[k]["beta"] + inverse @ grad, inverse=inverse, ll=float(s[f"l{k}"][0]), done=bool(np.abs(grad).max() <= TOL))
    if all(m["done"] for m in out.values()):
        return out
    # fixed text: clients match this message
    raise BadUserInput("Logistic regression cannot converge. Cancelling run.")


def _step(rows: DataFrame, columns: list[Column], target: Column, betas: dict[int, np.ndarray], inside: dict[int, Column]) -> dict[str, np.ndarray]:
    """Gradient, Hessian (its upper triangle) and log likelihood of each model in one aggregation."""
    r = Round()
    for k, beta in betas.items():
        # the likelihood in a form that large scores don't overflow
        eta = linear(columns, beta)
        mu = 1 / (1 + F.exp(-eta))
        w = mu * (1 - mu)
        only = lambda c, k=k: F.when(inside[k], c)
        r.sum(f"g{k}", *[only(c * (target - mu)) for c in columns]).sum(f"h{k}", *[only(g * w) for g in gram_columns(columns)])
        r.sum(f"l{k}", only(target * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))))
    return r.run(rows)


def _wide_step(rows: DataFrame, columns: list[Column], target: Column, betas: dict[int, np.ndarray]) -> dict[str, np.ndarray]:
    """The same for many columns: blocks of rows are multiplied in numpy."""
    p = len(columns)
    upper = np.triu_indices(p)

    def sums(k: int, block: np.ndarray) -> np.ndarray:
        x, t = block[:, :p], block[:, p]
        eta = x @ betas[k]
        mu = 1 / (1 + np.exp(-eta))
        likely = t * eta - np.maximum(eta, 0) - np.log1p(np.exp(-np.abs(eta)))
        return np.concatenate((x.T @ (t - mu), (x.T @ (x * (mu * (1 - mu))[:, None]))[upper], [likely.sum()]))

    keys = F.array(*[F.lit(k) for k in betas])
    got = summed(rows, [*columns, target], keys if -1 in betas else F.array_except(keys, F.array("fold")), sums)
    out = {}
    for k, v in got.items():
        out |= {f"g{k}": v[:p], f"h{k}": v[p:-1], f"l{k}": v[-1:]}
    return out


def _xlogy(x: float, y: float) -> float:
    return 0.0 if x == 0 else x * math.log(y) if y > 0 else -math.inf


def logistic_regression(df: DataFrame, y: str, x: list[str], positive_class, categorical: list[str] | None = None) -> dict[str, Any]:
    labels, columns = matrix_of(df, x, categorical)
    rows = df.select(*df.columns).persist()
    try:
        m = newton(rows, columns, positive(y, positive_class))[-1]
    finally:
        rows.unpersist()
    beta, n, ll = m["beta"], m["n_obs"], m["ll"]
    se = np.sqrt(np.maximum(np.diag(m["inverse"]), 0))
    z = np.divide(beta, se, out=np.zeros_like(beta), where=se != 0)
    crit = norm_ppf(1 - ALPHA / 2)
    mean, p = m["y_sum"] / n, len(beta)
    ll0 = _xlogy(m["y_sum"], mean) + _xlogy(n - m["y_sum"], 1 - mean)
    summary = {
        "n_obs": n, "coefficients": beta.tolist(), "stderr": se.tolist(), "lower_ci": (beta - crit * se).tolist(), "upper_ci": (beta + crit * se).tolist(), "z_scores": z.tolist(),
        "pvalues": [2 * norm_sf(abs(v)) for v in z], "df_model": p - 1, "df_resid": n - p, "r_squared_cs": 1 - math.exp(2 * (ll0 - ll) / n),
        "r_squared_mcf": 1.0 if math.isclose(ll, 0, abs_tol=1e-8) and math.isclose(ll0, 0, abs_tol=1e-8) else 1 - ll / ll0, "ll0": ll0, "ll": ll, "aic": 2 * p - 2 * ll, "bic": math.log(n) * p - 2 * ll,
    }
    return {"dependent_var": y, "indep_vars": labels, "summary": summary}


def binary_metrics(tp: int, fp: int, tn: int, fn: int) -> dict[str, float]:
    ratio = lambda a, b: a / b if b else 0.0
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": precision, "recall": recall, "fscore": ratio(2 * precision * recall, precision + recall)}


def roc_from_counts(positives: np.ndarray, negatives: np.ndarray) -> tuple[list[float], list[float], float]:
    """tpr, fpr and area from the scores' counts in bins [k/100, (k+1)/100): at threshold k/100 counts all bins from k on."""
    tp, fp = positives[::-1].cumsum()[::-1], negatives[::-1].cumsum()[::-1]
    tpr = tp / positives.sum() if positives.sum() else np.zeros(len(tp))
    fpr = fp / negatives.sum() if negatives.sum() else np.zeros(len(fp))
    return tpr.tolist(), fpr.tolist(), float(abs(np.trapezoid(tpr, fpr)))


def logistic_regression_cv(df: DataFrame, y: str, x: list[str], positive_class, n_splits: int, order: str, categorical: list[str] | None = None) -> dict[str, Any]:
    """All folds' models in the same Newton iterations, then one pass of scoring: the scores' bins give
    the 101-point ROC curves, those from 0.5 on the confusion counts."""
    labels, columns = matrix_of(df, x, categorical)
    target = positive(y, positive_class)
    rows = with_fold(df, n_splits, order).persist()
    models = newton(rows, columns, target, list(range(n_splits)))
    score = 1 / (1 + F.exp(-_by_fold({k: m["beta"] for k, m in models.items()}, lambda b: linear(columns, b))))
    # the bin by comparison with the thresholds as they are, not by a rounded product
    grid = F.array(*[F.lit(float(t)) for t in np.linspace(0, 1, 101)])
    near = F.floor(score * 100).cast("int")
    bin_ = F.when(F.get(grid, near + 1) <= score, near + 1).when(F.get(grid, near) > score, near - 1).otherwise(near)
    counts = rows.select("fold", target.alias("t"), bin_.alias("bin")).groupBy("fold", "bin", "t").count().collect()
    rows.unpersist()
    pos, neg = np.zeros((n_splits, 101)), np.zeros((n_splits, 101))
    for r in counts:
        (pos if r.t == 1 else neg)[r.fold, r.bin] = r["count"]
    cells = [(int(pos[k, 50:].sum()), int(neg[k, 50:].sum()), int(neg[k, :50].sum()), int(pos[k, :50].sum())) for k in range(n_splits)]
    each = [binary_metrics(*c) for c in cells]
    names = [f"fold_{k + 1}" for k in range(n_splits)]
    table = {m: [e[m] for e in each] for m in ("accuracy", "precision", "recall", "fscore")}
    table = {m: [*v, statistics.mean(v), statistics.stdev(v)] for m, v in table.items()}
    curves = [roc_from_counts(pos[k], neg[k]) for k in range(n_splits)]
    return {
        "dependent_var": y, "indep_vars": labels, "summary": {"row_names": [*names, "average", "stdev"], "n_obs": [*[models[k]["n_obs"] for k in range(n_splits)], None, None], **table},
        "confusion_matrix": dict(zip(("tp", "fp", "tn", "fn"), (sum(c) for c in zip(*cells, strict=True)), strict=True)),
        "roc_curves": [{"name": n, "tpr": a, "fpr": b, "auc": c} for n, (a, b, c) in zip(names, curves, strict=True)],
    }
