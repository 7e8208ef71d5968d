"""Analysis of variance, from one grouped aggregation."""

from __future__ import annotations

import math
from itertools import combinations
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadUserInput
from ..functions.special import f_cdf, studentized_range_sf


def groups_of(df: DataFrame, y: str, *x: str) -> DataFrame:
    """Per cell: n, sum, sum of squares, min and max of y."""
    v = F.col(f"`{y}`").cast("double")
    return df.groupBy(*[F.col(f"`{c}`") for c in x]).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def anova_oneway(df: DataFrame, y: str, x: str, categories: list | None = None) -> dict[str, Any]:
    """Table, Tukey's pairwise comparisons, group ranges and intervals.

    ``categories`` are the declared levels in their order; levels without rows are left out. The
    sample deviations are sqrt((n - 1) / n * (mean of squares - squared mean)), as the contract has it.
    """
    found = {r[0]: r for r in groups_of(df, y, x).collect() if r[0] is not None and r.n}
    levels = [c for c in (categories or sorted(found)) if c in found]
    if len(levels) < 2:
        # fixed text: clients match this message
        raise BadUserInput("Cannot perform Anova one-way. Covariable has only one level.")
    n, s, q = (np.array([float(found[c][k]) for c in levels]) for k in ("n", "s", "q"))
    total, means = n.sum(), s / n
    df_e, df_r = len(levels) - 1, int(total) - len(levels)
    ss_r = q.sum() - (s**2 / n).sum()
    ss_e = ((s.sum() / total - means) ** 2 * n).sum()
    ms_e, ms_r = ss_e / df_e, ss_r / df_r if df_r else math.nan
    f = ms_e / ms_r if ms_r else 0.0
    pairs = []
    for i, j in combinations(range(len(levels)), 2):
        se = math.sqrt(ms_r / n[i] + ms_r / n[j])
        t = (means[i] - means[j]) / se if se else math.nan
        pairs.append({"groupA": levels[i], "groupB": levels[j], "meanA": means[i], "meanB": means[j], "diff": means[i] - means[j], "se": se, "t_stat": t, "p_tuckey": studentized_range_sf(math.sqrt(2) * abs(t), len(levels), df_r)})
    sd = np.sqrt(np.maximum((n - 1) / n * (q / n - means**2), 0))
    by = lambda v: dict(zip(levels, v.tolist(), strict=True))
    return {
        "anova_table": {"n_obs": int(total), "y_label": y, "x_label": x, "df_residual": df_r, "df_explained": df_e, "ss_residual": ss_r, "ss_explained": ss_e, "ms_residual": ms_r, "ms_explained": ms_e, "p_value": 1 - f_cdf(f, df_e, df_r), "f_stat": f},
        "tuckey_test": pairs,
        "min_max_per_group": {"categories": levels, "min": [found[c].lo for c in levels], "max": [found[c].hi for c in levels]},
        "ci_info": {"sample_stds": by(sd), "means": by(means), "m-s": by(means - sd), "m+s": by(means + sd)},
    }


def _treatment(levels: list, value) -> list[float]:
    return [float(value == v) for v in levels[1:]]


def anova_twoway(df: DataFrame, y: str, x1: str, x2: str, sstype: int = 2, levels1: list | None = None, levels2: list | None = None) -> dict[str, Any]:
    """Type I or II sums of squares with interaction.

    The cells' counts, sums and sums of squares determine all five least-squares fits (constant, each
    factor, both, both with interaction), so the data are read once. Degrees of freedom come from the
    ranks of the fits, so levels without rows don't count.
    """
    if sstype not in (1, 2):
        raise BadUserInput("sstype must be 1 or 2.")
    cells = [r for r in groups_of(df, y, x1, x2).collect() if r[0] is not None and r[1] is not None and r.n]
    a = list(levels1 or sorted({r[0] for r in cells}))
    b = list(levels2 or sorted({r[1] for r in cells}))
    if len(a) < 2 or len(b) < 2:
        # fixed text: clients match this message
        raise BadUserInput("Cannot perform Anova when there is only one level.")
    n = np.array([float(r.n) for r in cells])
    mean, total_q = np.array([r.s / r.n for r in cells]), sum(r.q for r in cells)
    within = max(total_q - (n * mean**2).sum(), 0.0)
    one = [[1.0] for _ in cells]
    fa, fb = [_treatment(a, r[0]) for r in cells], [_treatment(b, r[1]) for r in cells]
    both = [[i * j for i in p for j in q] for p, q in zip(fa, fb, strict=True)]

    def fit(*parts: list) -> tuple[float, int]:
        m = np.array([[v for part in row for v in part] for row in zip(*parts, strict=True)])
        w = np.sqrt(n)
        beta, _, rank, _ = np.linalg.lstsq(m * w[:, None], mean * w, rcond=None)
        return within + float((n * (mean - m @ beta) ** 2).sum()), int(rank)

    r0, ra, rb, rab, full = fit(one), fit(one, fa), fit(one, fb), fit(one, fa, fb), fit(one, fa, fb, both)
    steps = ((r0, ra) if sstype == 1 else (rb, rab), (ra, rab), (rab, full))
    df_res = int(n.sum()) - full[1]
    ss = [max(p[0] - q[0], 0.0) for p, q in steps] + [max(full[0], 0.0)]
    dof = [q[1] - p[1] for p, q in steps] + [df_res]
    ms_res = ss[3] / df_res if df_res else math.nan
    f = [s / d / ms_res if d and ms_res else None for s, d in zip(ss[:3], dof[:3], strict=True)] + [None]
    p = [None if v is None else 1 - f_cdf(v, d, df_res) for v, d in zip(f, dof, strict=True)]
    return {"terms": [x1, x2, f"{x1}:{x2}", "Residuals"], "sum_sq": ss, "df": dof, "f_stat": f, "f_pvalue": p}
