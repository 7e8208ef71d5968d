"""Student's t-tests; each is one aggregation.

Three conventions are part of the contract: the independent test pairs a Welch standard error
with pooled degrees of freedom, the one-sample test reports the sample mean as mean_diff and the
negated effect size, and one-sided tests replace one end of the two-sided interval by infinity.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadUserInput
from ..functions.special import t_cdf, t_ppf
from ..plans.rounds import Round


def _conclude(t: float, df: float, centre: float, se: float, alpha: float, alternative: str) -> dict[str, Any]:
    half = t_ppf(1 - alpha / 2, df) * se
    low, high = str(centre - half), str(centre + half)
    if alternative == "greater":
        p, high = 1 - t_cdf(t, df), "Infinity"
    elif alternative == "less":
        p, low = 1 - t_cdf(-t, df), "-Infinity"
    else:
        p = 2 * (1 - t_cdf(abs(t), df))
    return {"p": p, "ci_lower": low, "ci_upper": high}


def _ratio(a: float, b: float) -> float:
    return a / b if b else (math.nan if a == 0 else math.copysign(math.inf, a))


def ttest_onesample(df: DataFrame, y: str, mu: float = 0.0, alpha: float = 0.05, alt_hypothesis: str = "two-sided") -> dict[str, Any]:
    v = F.col(f"`{y}`").cast("double")
    s = Round().sum("n", F.lit(1)).sum("x", v).sum("d", v - mu, (v - mu) * (v - mu)).run(df)
    n, total, (d, dd) = s["n"][0], s["x"][0], s["d"]
    if n <= 1:
        raise BadUserInput("Not enough observations for one-sample t-test.")
    mean, sd = total / n, math.sqrt(max(dd - d * d / n, 0) / (n - 1))
    se = sd / math.sqrt(n)
    t = _ratio(mean - mu, se)
    return {"n_obs": int(n), "t_stat": t, "df": int(n - 1), "std": sd, "mean_diff": mean, "se_diff": se, "cohens_d": -_ratio(mean - mu, sd), **_conclude(t, n - 1, mean, se, alpha, alt_hypothesis)}


def ttest_paired(df: DataFrame, x: str, y: str, alpha: float = 0.05, alt_hypothesis: str = "two-sided") -> dict[str, Any]:
    a, b = (F.col(f"`{c}`").cast("double") for c in (x, y))
    s = Round().sum("n", F.lit(1)).sum("s", a, b, a - b).sum("q", a * a, b * b, (a - b) * (a - b)).run(df)
    n, (sa, sb, sd), (qa, qb, qd) = s["n"][0], s["s"], s["q"]
    if n <= 1:
        raise BadUserInput("Not enough observations for paired t-test.")
    var = lambda q, t: max(q - t * t / n, 0) / (n - 1)
    mean = sd / n
    se = math.sqrt(var(qd, sd) / n)
    t = _ratio((sa - sb) / n, se)
    return {"t_stat": t, "df": int(n - 1), "mean_diff": mean, "se_diff": se, "cohens_d": _ratio((sa - sb) / n, math.sqrt((var(qa, sa) + var(qb, sb)) / 2)), **_conclude(t, n - 1, mean, se, alpha, alt_hypothesis)}


def ttest_independent(df: DataFrame, y: str, x: str, groupA, groupB, alpha: float = 0.05, alt_hypothesis: str = "two-sided") -> dict[str, Any]:  # noqa: N803
    v, g = F.col(f"`{y}`").cast("double"), F.col(f"`{x}`")
    r = Round()
    for name, level in (("a", groupA), ("b", groupB)):
        mine = F.when(g == F.lit(level), v)
        r.sum(name, F.when(g == F.lit(level), 1.0), mine, mine * mine)
    s = r.run(df)
    (na, sa, qa), (nb, sb, qb) = s["a"], s["b"]
    if na < 1 or nb < 1:
        raise BadUserInput(f"Group {'A' if na < 1 else 'B'} has no data.")
    if na + nb <= 2:
        raise BadUserInput("Not enough observations for independent t-test.")
    va, vb = (max(q - t * t / n, 0) / (n - 1) if n > 1 else math.nan for n, t, q in ((na, sa, qa), (nb, sb, qb)))
    diff, se, dof = sa / na - sb / nb, math.sqrt(va / na + vb / nb), na + nb - 2
    t = _ratio(diff, se)
    pooled = math.sqrt(((na - 1) * va + (nb - 1) * vb) / dof)
    return {"t_stat": t, "df": int(dof), "mean_diff": diff, "se_diff": se, "cohens_d": _ratio(diff, pooled), **_conclude(t, dof, diff, se, alpha, alt_hypothesis)}
