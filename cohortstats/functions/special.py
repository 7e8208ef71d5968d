"""Distribution functions in plain Python: normal, Student's t, F, and the studentised range.

The incomplete beta function is evaluated by Lentz's continued fraction and the studentised
range by Gauss-Legendre quadrature (both in any numerical-methods textbook).
"""

from __future__ import annotations

import math

import numpy as np


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    if not 0 < p < 1:
        return -math.inf if p == 0 else math.inf if p == 1 else math.nan
    return _invert(lambda x: norm_cdf(x), p, -40.0, 40.0) if p <= 0.5 else -norm_ppf(1 - p)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if math.isnan(x):
        return math.nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - _log_beta(a, b))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _beta_fraction(b, a, 1 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _log_beta(a: float, b: float) -> float:
    low, high = min(a, b), max(a, b)
    if high < 1e4:
        return math.lgamma(low) + math.lgamma(high) - math.lgamma(low + high)
    # log gamma(high + low) - log gamma(high) by Stirling's series: the difference of two huge values would lose all digits
    step = low * math.log(high) + (high + low - 0.5) * math.log1p(low / high) - low + 1 / (12 * (high + low)) - 1 / (12 * high)
    return math.lgamma(low) - step


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            step = c * d
            out *= step
        if abs(step - 1) < 1e-16:
            break
    return out


def t_sf(t: float, df: float) -> float:
    if math.isnan(t):
        return math.nan
    if math.isinf(t):
        return float(t < 0)
    half = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def t_cdf(t: float, df: float) -> float:
    return t_sf(-t, df)


def t_ppf(p: float, df: float) -> float:
    if not 0 < p < 1:
        return -math.inf if p == 0 else math.inf if p == 1 else math.nan
    if p < 0.5:
        return -t_ppf(1 - p, df)
    high = 1.0
    while t_sf(high, df) > 1 - p and high < 1e300:
        high *= 2
    return _invert(lambda x: -t_sf(x, df), -(1 - p), 0.0, high)


def f_sf(f: float, dfn: float, dfd: float) -> float:
    if math.isnan(f):
        return math.nan
    return 1.0 if f <= 0 else 0.0 if math.isinf(f) else betainc(dfd / 2, dfn / 2, dfd / (dfd + dfn * f))


def f_cdf(f: float, dfn: float, dfd: float) -> float:
    return 0.0 if f <= 0 else betainc(dfn / 2, dfd / 2, dfn * f / (dfd + dfn * f))


def _invert(f, target: float, low: float, high: float) -> float:
    """Bisection for a rising function, down to neighbouring floats."""
    for _ in range(2000):
        mid = 0.5 * (low + high)
        if mid in (low, high):
            break
        low, high = (mid, high) if f(mid) < target else (low, mid)
    return 0.5 * (low + high)


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """P(range of k means / pooled deviation > q), by quadrature over the deviation and the lowest mean."""
    if not q > 0:
        return 1.0 if q <= 0 else math.nan
    z, wz = np.polynomial.legendre.leggauss(96)
    z, wz = 8.5 * z, 8.5 * wz
    erf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
    density = np.exp(-(z**2) / 2) / math.sqrt(2 * math.pi)
    low = erf(z)

    def inside(w: np.ndarray) -> np.ndarray:
        """P(range < w) for unit deviation."""
        return k * (wz * density * (erf(z[None, :] + w[:, None]) - low[None, :]).clip(0) ** (k - 1)).sum(1)

    if df > 1e5:
        return float(min(1, max(0, 1 - inside(np.array([q]))[0])))
    # the deviation s has density of sqrt(chi2(df) / df)
    spread = 10 / math.sqrt(2 * df)
    a, b = max(1e-9, 1 - spread), 1 + spread if df > 8 else 1 + 2 * spread
    s, ws = np.polynomial.legendre.leggauss(96)
    s, ws = 0.5 * (b - a) * s + 0.5 * (b + a), 0.5 * (b - a) * ws
    log = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s**2 / 2
    return float(min(1, max(0, 1 - (ws * np.exp(log) * inside(q * s)).sum())))
