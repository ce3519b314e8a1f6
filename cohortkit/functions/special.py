"""Distribution tails for the hypothesis tests.

SciPy is not a dependency, so the regularised incomplete beta and gamma
functions are evaluated here with the standard series / continued-fraction
expansions (modified Lentz). They run inside Arrow UDFs on tables of at most
one row per tested variable; the sufficient statistics come from Spark
aggregates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_EPS = 3e-16
_TINY = 1e-300
_MAX_ITER = 100000


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, _MAX_ITER):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def _log_gamma_ratio(a: float, b: float) -> float:
    """log(gamma(a + b) / gamma(a)); for a large a by Stirling's series, whose leading terms cancel here."""
    if a < 1e4:
        return math.lgamma(a + b) - math.lgamma(a)
    rest = lambda x: 1 / (12 * x) - 1 / (360 * x**3)
    return (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b + rest(a + b) - rest(a)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x is None or a is None or b is None or any(map(math.isnan, (a, b, x))):
        return math.nan
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = _log_gamma_ratio(max(a, b), min(a, b)) - math.lgamma(min(a, b))
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if a is None or x is None or math.isnan(a) or math.isnan(x):
        return math.nan
    if x <= 0.0:
        return 1.0
    lg = math.lgamma(a)
    if x < a + 1.0:
        ap, s, term = a, 1.0 / a, 1.0 / a
        for _ in range(_MAX_ITER):
            ap += 1.0
            term *= x / ap
            s += term
            if abs(term) < abs(s) * _EPS:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - lg))
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, _MAX_ITER):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = d if abs(d) > _TINY else _TINY
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - lg) * h


def t_two_sided(t: float, df: float) -> float:
    """Two-sided Student-t tail probability."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of the chi-square distribution; k = 0 gives 1 (no test)."""
    if x is None or k is None or math.isnan(x) or math.isnan(k):
        return math.nan
    if k <= 0:
        return 1.0
    return gammaincc(k / 2.0, x / 2.0)


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    if f is None or any(v is None or math.isnan(v) for v in (f, d1, d2)) or d1 <= 0 or d2 <= 0:
        return math.nan
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def _log_hyper(x: np.ndarray, r1: int, c1: int, n: int) -> np.ndarray:
    """log P(X = x) for the 2x2 table with row-1 total r1, column-1 total c1."""
    from math import lgamma
    lg = np.vectorize(lgamma, otypes=[float])
    const = lgamma(r1 + 1) + lgamma(n - r1 + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1) - lgamma(n + 1)
    return const - (lg(x + 1) + lg(r1 - x + 1) + lg(c1 - x + 1) + lg(n - r1 - c1 + x + 1))


def _tail_sum(start: int, stop: int, step: int, r1: int, c1: int, n: int, chunk: int = 4096) -> float:
    """Sum the pmf from ``start`` moving by ``step`` up to ``stop`` (inclusive),
    stopping once terms are negligible; terms decrease monotonically."""
    total = 0.0
    x = start
    while (step > 0 and x <= stop) or (step < 0 and x >= stop):
        end = min(stop, x + step * (chunk - 1)) if step > 0 else max(stop, x + step * (chunk - 1))
        xs = np.arange(x, end + step, step, dtype=float)
        terms = np.exp(_log_hyper(xs, r1, c1, n))
        total += float(terms.sum())
        if terms[-1] <= total * 1e-18:
            break
        x = end + step
    return total


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact p for [[a, b], [c, d]]: the total probability of
    tables at most as likely as the observed one (relative tolerance 1e-7)."""
    if any(v is None for v in (a, b, c, d)):
        return math.nan
    a, b, c, d = int(a), int(b), int(c), int(d)
    r1, c1, n = a + b, a + c, a + b + c + d
    if n == 0:
        return math.nan
    lo, hi = max(0, r1 + c1 - n), min(r1, c1)
    mode = int(math.floor((r1 + 1) * (c1 + 1) / (n + 2)))
    mode = min(max(mode, lo), hi)
    lp_obs = float(_log_hyper(np.array([a], float), r1, c1, n)[0])
    thr = lp_obs + math.log1p(1e-7)
    lp_mode = float(_log_hyper(np.array([mode], float), r1, c1, n)[0])
    if lp_mode <= thr:
        return 1.0
    if a <= mode:
        # this side: every x <= a has pmf <= pmf(a)
        p = _tail_sum(a, lo, -1, r1, c1, n)
        # other side: first x > mode with pmf <= threshold (pmf decreasing there)
        left, right = mode, hi + 1
        while right - left > 1:
            mid = (left + right) // 2
            if float(_log_hyper(np.array([mid], float), r1, c1, n)[0]) <= thr:
                right = mid
            else:
                left = mid
        if right <= hi:
            p += _tail_sum(right, hi, 1, r1, c1, n)
    else:
        p = _tail_sum(a, hi, 1, r1, c1, n)
        left, right = lo - 1, mode
        while right - left > 1:
            mid = (left + right) // 2
            if float(_log_hyper(np.array([mid], float), r1, c1, n)[0]) <= thr:
                left = mid
            else:
                right = mid
        if left >= lo:
            p += _tail_sum(left, lo, -1, r1, c1, n)
    return min(1.0, p)


# --- Arrow UDFs (run on at most one row per variable) ------------------------

def _vec(fn, *series: pd.Series) -> pd.Series:
    rows = zip(*[s.astype(float).where(s.notna(), np.nan).tolist() for s in series])
    out = [fn(*r) for r in rows]
    return pd.Series(out, dtype=float).replace({np.nan: None}).astype(float)


@F.pandas_udf(DoubleType())
def t_two_sided_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def chi2_sf_udf(x: pd.Series, k: pd.Series) -> pd.Series:
    return _vec(chi2_sf, x, k)


@F.pandas_udf(DoubleType())
def f_sf_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _vec(f_sf, f, d1, d2)


@F.pandas_udf(DoubleType())
def fisher_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    def one(a_, b_, c_, d_):
        if any(math.isnan(v) for v in (a_, b_, c_, d_)):
            return math.nan
        return fisher_two_sided(a_, b_, c_, d_)
    return _vec(one, a, b, c, d)


# --- DuckDB twins for oracle SQL (Simpson's rule, 20,000 intervals) ---------

SIMPSON_N = 20000


def t_two_sided_sql(rel: str, key: str, t: str, df: str) -> str:
    """SQL producing (key, p) from relation ``rel`` with columns t, df.

    p = 1 - 2 * integral_0^|t| of the t density, by Simpson's rule."""
    n = SIMPSON_N
    return f"""(SELECT r.{key} AS {key},
        CASE WHEN any_value(r.{t}) IS NULL OR any_value(r.{df}) IS NULL OR isnan(any_value(r.{t})) THEN NULL
             ELSE greatest(0.0, 1.0 - 2.0 * (abs(any_value(r.{t})) / {n} / 3.0) * sum(
               (CASE WHEN g.i = 0 OR g.i = {n} THEN 1.0 WHEN g.i % 2 = 1 THEN 4.0 ELSE 2.0 END)
               * exp(lgamma((r.{df} + 1.0) / 2.0) - lgamma(r.{df} / 2.0) - 0.5 * ln(r.{df} * pi())
                     - (r.{df} + 1.0) / 2.0 * ln(1.0 + power(g.i * abs(r.{t}) / {n}, 2) / r.{df})))) END AS p
      FROM {rel} r, generate_series(0, {n}) AS g(i)
      GROUP BY r.{key})"""


def chi2_sf_sql(rel: str, key: str, x: str, k: str) -> str:
    """SQL producing (key, p): 1 - CDF of chi-square(k) at x, Simpson's rule on
    the substitution y = u^2 (smooth integrand for every k >= 1); k = 0 -> 1."""
    n = SIMPSON_N
    return f"""(SELECT r.{key} AS {key},
        CASE WHEN any_value(r.{x}) IS NULL THEN NULL
             WHEN any_value(r.{k}) <= 0 THEN 1.0
             ELSE greatest(0.0, 1.0 - (sqrt(greatest(any_value(r.{x}), 0.0)) / {n} / 3.0) * sum(
               (CASE WHEN g.i = 0 OR g.i = {n} THEN 1.0 WHEN g.i % 2 = 1 THEN 4.0 ELSE 2.0 END)
               * CASE WHEN g.i = 0 AND r.{k} > 1 THEN 0.0 ELSE
                 2.0 * exp((r.{k} - 1.0) * ln(greatest(g.i * sqrt(greatest(r.{x}, 0.0)) / {n}, 1e-300))
                           - power(g.i * sqrt(greatest(r.{x}, 0.0)) / {n}, 2) / 2.0
                           - (r.{k} / 2.0) * ln(2.0) - lgamma(r.{k} / 2.0)) END)) END AS p
      FROM {rel} r, generate_series(0, {n}) AS g(i)
      GROUP BY r.{key})"""


def fisher_sql(rel: str, key: str, a: str, b: str, c: str, d: str) -> str:
    """SQL producing (key, p): sum of hypergeometric probabilities of all tables
    with the observed margins that are at most (1+1e-7) times as likely."""
    return f"""(WITH m AS (SELECT {key} AS k, {a}::BIGINT AS a, ({a}+{b})::BIGINT AS r1, ({a}+{c})::BIGINT AS c1,
                        ({a}+{b}+{c}+{d})::BIGINT AS n FROM {rel}),
           s AS (SELECT m.k, m.a, g.x,
                   lgamma(r1+1)+lgamma(n-r1+1)+lgamma(c1+1)+lgamma(n-c1+1)-lgamma(n+1)
                   -(lgamma(g.x+1)+lgamma(r1-g.x+1)+lgamma(c1-g.x+1)+lgamma(n-r1-c1+g.x+1)) AS lp
                 FROM m, generate_series(greatest(0, m.r1+m.c1-m.n), least(m.r1, m.c1)) AS g(x)),
           o AS (SELECT k, lp AS lp_obs FROM s WHERE x = a)
      SELECT s.k AS {key}, least(1.0, sum(CASE WHEN s.lp <= o.lp_obs + ln(1 + 1e-7) THEN exp(s.lp) ELSE 0 END)) AS p
      FROM s JOIN o ON s.k = o.k GROUP BY s.k)"""
