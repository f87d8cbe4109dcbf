"""Distribution tails for the statistical tests.

The test statistics are Column arithmetic over counts Spark has already
aggregated, and the tail probabilities are SQL expressions too (finite series
as ``aggregate`` over ``sequence``), so no Python runs on executors. Each is one
text that Spark parses, not a tree built call by call. Small tails keep their
relative precision: nothing is taken from one, and terms that underflow are
carried as logarithms. ``normal_quantile`` turns parameters (alpha, power) into
literals on the driver.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _let(var: str, body: str, **values: str) -> str:
    """``body`` with ``<var>.<name>`` standing for each value, worked out once."""
    fields = ", ".join(f"'{name}', {value}" for name, value in values.items())
    return f"transform(array(named_struct({fields})), {var} -> {body})[0]"


def _double(x: float) -> str:
    return f"{x!r}D"


def _series(last: str, first: str, ratio: str) -> str:
    """sum_{n=0}^{last} t_n, t_0 = first, t_n = t_{n-1} * ratio (of ``n``); 0
    where last < 0. The sum trails by a term, so a step has one ratio."""
    return (f"IF({last} >= 0, aggregate(filter(sequence(0, greatest({last}, 0)), n -> n >= 1), "
            f"named_struct('t', {first}, 'sum', 0D), "
            f"(a, n) -> named_struct('t', a.t * ({ratio}), 'sum', a.sum + a.t), a -> a.sum + a.t), 0D)")


def _sum_of_exp(last: str, first_log: str, log_ratio: str) -> str:
    """sum_{n=0}^{last} exp(l_n), l_0 = first_log, l_n = l_{n-1} + log_ratio (of
    ``n``); 0 where last < 0. Logarithms, so that a term too small for a double
    does not take the later ones with it."""
    return (f"IF({last} >= 0, aggregate(filter(sequence(0, greatest({last}, 0)), n -> n >= 1), "
            f"named_struct('l', {first_log}, 'sum', exp({first_log})), "
            f"(a, n) -> transform(array(a.l + {log_ratio}), l -> named_struct('l', l, 'sum', a.sum + exp(l)))[0], "
            f"a -> a.sum), 0D)")


#: Steps after which the two forms of erfc have converged to a double's
#: precision on their side of y = 2.
_SERIES_STEPS, _FRACTION_STEPS = 60, 100


def erfc_sql(y: str) -> str:
    """SQL for erfc(y), y >= 0: the power series of erf up to 2, where the result
    is not small, and beyond it the continued fraction
    exp(-y^2) / sqrt(pi) / (y + (1/2) / (y + (2/2) / (y + ...)))."""
    low = (f"1D - {_double(2 / math.sqrt(math.pi))} * exp(-e.y * e.y) * "
           + _series(str(_SERIES_STEPS), "e.y", "2D * e.y * e.y / (2 * n + 1)"))
    high = (f"exp(-e.y * e.y) / {_double(math.sqrt(math.pi))} / "
            f"aggregate(sequence({_FRACTION_STEPS}, 1, -1), e.y, (f, n) -> e.y + n / 2D / f)")
    return _let("e", f"CASE WHEN e.y IS NULL THEN NULL WHEN e.y <= 0 THEN 1D WHEN e.y <= 2 THEN {low} ELSE {high} END",
                y=f"CAST({y} AS DOUBLE)")


def chi2_sf_sql(x: str, k: str) -> str:
    """SQL for P(X > x), X ~ chi-square with integer k >= 1 degrees of freedom.

    Even k: e^-h sum_{i<k/2} h^i / i!, h = x/2; odd k: erfc(sqrt h) +
    e^-h sum_{i=1}^{(k-1)/2} h^{i-1/2} / Gamma(i+1/2)."""
    terms = _sum_of_exp("(CAST(floor(s.k / 2) AS INT) - 1)", f"(-s.h + s.half * (ln(s.h) - {_double(2 * math.lgamma(1.5))}))",
                        "(ln(s.h) - ln(n + s.half))")
    value = f"{terms} + IF(s.half > 0, {erfc_sql('sqrt(s.h)')}, 0D)"
    return _let("s", f"CASE WHEN s.h IS NULL OR s.k IS NULL OR s.k < 1 THEN NULL WHEN s.h <= 0 THEN 1D ELSE least(1D, {value}) END",
                h=f"CAST({x} AS DOUBLE) / 2", k=f"CAST({k} AS INT)", half=f"IF(CAST({k} AS INT) % 2 = 1, 0.5D, 0D)")


def normal_two_sided_sql(z: str) -> str:
    return erfc_sql(f"abs(CAST({z} AS DOUBLE)) / {_double(math.sqrt(2.0))}")


def t_two_sided_sql(t: str, nu: str) -> str:
    """SQL for the two-sided p of Student's t with integer nu degrees of freedom.

    Up to |t| = 2 one minus the finite series of Abramowitz & Stegun 26.7.3-4;
    beyond it, where that difference would cancel, the incomplete beta function
    I_x(nu/2, 1/2), x = nu / (nu + t^2), by its hypergeometric series."""
    inner = _series("CAST(floor((s.n - 2 - s.odd) / 2) AS INT)", "IF(s.odd = 1, sqrt(s.x), 1D)",
                    "s.x * (2 * n - 1 + s.odd) / (2 * n + s.odd)")
    near = f"1D - IF(s.odd = 1, {_double(2 / math.pi)} * (asin(sqrt(s.y)) + sqrt(s.y) * {inner}), sqrt(s.y) * {inner})"
    # Gamma(a + 1/2) / Gamma(a), a = n/2, by steps of one from a = 1/2 or 1.
    gammas = (f"aggregate(filter(sequence(0, CAST(floor((s.n - 1) / 2) AS INT)), j -> j >= 1), "
              f"IF(s.odd = 1, {_double(1 / math.sqrt(math.pi))}, {_double(math.sqrt(math.pi) / 2)}), "
              f"(g, j) -> g * (2 * j + 1 - s.odd) / (2 * j - s.odd))")
    series = _series("(CAST(ceil(40D / -ln(s.x)) AS INT) + 10)", "1D", "s.x * (s.n / 2D + n - 0.5D) / (s.n / 2D + n)")
    far = f"exp(s.n / 2D * ln(s.x)) * sqrt(s.y) / (s.n / 2D * {_double(math.sqrt(math.pi))}) * {gammas} * {series}"
    square, n = f"pow(abs(CAST({t} AS DOUBLE)), 2D)", f"CAST({nu} AS INT)"
    body = (f"CASE WHEN s.t IS NULL OR s.n IS NULL OR s.n < 1 THEN NULL "
            f"WHEN s.t <= 2 THEN greatest(0D, {near}) ELSE {far} END")
    return _let("s", body, t=f"abs(CAST({t} AS DOUBLE))", n=n, odd=f"{n} % 2",
                x=f"try_divide(CAST({n} AS DOUBLE), {n} + {square})", y=f"try_divide({square}, {n} + {square})")


def with_erfc(df: DataFrame, y: str, out: str) -> DataFrame:
    """``df`` plus erfc(y) for y >= 0."""
    return df.withColumn(out, F.expr(erfc_sql(f"`{y}`")))


def with_chi2_sf(df: DataFrame, x: str, k: str, out: str) -> DataFrame:
    """``df`` plus P(X > x), X ~ chi-square with integer k >= 1 degrees of freedom."""
    return df.withColumn(out, F.expr(chi2_sf_sql(f"`{x}`", f"`{k}`")))


def with_normal_two_sided(df: DataFrame, z: str, out: str) -> DataFrame:
    return df.withColumn(out, F.expr(normal_two_sided_sql(f"`{z}`")))


def with_t_two_sided(df: DataFrame, t: str, nu: str, out: str) -> DataFrame:
    """``df`` plus the two-sided p of Student's t with integer nu degrees of freedom."""
    return df.withColumn(out, F.expr(t_two_sided_sql(f"`{t}`", f"`{nu}`")))
