"""Special functions as Column expressions (Catalyst only, no Python workers).

They run on aggregated rows: one row per model fit or contingency table.
Arguments are column names or SQL fragments; the formulas are SQL text, which
Spark parses in one step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_LN_PI = 0.5 * math.log(math.pi)
_HALF_LN_2PI = 0.5 * math.log(2 * math.pi)
# fixed values: coefficients of Stirling's series for ln Gamma
_STIRLING = ["1D/12", "-1D/360", "1D/1260", "-1D/1680", "1D/1188", "-691D/360360"]


def ln_gamma_sql(x: str) -> str:
    """ln Gamma(x) for x > 0: Stirling's series after a shift by eight."""
    y = f"(({x}) + 8D)"
    series = _STIRLING[-1]
    for coefficient in reversed(_STIRLING[:-1]):
        series = f"({coefficient} + ({series}) / ({y} * {y}))"
    product = " * ".join(f"(({x}) + {k}D)" for k in range(8))
    return (
        f"(({y} - 0.5D) * ln({y}) - {y} + {_HALF_LN_2PI!r}D + {series} / {y} - ln({product}))"
    )


def ln_gamma(x: str) -> Column:
    return F.expr(ln_gamma_sql(x))


def _beta_fraction_sql(a: str, b: str, x: str, steps: str) -> str:
    """Continued fraction of the incomplete beta function, folded from its tail."""
    even = f"(k * (({b}) - k) * ({x}) / ((({a}) + 2 * k - 1) * (({a}) + 2 * k)))"
    odd = f"((({a}) + k) * (({a}) + ({b}) + k) * ({x}) / ((({a}) + 2 * k) * (({a}) + 2 * k + 1)))"
    inner = (
        f"aggregate(transform(sequence(int({steps}), 1, -1), i -> double(i)), 1D, "
        f"(acc, k) -> 1D + {even} / (1D - {odd} / acc))"
    )
    return f"(1D / (1D - (({a}) + ({b})) * ({x}) / (({a}) + 1D) / {inner}))"


def t_two_sided(t: str, df: str) -> Column:
    """Two-sided Student-t tail probability, accurate far into the tail.

    p = I_x(df/2, 1/2) with x = df / (df + t^2). The fraction converges for
    x below (a+1)/(a+b+2); nearer to 1 the complement is evaluated instead.
    """
    nu, t2 = f"double({df})", f"(({t}) * ({t}))"
    a = f"({nu} / 2D)"
    x, y = f"({nu} / ({nu} + {t2}))", f"({t2} / ({nu} + {t2}))"
    ln_beta = f"({ln_gamma_sql(a)} + {_HALF_LN_PI!r}D - {ln_gamma_sql(a + ' + 0.5D')})"
    front = f"exp(-{a} * log1p({t2} / {nu}) + 0.5D * ln({y}) - {ln_beta})"
    steps = f"(60 + ceil(2 * sqrt({nu})))"
    near = f"({front} * {_beta_fraction_sql(a, '0.5D', x, steps)} / {a})"
    far = f"(1D - {front} * {_beta_fraction_sql('0.5D', a, y, steps)} / 0.5D)"
    return F.expr(
        f"CASE WHEN {nu} > 0 AND ({t}) IS NOT NULL THEN "
        f"CASE WHEN {t2} = 0 THEN 1D "
        f"WHEN {x} < ({a} + 1D) / ({a} + 2.5D) THEN least({near}, 1D) "
        f"ELSE greatest(least({far}, 1D), 0D) END END"
    )


def normal_two_sided(z: str) -> Column:
    """2 * (1 - Phi(|z|)) through the incomplete gamma function at 1/2."""
    x = f"(({z}) * ({z}) / 2D)"
    front = f"(exp(0.5D * ln({x}) - {x}) / {math.sqrt(math.pi)!r}D)"
    # small x: power series of the lower function, summed from its tail
    series = f"aggregate(sequence(60, 1, -1), 1D, (acc, k) -> 1D + {x} / (0.5D + k) * acc)"
    # large x: continued fraction of the upper function, folded from its tail
    fraction = (
        f"aggregate(sequence(200, 1, -1), {x} + 400.5D, "
        f"(acc, k) -> {x} + 2 * k - 1.5D - k * (k - 0.5D) / acc)"
    )
    return F.expr(
        f"CASE WHEN ({z}) IS NOT NULL THEN CASE WHEN {x} = 0 THEN 1D "
        f"WHEN {x} < 2 THEN 1D - {front} * {series} / 0.5D "
        f"ELSE {front} / {fraction} END END"
    )
