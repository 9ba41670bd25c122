"""Fisher's exact test on 2x2 tables held as four count columns."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectgrid.functions.scalars import log_odds_half, neg_log10, quoted, remainder
from effectgrid.operators.grid import complete_grid

#: Ratios of neighbouring weights that are multiplied at a time.
_RUN = 256
#: Fixed value: relative tolerance within which a table counts as equally likely.
_EQUAL = 1e-7
#: A tail ends where a term is below this part of its sum.
_LEAST_TERM = 1e-17


def fisher_2x2(df: DataFrame, a: str, b: str, c: str, d: str, out: str = "p") -> DataFrame:
    """Adds the two-sided p-value of the table ((a, b), (c, d)).

    One row of `df` is one table and stays one row. The end of either tail is found
    by bisection and the tail summed outward from it by the ratios of neighbouring
    weights, so the work grows with the root of the margins. Null where a count is.
    """
    whole = [quoted(name).cast("bigint") for name in (a, b, c, d)]
    known = functools.reduce(Column.__and__, [count.isNotNull() for count in whole])
    return df.withColumn(out, F.when(known, _p_values()(*whole)))


def _p_values():
    @F.pandas_udf("double")
    def p_values(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(two_sided(*(s.fillna(0).to_numpy(float) for s in (a, b, c, d))))

    return p_values


def _stirling_rest(n: np.ndarray) -> np.ndarray:
    """ln n! - (n + 1/2) ln n + n - ln(2 pi) / 2."""
    exact = np.array([0.0] + [math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, 16)])
    m = np.maximum(n, 16.0)
    square = m * m
    far = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * square)) / square) / square) / square) / m
    return np.where(n < 16, exact[np.minimum(n, 15).astype(int)], far)


def _deviance_part(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x ln(x / mean) + mean - x, without cancellation where both are near."""
    safe_x, safe_mean = np.where(x > 0, x, 1.0), np.where(mean > 0, mean, 1.0)
    v = (safe_x - safe_mean) / (safe_x + safe_mean)
    near = (safe_x - safe_mean) * v
    term = 2 * safe_x * v
    for j in range(1, 12):
        term = term * v * v
        near = near + term / (2 * j + 1)
    far = safe_x * np.log(safe_x / safe_mean) + safe_mean - safe_x
    return np.where(x > 0, np.where(np.abs(v) < 0.1, near, far), mean)


def _ln_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """ln of the binomial weight, by the deviance form, whose error does not grow with n."""
    inner = (
        _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance_part(x, n * p) - _deviance_part(n - x, n * q)
        + 0.5 * np.log(np.where(n > 0, n, 1.0) / (2 * math.pi * np.where(x > 0, x, 1.0) * np.where(n - x > 0, n - x, 1.0)))
    )
    with np.errstate(divide="ignore", invalid="ignore"):
        none, every = n * np.log1p(-p), n * np.log(p)
    return np.where(n == 0, 0.0, np.where(x == 0, none, np.where(x == n, every, inner)))


def two_sided(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Sums of the probabilities of all tables with the same margins that are no likelier."""
    row1, row2, col1 = a + b, c + d, a + c
    out = np.ones(len(a))
    low, high = np.maximum(col1 - row2, 0), np.minimum(col1, row1)
    some = np.flatnonzero(high > low)
    if not len(some):
        return out
    a, row1, row2, col1, low, high = (v[some] for v in (a, row1, row2, col1, low, high))
    share, other = col1 / (row1 + row2), (row1 + row2 - col1) / (row1 + row2)

    def ln_weight(k):
        return _ln_binomial(k, row1, share, other) + _ln_binomial(col1 - k, row2, share, other) - _ln_binomial(col1, row1 + row2, share, other)

    mode = np.clip(np.floor((col1 + 1) * (row1 + 1) / (row1 + row2 + 2)), low, high)
    limit = ln_weight(a) + math.log1p(_EQUAL)

    def end(way):
        """The place nearest to the mode on that side that is no likelier; outside the support if none."""
        inside, beyond = mode.copy(), high + 1 if way > 0 else low - 1
        while True:
            open_ = np.abs(beyond - inside) > 1
            if not open_.any():
                return beyond
            middle = np.where(open_, np.floor((inside + beyond) / 2), inside)
            under = ln_weight(middle) <= limit
            inside, beyond = np.where(open_ & ~under, middle, inside), np.where(open_ & under, middle, beyond)

    def tail(first, way):
        """Sum from `first` outward, in units of its weight."""
        total, term, k = np.ones(len(first)), np.ones(len(first)), first.copy()
        going = np.arange(len(first))
        while len(going):
            steps = k[going, None] + way * np.arange(_RUN)
            r1, r2, c1 = row1[going, None], row2[going, None], col1[going, None]
            up, down = (r1 - steps) * (c1 - steps), steps * (r2 - c1 + steps)
            if way > 0:
                ratio = np.maximum(up, 0) / ((steps + 1) * (r2 - c1 + steps + 1))
            else:
                ratio = np.maximum(down, 0) / ((r1 - steps + 1) * (c1 - steps + 1))
            stop = steps >= high[going, None] if way > 0 else steps <= low[going, None]
            terms = term[going, None] * np.cumprod(np.where(stop, 0.0, ratio), axis=1)
            total[going] += terms.sum(axis=1)
            term[going], k[going] = terms[:, -1], k[going] + way * _RUN
            going = going[terms[:, -1] > _LEAST_TERM * total[going]]
        return total

    p = np.zeros(len(a))
    for way in (-1, 1):
        first = end(way)
        there = (first >= low) & (first <= high)
        at = np.clip(first, low, high)
        with np.errstate(under="ignore"):
            p += np.where(there, np.exp(ln_weight(at)) * tail(at, way), 0.0)
    out[some] = np.where(ln_weight(mode) <= limit, 1.0, np.minimum(p, 1.0))
    return out


def enrichment(
    totals: DataFrame, hits: DataFrame, by: str = "cell_major", group: str = "sex",
    first: str = "female", second: str = "male",
) -> DataFrame:
    """Hits against totals in two groups, per `by`: tallies, log odds ratio, p.

    `totals` has n_total and `hits` has n_sig per (by, group). Hits without
    totals are dropped, totals without hits count as zero hits.
    """
    return enrichment_of(totals.join(hits, [by, group], "left"), by, group, first, second)


def enrichment_of(
    counted: DataFrame, by: str = "cell_major", group: str = "sex",
    first: str = "female", second: str = "male",
) -> DataFrame:
    """As `enrichment`, from one table with n_total and n_sig per (by, group)."""
    tab = complete_grid(counted, {by: None, group: None}, {"n_total": 0, "n_sig": 0})

    def side(measure: str, value: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(group) == value, F.col(measure))), F.lit(0).cast("bigint"))

    wide = tab.groupBy(by).agg(
        side("n_total", first).alias(f"n_total_{first}"),
        side("n_total", second).alias(f"n_total_{second}"),
        side("n_sig", first).alias("a"),
        side("n_sig", second).alias("c"),
    )
    wide = wide.withColumns(
        {
            "b": remainder(F.col(f"n_total_{first}"), F.col("a")),
            "d": remainder(F.col(f"n_total_{second}"), F.col("c")),
        }
    )
    return fisher_2x2(wide, "a", "b", "c", "d", out="pval").withColumns(
        {
            "logOR": log_odds_half(F.col("a"), F.col("b"), F.col("c"), F.col("d")),
            "nlog10p": neg_log10(F.col("pval")),
        }
    )
