"""Random-intercept models by maximum likelihood, from grouped sums.

With V = I + theta J per subject, the weighted cross products of a subject with
n rows are those within it, c - s s' / n, plus s s' / (n (1 + n theta)). So the
likelihood of a model needs the sum of the first over all subjects and, for each
distinct n, the sum of s s'. Nothing is subtracted at this point: the products
within come from centred moments. A model with N rows has at most sqrt(2 N)
distinct sizes: that short list is all that reaches the optimiser.

The models of an Arrow batch are searched together, as arrays: on a grid of ln
theta first, then by bisection on the sign of the likelihood's slope, which finds
the maximum to full precision where the likelihood itself is flat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIZE_SUMS = "__sizes"
#: ln theta is searched from -12 - ln(largest subject) up to here; a likelihood that still grows has no maximum.
_LARGEST = 60.0
#: Numbers that the models searched together hold.
_HELD = 1 << 22


def random_intercept(
    df: DataFrame, keys: list[str], ident: str, design: dict[str, Column], response: Column,
    term: str,
) -> DataFrame:
    """Estimate, standard error and their ratio of one fixed effect per key.

    `design` holds all fixed-effect columns, the intercept included; rows with
    a null in any of them or in the response are not used.
    """
    names = list(design)
    width = len(names) + 1
    cases = df.select(
        *keys,
        ident,
        *[col.cast("double").alias(f"__v{i}") for i, col in enumerate([*design.values(), response])],
    ).dropna(subset=[f"__v{i}" for i in range(width)])
    pairs = [(i, j) for i in range(width) for j in range(i, width)]

    per_subject = cases.groupBy(*keys, ident).agg(
        F.count("*").alias("__n"),
        *[F.sum(f"__v{i}").alias(f"__s{i}") for i in range(width)],
        *[
            (F.covar_pop(f"__v{i}", f"__v{j}") * F.count("*")).alias(f"__c{i}_{j}") for i, j in pairs
        ],
    )
    per_size = per_subject.groupBy(*keys, "__n").agg(
        F.count("*").alias("__m"),
        F.array(*[F.sum(F.col(f"__s{i}") * F.col(f"__s{j}")) for i, j in pairs]).alias("__ss"),
        F.array(*[F.sum(f"__c{i}_{j}") for i, j in pairs]).alias("__cc"),
    )
    # at most sqrt(2 N) entries per model
    per_model = per_size.groupBy(*keys).agg(
        F.collect_list(F.struct("__n", "__m", "__ss", "__cc")).alias(_SIZE_SUMS)
    )
    schema = T.StructType(
        [per_model.schema[k] for k in keys]
        + [T.StructField(c, T.DoubleType()) for c in ("estimate", "std_error", "statistic")]
    )
    position = names.index(term)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            out["estimate"], out["std_error"] = fit_models(list(batch[_SIZE_SUMS]), width, position)
            out["statistic"] = out["estimate"] / out["std_error"]
            yield out

    solved = per_model.mapInPandas(solve, schema)
    return solved.withColumns(
        {c: F.when(~F.isnan(c), F.col(c)) for c in ("estimate", "std_error", "statistic")}
    )


def fit_sizes(sizes, width: int, position: int) -> tuple[float, float]:
    """One model of `fit_models`."""
    estimate, error = fit_models([sizes], width, position)
    return float(estimate[0]), float(error[0])


def fit_models(models: list, width: int, position: int) -> tuple[np.ndarray, np.ndarray]:
    """For each model one coefficient and its error at the maximum of the likelihood; NaN without one."""
    estimate, error = np.full(len(models), np.nan), np.full(len(models), np.nan)
    order = sorted(range(len(models)), key=lambda i: len(models[i]))
    at = 0
    while at < len(order):  # models of like length together, so that little is padded
        longest, end = len(models[order[at]]), at + 1
        while end < len(order) and (end - at + 1) * len(models[order[end]]) * width**2 <= _HELD and len(models[order[end]]) <= 2 * longest + 8:
            end += 1
        own = order[at:end]
        estimate[own], error[own] = _Batch([models[i] for i in own], width).solved(position)
        at = end
    return estimate, error


class _Batch:
    """Models side by side: sizes n and their numbers m by model, padded with m = 0."""

    def __init__(self, models: list, width: int):
        longest = max(map(len, models))
        shape = (len(models), longest)
        self.width, self.n, self.m = width, np.ones(shape), np.zeros(shape)
        self.between, self.inside = np.zeros((*shape, width, width)), np.zeros((len(models), width, width))
        upper = np.triu_indices(width)
        for b, sizes in enumerate(models):
            k = len(sizes)
            self.n[b, :k] = [s["__n"] for s in sizes]
            self.m[b, :k] = [s["__m"] for s in sizes]
            flat = np.array([s["__ss"] for s in sizes], float), np.array([s["__cc"] for s in sizes], float).sum(axis=0)
            for full, values in ((self.between[b, :k], flat[0]), (self.inside[b], flat[1])):
                full[..., upper[0], upper[1]] = values
                full[..., upper[1], upper[0]] = values
        self.total = (self.n * self.m).sum(axis=1)
        self.largest = np.where(self.m > 0, self.n, 0).max(axis=1)

    def weighted(self, theta: np.ndarray) -> np.ndarray:
        weight = np.where(self.m > 0, 1 / (self.n * (1 + self.n * theta[:, None])), 0.0)
        return self.inside + np.einsum("bk,bkij->bij", weight, self.between)

    def eliminated(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper triangles left by elimination, and whether all pivots are positive."""
        a = self.weighted(theta)
        fine = np.ones(len(a), bool)
        for k in range(self.width):
            pivot = a[:, k, k]
            fine &= pivot > 0
            if k < self.width - 1:
                row = a[:, k, k + 1 :] / np.where(pivot > 0, pivot, 1.0)[:, None]
                a[:, k + 1 :, k + 1 :] -= row[:, :, None] * a[:, k, None, k + 1 :]
        return a, fine

    def coefficients(self, a: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Back substitution in the regressors' triangle."""
        p = self.width - 1
        out = np.zeros((len(a), p))
        for k in range(p - 1, -1, -1):
            out[:, k] = (right[:, k] - (a[:, k, k + 1 : p] * out[:, k + 1 :]).sum(axis=1)) / np.where(a[:, k, k] > 0, a[:, k, k], 1.0)
        return out

    def deviance(self, theta: np.ndarray) -> np.ndarray:
        a, fine = self.eliminated(theta)
        rest = np.where(fine, a[:, -1, -1], 1.0)
        value = (self.m * np.log1p(self.n * theta[:, None])).sum(axis=1) + self.total * np.log(rest / self.total)
        return np.where(fine, value, np.inf)

    def slope(self, theta: np.ndarray) -> np.ndarray:
        """Of the deviance by theta; the residual's own slope needs no slope of the coefficients."""
        a, fine = self.eliminated(theta)
        w = np.concatenate([-self.coefficients(a, a[:, :, -1]), np.ones((len(a), 1))], axis=1)
        spread = 1 + self.n * theta[:, None]
        moved = np.einsum("bi,bkij,bj->bk", w, self.between, w)
        fall = (np.where(self.m > 0, 1 / spread**2, 0.0) * moved).sum(axis=1)
        rest = np.where(fine, a[:, -1, -1], np.nan)
        return (self.m * self.n / spread).sum(axis=1) - self.total * fall / rest

    def solved(self, position: int) -> tuple[np.ndarray, np.ndarray]:
        fixed = self.weighted(np.zeros(len(self.total)))[:, :-1, :-1]
        scale = np.sqrt(np.diagonal(fixed, axis1=1, axis2=2))
        able = (self.total > self.width) & (scale > 0).all(axis=1)
        safe = np.where(able[:, None], scale, 1.0)
        with np.errstate(all="ignore"):
            condition = np.linalg.cond(np.where(able[:, None, None], fixed / (safe[:, :, None] * safe[:, None, :]), np.eye(self.width - 1)))
        able &= condition <= 1e13

        step = 0.25
        low = -12 - np.log(np.maximum(self.largest, 1))
        best, value, last, k = low.copy(), np.full(len(low), np.inf), low.copy(), 0
        while True:
            g = low + step * k
            # beyond e^12 only models whose likelihood still grows go on
            more = (g < 12 + step) | ((best == last) & (g <= _LARGEST + step) & able)
            if not more.any():
                break
            found = np.where(more, self.deviance(np.exp(np.minimum(g, _LARGEST + 1))), np.inf)
            better = found < value
            best, value = np.where(better, g, best), np.where(better, found, value)
            last = np.where(more, g, last)
            k += 1
        able &= np.isfinite(value) & (best < last)  # else it grows without bound
        left, right = np.maximum(best - step, low), best + step
        for _ in range(60):
            middle = (left + right) / 2
            falls = self.slope(np.exp(middle)) < 0
            left, right = np.where(falls, middle, left), np.where(falls, right, middle)
        theta = np.exp((left + right) / 2)
        zero = np.zeros(len(theta))
        theta = np.where(self.deviance(zero) <= self.deviance(theta), 0.0, theta)
        a, fine = self.eliminated(theta)
        able &= fine
        beta = self.coefficients(a, a[:, :, -1])[:, position]
        # the term's own entry of the inverse
        p = self.width - 1
        unit = np.zeros((len(a), p))
        unit[:, position] = 1.0
        forward = unit.copy()
        for k in range(p):
            forward[:, k + 1 :] -= forward[:, k, None] * a[:, k, k + 1 : p] / np.where(a[:, k, k] > 0, a[:, k, k], 1.0)[:, None]
        spread = self.coefficients(a, forward)[:, position]
        with np.errstate(invalid="ignore"):
            error = np.sqrt(spread * a[:, -1, -1] / np.maximum(self.total, 1))
        return np.where(able, beta, np.nan), np.where(able, error, np.nan)
