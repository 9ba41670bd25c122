"""Numeric Column expressions that keep nulls null under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def nan_columns_to_null(df: DataFrame) -> DataFrame:
    """All float columns of a freshly read table, NaN read as missing."""
    floats = {
        f.name: nan_to_null(quoted(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


def quoted(name: str) -> Column:
    """Column by exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_finite(col: Column) -> Column:
    return F.coalesce(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), F.lit(False))


def finite_or_null(col: Column) -> Column:
    return F.when(is_finite(col), col)


def winsorise(col: Column, cap: float) -> Column:
    """Clamp to [-cap, cap]; least/greatest skip nulls, hence the guard."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(-cap)), F.lit(cap)))


def neg_log10(p: Column, floor: float | None = None) -> Column:
    bounded = p if floor is None else F.when(p.isNotNull(), F.greatest(p, F.lit(floor)))
    # the added zero turns the -0.0 of p = 1 into 0.0
    return -F.log10(bounded) + F.lit(0.0)


def signed_log10(beta: Column, fdr: Column, floor: float = 1e-300) -> Column:
    return F.signum(beta) * neg_log10(fdr, floor) + F.lit(0.0)


def direction(effect: Column) -> Column:
    return F.when(effect > 0, "up").when(effect.isNotNull(), "down")


def log2_ratio(up: Column, down: Column, pseudo: float = 0.5) -> Column:
    return F.log2((up + F.lit(pseudo)) / (down + F.lit(pseudo)))


def log_odds_half(a: Column, b: Column, c: Column, d: Column) -> Column:
    half = F.lit(0.5)
    return F.log((a + half) * (d + half) / ((b + half) * (c + half)))


def remainder(total: Column, part: Column) -> Column:
    """total - part, never below zero, null when either is null."""
    gap = total - part
    return F.when(gap.isNotNull(), F.greatest(gap, F.lit(0).cast("bigint")))


def value_bucket(col: Column, per_octave: int = 1024) -> Column:
    """A long that never decreases with the value, by a fixed rule.

    Buckets are logarithmic: `per_octave` of them between x and 2x, mirrored
    for negative values, one for zero, the outermost ones for infinity. The rule needs no look at the data, so
    two passes (or a retried task) always agree on it.
    """
    offset = 1200 * per_octave
    infinite = F.abs(col) == F.lit(float("inf"))
    last = F.lit(2 * offset).cast("bigint")
    size = F.floor(F.log2(F.abs(col)) * F.lit(float(per_octave))) + F.lit(offset)
    return (
        F.when(infinite & (col > 0), last)
        .when(infinite, -last)
        .when(col > 0, size)
        .when(col < 0, -size)
        .when(col.isNotNull(), F.lit(0).cast("bigint"))
    )
