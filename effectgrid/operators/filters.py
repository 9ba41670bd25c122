"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectgrid.functions.scalars import quoted


def is_significant(alpha: float = 0.05, lfc_min: float = 0.2, p: str = "adj_p", eff: str = "logFC") -> Column:
    """Adjusted p strictly below alpha, absolute effect at least lfc_min.

    Plain comparisons on the stored columns, so the Parquet scan gets them.
    NaN sorts above every number: it fails the first test but not the second.
    """
    return (
        (quoted(p) < alpha)
        & ((quoted(eff) >= lfc_min) | (quoted(eff) <= -lfc_min))
        & ~F.isnan(quoted(eff))
    )


def significant(
    df: DataFrame, alpha: float = 0.05, lfc_min: float = 0.2, p: str = "adj_p", eff: str = "logFC"
) -> DataFrame:
    return df.filter(is_significant(alpha, lfc_min, p, eff))


def is_of_pathologies(names: list[str], column: str = "pathology") -> Column:
    """Whether the pathology is listed, with or without the suffix, on the stored column."""
    return quoted(column).isin([*names, *[f"{n}.scaled" for n in names]])


def of_pathologies(df: DataFrame, names: list[str], column: str = "pathology") -> DataFrame:
    return df.filter(is_of_pathologies(names, column))


def in_set(df: DataFrame, members: DataFrame, column: str, member: str = "symbol") -> DataFrame:
    """Rows whose `column` is in a one-column table.

    No broadcast hint: the set may grow with the data, so the size seen at run
    time decides between a broadcast and a shuffled (skew-split) semi join.
    """
    wanted = members.select(quoted(member).alias(column)).filter(quoted(column).isNotNull())
    return df.join(wanted, column, "left_semi")


def matches(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    return col.rlike(("(?i)" if ignore_case else "") + pattern)


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    """Column names in which the pattern is found, in table order."""
    import re

    found = re.compile(pattern)
    return [c for c in df.columns if found.search(c)]


def split_columns(df: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """(present, missing) among the wanted names."""
    have = set(df.columns)
    return [c for c in wanted if c in have], [c for c in wanted if c not in have]
