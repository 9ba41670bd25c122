"""From single observations to one row per subject and group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectgrid.functions.scalars import quoted
from effectgrid.operators.quantiles import exact_medians
from effectgrid.sources.tables import first_row_per


def pseudobulk(
    df: DataFrame, keys: list[str], score_cols: list[str], qc_cols: list[str],
    max_group_rows: int | None = None,
) -> DataFrame:
    """Exact median of every score and quality column per key."""
    return exact_medians(df, keys, score_cols + qc_cols, max_group_rows=max_group_rows)


def donor_rows(df: DataFrame, donor: str, phenotypes: list[str]) -> DataFrame:
    """Distinct (donor, phenotypes) rows: more than one per donor if they disagree."""
    return df.select(donor, *[quoted(c) for c in phenotypes]).distinct()


def donor_first_rows(df: DataFrame, donor: str, phenotypes: list[str], order: str) -> DataFrame:
    """One row per donor: the first in the stated order.

    Equal phenotype rows are merged first, so few rows are left to compare.
    """
    variants = df.groupBy(donor, *[quoted(c) for c in phenotypes]).agg(F.min(order).alias("__first"))
    return first_row_per(variants, [donor], "__first").drop("__first")
