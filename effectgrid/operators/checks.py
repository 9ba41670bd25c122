"""Checks on tables: at planning time where names suffice, else as one-row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require_any(names: list[str], what: str = "phenotype column") -> None:
    if not names:
        raise ValueError(f"no {what} found")


def bad_names(df: DataFrame, name: str) -> DataFrame:
    """One row: names that are null, and names that read NA; both should be 0."""
    return df.agg(
        F.count_if(F.col(name).isNull()).alias("n_null"),
        F.count_if(F.col(name) == "NA").alias("n_na_text"),
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys, and keys that occur more than once."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("__n"))
        .agg(F.count("*").alias("n_keys"), F.count_if(F.col("__n") > 1).alias("n_repeated"))
    )
