"""Top-N per group.

`row_number() <= literal` lets Spark cut each group to N rows before the
shuffle, so a group that holds most of the rows costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effectgrid.sources.tables import literal_table


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def top_n_by_limits(
    df: DataFrame, key: str, order: list[Column], limits: dict[str, int], out: str = "topN"
) -> DataFrame:
    """Top-N with N looked up per group; groups without a limit give no rows.

    The largest limit is known while planning and cuts the groups first.
    """
    table = literal_table(df.sparkSession, limits, key, out)
    largest = top_n_per_group(df, [key], order, max(limits.values()))
    w = Window.partitionBy(key).orderBy(*order)
    return (
        largest.join(table, key, "left")
        .withColumn("__rn", F.row_number().over(w))
        .filter(F.col("__rn") <= F.col(out))
        .drop("__rn")
    )


def top_n_or_fallback(
    df: DataFrame, keys: list[str], metric: str, order: list[Column], n: int = 25,
    threshold: float = 1.2,
) -> DataFrame:
    """Top-N rows that reach the threshold; all top-N rows if none reaches it.

    The unpartitioned window sees the top-N report only: n rows per group.
    """
    top = top_n_per_group(df, keys, order, n)
    passed = F.coalesce(F.col(metric) >= threshold, F.lit(False))
    return (
        top.withColumn("__passed", F.sum(passed.cast("bigint")).over(Window.partitionBy()))
        .filter(passed | (F.col("__passed") == 0))
        .drop("__passed")
    )


def item_strength(df: DataFrame, keys: list[str], score: str = "stat", out: str = "max_abs") -> DataFrame:
    """Largest absolute finite score per key."""
    return df.groupBy(*keys).agg(F.max(F.abs(score)).alias(out))
