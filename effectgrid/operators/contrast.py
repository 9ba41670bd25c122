"""Difference of two groups' means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectgrid.functions.scalars import finite_or_null


def group_contrast(
    df: DataFrame, keys: list[str], group: str, a: str, b: str, value: str, z: float = 1.96
) -> DataFrame:
    """Mean, sd and count per group, their difference, its error and half width.

    Sides become columns by conditional aggregates; a missing side is null.
    """
    aggs = []
    for level in (a, b):
        v = F.when(F.col(group) == level, F.col(value))
        aggs += [
            F.avg(v).alias(f"m_{level}"),
            F.stddev_samp(v).alias(f"sd_{level}"),
            F.count(finite_or_null(v)).alias(f"n_{level}"),
            F.count_if(F.col(group) == level).alias(f"__rows_{level}"),
        ]
    wide = df.groupBy(*keys).agg(*aggs)
    # a side that is absent has no count at all
    wide = wide.withColumns(
        {f"n_{s}": F.when(F.col(f"__rows_{s}") > 0, F.col(f"n_{s}")) for s in (a, b)}
    ).drop(f"__rows_{a}", f"__rows_{b}")

    def share(s: str):
        count = F.when(F.col(f"n_{s}").isNotNull(), F.greatest(F.col(f"n_{s}"), F.lit(1).cast("bigint")))
        return F.pow(F.col(f"sd_{s}"), 2) / count

    return (
        wide.withColumn("delta", F.col(f"m_{a}") - F.col(f"m_{b}"))
        .withColumn("se", F.sqrt(share(a) + share(b)))
        .withColumn("ci", F.col("se") * z)
    )
