"""Benjamini-Hochberg adjustment, over all rows or per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effectgrid.functions.scalars import quoted
from effectgrid.operators.joins import null_safe_join
from effectgrid.operators.ranges import in_ranges

# a single window per group is used only where the caller states a smaller bound
WINDOW_ROWS = 1_000_000


def bh_adjust(
    df: DataFrame,
    p: str,
    by: tuple[str, ...] | list[str] = (),
    out: str = "FDR",
    max_group_rows: int | None = None,
) -> DataFrame:
    """Adds the adjusted p-value; null p stays null and is not counted.

    `max_group_rows` states a bound known from the plan, such as the number of
    score columns. Up to `WINDOW_ROWS` the groups are ranked in one window;
    without a bound the ranking is spread over ranges of the sampled p-values.
    """
    if max_group_rows is not None and max_group_rows <= WINDOW_ROWS:
        return _bh_window(df, p, list(by), out)
    return _bh_spread(df, p, list(by), out)


def _bh_window(df: DataFrame, p: str, by: list[str], out: str) -> DataFrame:
    w = Window.partitionBy(*by)
    # the default frame includes ties, so tied values share the largest rank
    rank = F.count(p).over(w.orderBy(F.asc_nulls_last(p)))
    raw = F.when(F.col(p).isNotNull(), F.col(p) * F.count(p).over(w) / rank)
    # running minimum from the largest p down: a frame open towards the end
    # of the order would be recomputed for every row
    down = w.orderBy(F.desc_nulls_first(p)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        df.withColumn("__raw", raw)
        .withColumn(
            out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__raw").over(down)))
        )
        .drop("__raw")
    )


def _bh_spread(df: DataFrame, p: str, by: list[str], out: str) -> DataFrame:
    """q(p) = min over p' >= p of p' n / rank(p'), on distinct p-values.

    The distinct p-values are cut in ranges of (group, p), ranked inside their
    range, and ranks and suffix minima are carried over between ranges through
    tables of one row per group and range. A task sorts a range, or the ranges
    of a group, never a group's values.
    """
    known = df.filter(quoted(p).isNotNull())
    counts = known.groupBy(*by, quoted(p).alias("__p")).agg(F.count("*").alias("__c"))
    counts = in_ranges(counts, [*by, "__p"], "__b")
    group = Window.partitionBy(*by)
    before = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.groupBy(*by, "__b")
        .agg(F.sum("__c").alias("__m"))
        .select(
            *by,
            "__b",
            F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"),
            F.sum("__m").over(group).alias("__n"),
        )
    )
    # suffix minima as running minima of the reversed order, linear in the rows
    inside = Window.partitionBy(*by, "__b")
    running = (Window.unboundedPreceding, Window.currentRow)
    upto = inside.orderBy("__p").rowsBetween(*running)
    onward = inside.orderBy(F.desc("__p")).rowsBetween(*running)
    raw = (
        null_safe_join(counts, starts, by + ["__b"])
        .withColumn("__rank", F.col("__start") + F.sum("__c").over(upto))
        .withColumn("__raw", F.col("__p") * F.col("__n") / F.col("__rank"))
    )
    after = group.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        raw.groupBy(*by, "__b")
        .agg(F.min("__raw").alias("__least"))
        .select(*by, "__b", F.min("__least").over(after).alias("__later"))
    )
    adjusted = null_safe_join(
        raw.withColumn("__onward", F.min("__raw").over(onward)), carried, by + ["__b"]
    ).select(
        *by,
        F.col("__p").alias(p),
        F.least(F.lit(1.0), "__onward", "__later").alias(out),
    )
    if by:
        return null_safe_join(df, adjusted, list(by) + [p], "left")
    return df.join(adjusted, p, "left")
