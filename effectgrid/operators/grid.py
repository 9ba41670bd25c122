"""Grid completion and orderings of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effectgrid.functions.scalars import quoted
from effectgrid.operators.joins import null_safe_join
from effectgrid.session import checkpointed

# tasks that a group's labels are dealt to while its axes meet
SPREAD = 32


def complete_grid(
    df: DataFrame,
    axes: dict[str, list[str] | None],
    fill: dict[str, object],
    by: list[str] | None = None,
) -> DataFrame:
    """Every combination of the axis values, missing measures filled.

    An axis with a level list uses all its levels (seen or not), an axis given
    as None the values observed; a null value is an axis value where it
    occurs. With `by`, each group is completed on its own. `fill` also fills
    nulls that were there before. `df` is an aggregated table with one row per
    combination; it is checkpointed, as every axis is read from it.

    The axes are tables of one row per group and value. The longer the grid
    gets, the more the next axis is repeated: it meets SPREAD parts of each
    group, dealt by the values so far, so a group's grid is not made in one task.
    """
    by = by or []
    df = checkpointed(df)
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1)
    full = None
    # observed axes first: they can be long, and the listed ones are then repeated
    for name, levels in sorted(axes.items(), key=lambda axis: axis[1] is not None):
        seen = df.select(*by, quoted(name))
        if levels is not None:
            listed = F.explode(F.array(*[F.lit(v) for v in levels])).alias(name)
            seen = groups.select(*by, listed).unionByName(seen.filter(quoted(name).isNull()))
        seen = seen.distinct()
        if full is None:
            full = seen
            continue
        dealt = full.withColumn("__deal", F.pmod(F.xxhash64(*[quoted(c) for c in full.columns]), F.lit(SPREAD)).cast("int"))
        repeated = seen.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        full = null_safe_join(dealt, repeated, [*by, "__deal"]).drop("__deal")
    cells = full.select(*by, *axes)
    return null_safe_join(cells, df, by + list(axes), "left").fillna(fill)


def level_order(df: DataFrame, label: str, total: str, out: str) -> DataFrame:
    """Adds the 1-based place of each label by descending sum of `total`.

    For completed grids: the windows see one row per grid cell, not the data.
    """
    sums = df.withColumn("__total", F.sum(total).over(Window.partitionBy(label)))
    w = Window.orderBy(F.desc("__total"), F.asc_nulls_last(label))
    return sums.withColumn(out, F.dense_rank().over(w).cast("bigint")).drop("__total")


def peak_order(df: DataFrame, label: str, value: str, out: str) -> DataFrame:
    """Adds the 1-based place of each label by descending largest absolute value.

    For top-N reports, whose size is fixed by N.
    """
    peaks = df.withColumn("__peak", F.max(F.abs(value)).over(Window.partitionBy(label)))
    w = Window.orderBy(F.desc_nulls_last("__peak"), F.asc_nulls_last(label))
    return peaks.withColumn(out, F.dense_rank().over(w).cast("bigint")).drop("__peak")


def panel_order(df: DataFrame, panel: list[str], label: str, value: str, out: str) -> DataFrame:
    """Adds the place of the label within its panel by ascending mean of `value`.

    `df` is a top-N report, so a panel holds at most N labels.
    """
    means = df.withColumn("__mean", F.avg(value).over(Window.partitionBy(*panel, label)))
    w = Window.partitionBy(*panel).orderBy(F.asc_nulls_first("__mean"), F.asc(label))
    return means.withColumn(out, F.dense_rank().over(w).cast("bigint")).drop("__mean")
