"""Counting operators over effect rows.

Each one first reduces to one row per (keys, item) with map-side combine, so a
key that holds a large share of the rows is spread over its items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectgrid.functions.scalars import log2_ratio, quoted
from effectgrid.operators.joins import null_safe_join
from effectgrid.operators.quantiles import exact_quantiles
from effectgrid.session import checkpointed


def frequency(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def most_frequent(df: DataFrame, keys: list[str], n: int = 20, out: str = "n") -> DataFrame:
    return frequency(df, keys, out).orderBy(F.desc(out), *keys).limit(n)


def distinct_counts(
    df: DataFrame,
    keys: list[str],
    item: str = "gene",
    out: str = "n_sig",
    overall: str | None = None,
    overall_label: str = "(all)",
) -> DataFrame:
    """Distinct items per key combination.

    With `overall`, that key also gets a row set under `overall_label` that
    counts over all its values at once (distinct counts do not add up), as
    one GROUPING SETS job. Null items do not count, but their groups stay.
    """
    items = df.select(*keys, item).distinct()
    if overall is None:
        counted = items.groupBy(*keys).agg(F.count(item).alias(out))
    else:
        rest = [k for k in keys if k != overall]
        counted = (
            items.groupingSets(
                [[quoted(k) for k in keys], [quoted(k) for k in rest]], *[quoted(k) for k in keys]
            )
            .agg(F.countDistinct(item).alias(out), F.grouping(overall).alias("__all"))
            .withColumn(overall, F.when(F.col("__all") == 1, overall_label).otherwise(F.col(overall)))
            .drop("__all")
        )
    return counted


def counts_with_median(
    df: DataFrame, keys: list[str], item: str = "gene", value: str = "logFC",
    count_out: str = "n_sig", median_out: str = "med_lfc",
) -> DataFrame:
    """Distinct items and median value per key; the row counts size the median's groups."""
    items = df.groupBy(*keys, item).agg(F.count("*").alias("__rows"))
    counted = checkpointed(
        items.groupBy(*keys).agg(F.count(item).alias(count_out), F.sum("__rows").alias("__rows"))
    )
    medians = exact_quantiles(df, keys, value, {median_out: 0.5}, sizes=counted)
    return null_safe_join(counted.drop("__rows"), medians, keys, "left")


def direction_ratio(
    df: DataFrame, keys: list[str], item: str = "gene", effect: str = "logFC", pseudo: float = 0.5
) -> DataFrame:
    """Distinct items going up and down, and the log2 ratio of the two.

    A null item is not counted, as in the other counts of distinct items; a
    group without any other keeps its row.
    """
    known = F.col(item).isNotNull().cast("bigint")
    per_item = df.groupBy(*keys, item).agg(
        F.max((F.col(effect) > 0).cast("bigint")).alias("__up"),
        F.max((F.col(effect) <= 0).cast("bigint")).alias("__down"),
    )
    return (
        per_item.groupBy(*keys)
        .agg(F.sum(F.col("__up") * known).alias("up"), F.sum(F.col("__down") * known).alias("down"))
        .withColumn("log2_up_down", log2_ratio(F.col("up"), F.col("down"), pseudo))
    )


def recurrence(
    df: DataFrame, keys: list[str], factor: str = "path_short", effect: str = "logFC"
) -> DataFrame:
    """For each key: in how many factors it occurs, and with which sign."""
    per_factor = df.groupBy(*keys, factor).agg(
        F.max((F.col(effect) > 0).cast("bigint")).alias("__pos"),
        F.max((F.col(effect) < 0).cast("bigint")).alias("__neg"),
    )
    return per_factor.groupBy(*keys).agg(
        F.count(factor).alias("n_path"),
        F.sum("__pos").alias("pos"),
        F.sum("__neg").alias("neg"),
    )


def exclusive_tallies(
    df: DataFrame, keys: list[str], item: str = "gene", group: str = "sex",
    a: str = "female", b: str = "male",
) -> DataFrame:
    """Items hit in both groups, in only one of them, in none (always 0 here)."""
    hits = df.groupBy(*keys, item).agg(
        F.bool_or(F.col(group) == a).alias("__a"), F.bool_or(F.col(group) == b).alias("__b")
    )
    in_a, in_b = F.coalesce("__a", F.lit(False)), F.coalesce("__b", F.lit(False))
    return hits.groupBy(*keys).agg(
        F.count_if(in_a & in_b).alias("both"),
        F.count_if(in_a & ~in_b).alias("f_only"),
        F.count_if(~in_a & in_b).alias("m_only"),
        F.count_if(~in_a & ~in_b).alias("none"),
    )


def box_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles and whisker ends (1.5 IQR rule) of a completed count grid."""
    boxes = df.groupBy(*keys).agg(
        F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q")
    )
    q1, q2, q3 = (F.col("__q")[i] for i in range(3))
    reach = (q3 - q1) * 1.5
    inside = F.col(value).between(q1 - reach, q3 + reach)
    return (
        null_safe_join(df, boxes, keys)
        .groupBy(*keys)
        .agg(
            F.min(F.when(inside, F.col(value).cast("double"))).alias("lower"),
            F.first(q1).alias("q1"),
            F.first(q2).alias("median"),
            F.first(q3).alias("q3"),
            F.max(F.when(inside, F.col(value).cast("double"))).alias("upper"),
            F.count(value).alias("n"),
        )
    )


def cross_table(df: DataFrame, key: str, condition, yes: str = "n_true", no: str = "n_false") -> DataFrame:
    """Rows per key for which a condition holds and does not."""
    return df.groupBy(key).agg(
        F.count_if(condition).alias(yes), F.count_if(~condition).alias(no)
    )
