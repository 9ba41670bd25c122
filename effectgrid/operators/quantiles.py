"""Exact grouped quantiles in which no task holds an unbounded group."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effectgrid.functions.scalars import nan_to_null, quoted, value_bucket
from effectgrid.operators.joins import null_safe_join
from effectgrid.operators.ranges import in_ranges
from effectgrid.session import checkpointed

# values of one group that the built-in percentile may hold in a task
HELD_VALUES = 2_000_000
# columns per aggregate
BLOCK_COLUMNS = 64


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
    hot_rows: int | None = None, sizes: DataFrame | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles of `value` per key; `probs` maps names to probabilities.

    Nulls and NaN are ignored; groups without any value get nulls. `sizes` has
    the rows per key as `__rows`, where the caller has counted them already.
    """
    return _quantiles(df, keys, {out: (value, p) for out, p in probs.items()}, hot_rows, sizes)


def exact_medians(
    df: DataFrame, keys: list[str], columns: list[str], hot_rows: int | None = None,
    max_group_rows: int | None = None,
) -> DataFrame:
    """The median of each column per key.

    `max_group_rows` states a bound on the rows of a key that the caller knows;
    where it is small enough, nothing is counted first and one pass is enough.
    """
    wanted = {c: (c, 0.5) for c in columns}
    if keys and max_group_rows is not None and max_group_rows <= HELD_VALUES // min(len(columns), BLOCK_COLUMNS):
        values = df.select(*keys, *[nan_to_null(quoted(c).cast("double")).alias(c) for c in columns])
        return _by_lists(values, keys, columns)
    return _quantiles(df, keys, wanted, hot_rows)


def _by_lists(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Medians of groups that are known to be small: the middle of sorted lists.

    Few values of a small group are equal, so counting them first, as the
    built-in does, costs more than it saves.
    """
    blocks = []
    for start in range(0, len(columns), BLOCK_COLUMNS):
        block = columns[start : start + BLOCK_COLUMNS]
        lists = df.groupBy(*keys).agg(*[F.sort_array(F.collect_list(quoted(c))).alias(c) for c in block])
        blocks.append(lists.select(*keys, *[_middle(quoted(c)).alias(c) for c in block]))
    if len(blocks) == 1:
        return blocks[0]
    stacked = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), blocks)
    return stacked.groupBy(*keys).agg(*[F.max(quoted(c)).alias(c) for c in columns])


def _middle(values: Column) -> Column:
    """Median of a sorted array without nulls, null if it is empty."""
    n = F.size(values)
    low = F.get(values, F.floor((n - 1) / 2).cast("int"))
    high = F.get(values, F.floor(n / 2).cast("int"))
    return F.when(low == high, low).otherwise(low * 0.5 + high * 0.5)


def _quantiles(
    df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], hot_rows: int | None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Group sizes decide: ordinary groups by the built-in, hot ones by value buckets.

    A group is hot when a block of its columns has more than HELD_VALUES
    values. There are at most rows / hot_rows hot groups, so their key list
    can be broadcast; it is found first, and mostly there is none.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    values = df.select(
        *keys, *[nan_to_null(quoted(c).cast("double")).alias(c) for c in columns]
    )
    if not keys:
        return _by_buckets(values, keys, wanted)
    if hot_rows is None:
        hot_rows = HELD_VALUES // min(len(columns), BLOCK_COLUMNS)
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("__rows"))
    hot = checkpointed(sizes.filter(F.col("__rows") > hot_rows).select(*keys))
    if hot.isEmpty():
        return _by_aggregate(values, keys, wanted)
    hot = F.broadcast(hot)
    small = null_safe_join(values, hot, keys, "left_anti")
    large = null_safe_join(values, hot, keys, "left_semi")
    return _by_aggregate(small, keys, wanted).unionByName(_by_buckets(large, keys, wanted))


def _by_aggregate(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One aggregate per block of columns; the blocks meet in one more shuffle of group rows."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    blocks = []
    for start in range(0, len(columns), BLOCK_COLUMNS):
        block = columns[start : start + BLOCK_COLUMNS]
        aggs = [
            F.percentile(quoted(c), F.lit(float(p))).alias(out)
            for out, (c, p) in wanted.items()
            if c in block
        ]
        blocks.append(df.groupBy(*keys).agg(*aggs))
    if len(blocks) == 1:
        return blocks[0]
    stacked = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), blocks)
    return stacked.groupBy(*keys).agg(*[F.max(quoted(out)).alias(out) for out in wanted])


def _tally(values: DataFrame, group_keys: list[str]) -> DataFrame:
    """Counts and extremes per (key, column, bucket), combined in the map tasks."""
    return values.groupBy(*group_keys, "__b").agg(
        F.count("__v").alias("__m"), F.min("__v").alias("__low"), F.max("__v").alias("__high"),
        F.sum("__v").alias("__sum"), F.count_if(F.col("__v").isNull()).alias("__missing"),
    )


def _holding(tally: DataFrame, over: list[str], at: str, positions: list, start=None) -> DataFrame:
    """Of counted parts, ordered by `at`, those that hold one of the positions; `__start` before each."""
    group = Window.partitionBy(*over)
    upto = group.orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = tally.withColumn("__end", F.sum("__m").over(upto))
    if start is None:
        placed = placed.withColumn("__n", F.sum("__m").over(group))
    else:
        placed = placed.withColumn("__end", F.col("__end") + F.col(start))
    placed = placed.withColumn("__start", F.col("__end") - F.col("__m"))
    needed = F.col("__n") == 0
    for low, high, _ in positions:
        needed = needed | ((F.col("__start") <= high) & (low < F.col("__end")))
    return placed.filter(needed).drop("__end")


def _by_buckets(
    df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], tally: DataFrame | None = None
) -> DataFrame:
    """Quantiles of groups of any size.

    Pass one counts values per (key, column, bucket), with map-side combine,
    and finds the one or two buckets that hold each wanted position. Pass two
    reads the values of those buckets only, counted by value. These are cut in
    ranges of their sampled order, of which again only those that hold a
    position are sorted: ranges have like numbers of distinct values, wherever
    in the bucket the values lie.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    group_keys = [*keys, "__column"]
    values = _bucketed(df, keys, columns)
    if tally is None:
        tally = _tally(values, group_keys)

    def position(prob: float):
        exact = (F.col("__n") - 1) * F.lit(float(prob))
        return F.floor(exact), F.ceil(exact), exact - F.floor(exact)

    positions = [position(prob) for _, prob in wanted.values()]
    # one row per bucket: the group size does not matter any more
    targets = _holding(tally, group_keys, "__b", positions).drop(
        "__m", "__sum", "__missing", "__low", "__high"
    )
    if not keys:  # at most two buckets per wanted value
        targets = F.broadcast(targets)
    picked = (
        null_safe_join(values, targets, [*group_keys, "__b"])
        .groupBy(*group_keys, "__b", "__start", "__n", "__v")
        .agg(F.count("__v").alias("__c"))
        .withColumnRenamed("__start", "__before")
    )
    picked = in_ranges(picked, [*group_keys, "__b", "__v"], "__part")
    bucket = [*group_keys, "__b"]
    parts = picked.groupBy(*bucket, "__before", "__n", "__part").agg(F.sum("__c").alias("__m"))
    parts = _holding(parts, bucket, "__part", positions, "__before").select(*bucket, "__part", "__start")
    within = (
        Window.partitionBy(*bucket, "__part")
        .orderBy("__v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = (
        null_safe_join(picked, parts, [*bucket, "__part"])
        .withColumn("__to", F.col("__start") + F.sum("__c").over(within))
        .withColumn("__from", F.col("__to") - F.col("__c"))
    )

    picks, result = [], []
    for i, ((out, (column, _)), (low, high, share)) in enumerate(zip(wanted.items(), positions)):
        mine = F.col("__column") == column
        for tag, at in (("l", low), ("h", high)):
            here = mine & (F.col("__from") <= at) & (at < F.col("__to"))
            picks.append(F.max(F.when(here, F.col("__v"))).alias(f"__{tag}{i}"))
        picks.append(F.max(F.when(mine, share)).alias(f"__p{i}"))
        lo, hi, p = F.col(f"__l{i}"), F.col(f"__h{i}"), F.col(f"__p{i}")
        # as the built-in: equal neighbours, infinite ones too, are the value itself
        result.append(F.when(lo == hi, lo).otherwise(lo * (1 - p) + hi * p).alias(out))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *result)


def _bucketed(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    values = df.unpivot([quoted(k) for k in keys], [quoted(c) for c in columns], "__column", "__v")
    return values.withColumn("__b", value_bucket(F.col("__v")))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact column profile: count, missing, min, quartiles, mean, max.

    A whole column is one group, so the quartiles always go by buckets; the
    rest comes from the same counts of buckets.
    """
    long = df.select(*[quoted(c).cast("double").alias(c) for c in columns]).unpivot(
        [], [quoted(c) for c in columns], "column", "value"
    )
    long = long.withColumn("value", nan_to_null(F.col("value")))
    tally = checkpointed(_tally(_bucketed(long, ["column"], ["value"]), ["column", "__column"]))
    basics = tally.groupBy("column").agg(
        F.sum("__m").alias("n"),
        F.sum("__missing").alias("n_missing"),
        F.min("__low").alias("min"),
        F.try_divide(F.sum("__sum"), F.sum("__m")).alias("mean"),
        F.max("__high").alias("max"),
    )
    wanted = {"q1": ("value", 0.25), "median": ("value", 0.5), "q3": ("value", 0.75)}
    quartiles = _by_buckets(long, ["column"], wanted, tally)
    return basics.join(quartiles, "column", "left")
