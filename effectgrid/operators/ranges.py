"""Rows cut in ranges of their sampled order, for ranks and minima of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectgrid.functions.scalars import quoted
from effectgrid.session import checkpointed

# ranges for each shuffle partition, so that tasks which draw several stay even
RANGES = 4


def in_ranges(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds the number of the row's range in ascending order of the columns, nulls first.

    Boundaries come from Spark's sample of the rows, so ranges hold like
    numbers of rows however close their values lie; rows that are equal in all
    columns share a range. The rows are checkpointed, so that every reader
    sees the same ranges.
    """
    ranges = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *[quoted(c) for c in order])
    return checkpointed(dealt.withColumn(out, F.spark_partition_id()))
