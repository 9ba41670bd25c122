"""Reading and stacking tables."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effectgrid.functions.scalars import nan_columns_to_null, quoted


def stack_named(tables: dict[str, DataFrame]) -> DataFrame:
    """Union by column name; `idx` and `list_name` tell the source table."""
    tagged = [
        df.withColumns({"idx": F.lit(name), "list_name": F.lit(name)})
        for name, df in tables.items()
    ]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_contrasts(
    spark: SparkSession, folder: str | list[str], schema: T.StructType | None = None
) -> DataFrame:
    """One effect table per Parquet file or folder of part files, stacked in a single scan.

    `folder` holds the tables, or is a list of their paths. `list_name` is the
    name of the table's file or folder without extension, one name for all its
    parts. Without a schema those of all files are merged.
    """
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    paths = folder if isinstance(folder, list) else [folder]
    stacked = reader.option("recursiveFileLookup", "true").parquet(*paths)
    file = F.col("_metadata.file_path")
    if isinstance(folder, list):  # the folder of the part files, or else the file, has the table's name
        ends = "|".join(re.escape(p.rstrip("/").rsplit("/", 1)[-1]) for p in paths)
        name = F.regexp_extract(file, rf"/({ends})(?:/[^/]*)*$", 1)
    else:
        top = re.escape(folder.rstrip("/").rsplit("/", 1)[-1])
        name = F.regexp_extract(file, rf"/{top}/([^/]+)(?:/[^/]*)*$", 1)
    stacked = stacked.withColumn("list_name", F.regexp_replace(name, r"\.parquet$", ""))
    return nan_columns_to_null(stacked.withColumn("idx", F.col("list_name")))


def r_name(name: str) -> str:
    """Column name with every character outside letters, digits, dot and underscore as a dot."""
    clean = re.sub(r"[^0-9A-Za-z._]", ".", name)
    return clean if re.match(r"[A-Za-z]|\.(?![0-9])", clean) else "X" + clean


def read_wide_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, partitions: int | None = None
) -> DataFrame:
    """Header CSV, plain or gzipped.

    Without a schema the types are inferred, which reads the whole file once
    more; give one for large files. A gzip file is one split, so its rows are spread after the scan, by size
    unless a partition count is given.
    """
    reader = spark.read.option("header", True).option("nullValue", "NA").option("nanValue", "NaN")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    df = df.toDF(*[r_name(c) for c in df.columns])
    if path.endswith(".gz"):
        df = df.repartition(partitions) if partitions else df.hint("rebalance")
    return nan_columns_to_null(df)


def read_in_order(spark: SparkSession, path: str, order: str = "file_order") -> DataFrame:
    """Parquet rows with their place: the file, then the row's number in it.

    The place is stored data, so it is the same however the scan is split; the
    first row in file order is the least place of a group, found by an aggregate.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = spark.read.parquet(path)
    return rows.select(*[quoted(c) for c in rows.columns if c != order], place.alias(order))


def first_available(
    spark: SparkSession,
    table: str | None = None,
    path: str | None = None,
    derived: DataFrame | None = None,
) -> DataFrame:
    """A catalog table or view, else a Parquet path, else a derived table."""
    if table and spark.catalog.tableExists(table):
        return spark.table(table)
    if path:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.read.parquet(path)
    if derived is not None:
        return derived
    raise ValueError(f"no source found: table={table!r}, path={path!r}")


def rename_if_absent(df: DataFrame, old: str, new: str) -> DataFrame:
    """`old` becomes `new` where there is no `new`; an error where there is neither."""
    if new in df.columns:
        return df
    if old not in df.columns:
        raise ValueError(f"neither {new!r} nor {old!r} in {df.columns}")
    return df.withColumnRenamed(old, new)


def literal_table(spark: SparkSession, values: dict[str, int], key: str, value: str) -> DataFrame:
    """Two-column table of a dict given in code."""
    schema = T.StructType(
        [T.StructField(key, T.StringType()), T.StructField(value, T.IntegerType())]
    )
    return spark.createDataFrame([(k, int(v)) for k, v in values.items()], schema)


def first_row_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest `order` per key, by a combining aggregate."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(quoted(order).alias("__order"), *[quoted(c).alias(c) for c in rest]))
    return df.groupBy(*keys).agg(first.alias("__row")).select(
        *keys, *[F.col("__row")[c].alias(c) for c in rest]
    )
