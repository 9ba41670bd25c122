"""Item x dimension matrices in long form, and correlation distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effectgrid.functions.scalars import winsorise
from effectgrid.session import checkpointed

#: Items of a tile and dimensions of a block, about.
TILE_ITEMS, BLOCK_DIMS = 256, 1024
#: Rows of a result that a task hands on at a time.
OUT_ROWS = 1 << 15
#: Squares that are left after centring, as a part of those before, which rounding explains.
_ROUNDING = 1e-13


def variance_top_matrix(
    long: DataFrame, row: str, col: str, value: str, n: int = 150, cap: float = 2.0,
    min_values: int = 1, zero_is_missing: bool = True,
) -> DataFrame:
    """The n rows of largest variance, values clamped to [-cap, cap].

    `long` has one value per (row, col); absent and null cells are missing, and
    so are zeros if so asked. Variances are taken before clamping; rows with
    fewer than two values have none and drop out. Ties go by row name; values
    equal to 12 decimals are ties.
    """
    cell = F.nullif(F.col(value), F.lit(0.0)) if zero_is_missing else F.col(value)
    cells = long.select(row, col, cell.alias(value)).filter(F.col(value).isNotNull())
    best = (
        cells.groupBy(row)
        .agg(F.var_samp(value).alias("__var"), F.count(value).alias("__n"))
        .filter(F.col("__var").isNotNull() & (F.col("__n") >= min_values))
        .orderBy(F.desc(F.round("__var", 12)), F.asc(row))
        .limit(n)
        .select(row)
    )
    return cells.join(best, row, "left_semi").select(
        row, col, winsorise(F.col(value), cap).alias(value)
    )


def pairwise_distance(long: DataFrame, item: str, dim: str, value: str) -> DataFrame:
    """1 - Pearson correlation over the dimensions both items have, for a < b.

    Pairs without a defined correlation (fewer than two shared dimensions, or a
    constant side) are at distance 1. `long` has one value per (item, dim); null
    values, items and dimensions are left out.

    Items are dealt to tiles and dimensions to blocks; a tile's values in a block are
    one packed row. Each two tiles meet in a row of their own, where six masked
    matrix products give the counts and sums of all their pairs of items. Only with
    several blocks are these summed by a shuffle. The result has a row for each pair
    of items, as asked; no row holds all items or dimensions.
    """
    known = F.col(value).isNotNull() & F.col(item).isNotNull() & F.col(dim).isNotNull()
    cells = long.filter(known).select(
        F.col(item).alias("__item"), F.col(dim).alias("__dim"), F.col(value).cast("double").alias("__value")
    )
    cells = checkpointed(cells)
    sizes = cells.agg(F.countDistinct("__item").alias("items"), F.countDistinct("__dim").alias("dims")).first()
    tiles, blocks = max(1, -(-sizes["items"] // TILE_ITEMS)), max(1, -(-sizes["dims"] // BLOCK_DIMS))
    # correlations do not change with an item's own shift
    items = cells.groupBy("__item").agg(F.avg("__value").alias("__mean"))
    items = items.withColumn("__tile", F.pmod(F.xxhash64("__item"), F.lit(tiles)).cast("int"))
    dims = cells.select("__dim").distinct().withColumn("__block", F.pmod(F.xxhash64("__dim"), F.lit(blocks)).cast("int"))
    at = F.row_number().over(Window.partitionBy("__block").orderBy("__dim")) - 1  # about BLOCK_DIMS rows
    dims = dims.withColumn("__at", at)
    placed = cells.join(items, "__item").join(dims, "__dim").select(
        "__tile", "__block", "__item", "__at", (F.col("__value") - F.col("__mean")).alias("__value")
    )
    # each item is in each block, so that pairs without a shared dimension are seen
    absent = F.lit(None).cast("double").alias("__value")
    in_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block")
    every = items.select("__tile", in_blocks, "__item", F.lit(0).alias("__at"), absent)
    kind = cells.schema["__item"].dataType
    packed_schema = T.StructType(
        [
            T.StructField("__tile", T.IntegerType()), T.StructField("__block", T.IntegerType()),
            T.StructField("__items", T.ArrayType(kind)), T.StructField("__places", T.BinaryType()),
            T.StructField("__values", T.BinaryType()),
        ]
    )

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(frame["__item"], sort=True)
        seen = frame["__value"].notna().to_numpy()
        where = np.stack([codes[seen], frame["__at"].to_numpy()[seen]]).astype(np.int32)
        held = frame["__value"].to_numpy(float)[seen]
        row = (frame["__tile"].iloc[0], frame["__block"].iloc[0], list(names), where.tobytes(), held.tobytes())
        return pd.DataFrame([row], columns=packed_schema.names)

    packed = placed.unionByName(every).groupBy("__tile", "__block").applyInPandas(pack, packed_schema)
    packed = checkpointed(packed)

    def side(tag: str) -> list[Column]:
        return [F.col(c).alias(f"{c}_{tag}") for c in ("__items", "__places", "__values")]

    tile = F.col("__tile")
    one = packed.select("__block", tile.alias("__one"), F.explode(F.sequence(tile, F.lit(tiles - 1))).alias("__two"), *side("one"))
    two = packed.select("__block", F.explode(F.sequence(F.lit(0), tile)).alias("__one"), tile.alias("__two"), *side("two"))
    met = one.join(two, ["__block", "__one", "__two"])
    sums = ["n", "x", "y", "xx", "yy", "xy"]
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), *[T.StructField(c, T.DoubleType()) for c in sums]])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                tags = ("one", "two")
                names = [row[f"__items_{tag}"].values for tag in tags]
                places = [np.frombuffer(row[f"__places_{tag}"].as_py(), np.int32).reshape(2, -1) for tag in tags]
                width = 1 + max([int(p[1].max()) for p in places if p.size], default=0)
                sides = []
                for tag, own, where in zip(tags, names, places):
                    held, mask = np.zeros((len(own), width)), np.zeros((len(own), width))
                    held[where[0], where[1]] = np.frombuffer(row[f"__values_{tag}"].as_py())
                    mask[where[0], where[1]] = 1.0
                    sides.append((held, mask))
                (x, mx), (y, my) = sides
                found = (mx @ my.T, x @ my.T, mx @ y.T, (x * x) @ my.T, mx @ (y * y).T, x @ y.T)
                i, j = (v.ravel() for v in np.indices(found[0].shape))
                left, right = names[0].take(pa.array(i)), names[1].take(pa.array(j))
                ordered = pc.less(left, right)
                if row["__one"] == row["__two"]:
                    kept = ordered.to_numpy(zero_copy_only=False)
                    i, j = i[kept], j[kept]
                    left, right, ordered = (c.filter(ordered) for c in (left, right, ordered))
                a, b = pc.if_else(ordered, left, right), pc.if_else(ordered, right, left)
                for start in range(0, len(i), OUT_ROWS):
                    part = slice(start, start + OUT_ROWS)
                    columns = [a[part], b[part], *[pa.array(f[i[part], j[part]]) for f in found]]
                    yield pa.RecordBatch.from_arrays(columns, ["a", "b", *sums])

    pairs = met.mapInArrow(products, schema)
    if blocks > 1:
        pairs = pairs.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in sums])
    n = F.col("n")

    def spread(total: str, squares: str) -> Column:
        """Centred squares; what rounding alone leaves is nothing."""
        centred = F.col(squares) - F.try_divide(F.col(total) * F.col(total), n)
        return F.when((n > 1) & (centred > _ROUNDING * F.col(squares)), centred)

    together = F.col("xy") - F.try_divide(F.col("x") * F.col("y"), n)
    r = F.try_divide(together, F.sqrt(spread("x", "xx")) * F.sqrt(spread("y", "yy")))
    r = F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
    return pairs.select("a", "b", F.coalesce(F.lit(1.0) - r, F.lit(1.0)).alias("dist"))


def widen(long: DataFrame, row: str, col: str, value: str, columns: list[str]) -> DataFrame:
    """Long to wide with a stated column list."""
    return long.groupBy(row).pivot(col, columns).agg(F.first(value))
