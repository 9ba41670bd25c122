"""Moments of every (predictor, response) model from blocked matrix products.

A model of a response y on a predictor x and a covariate z uses the rows in which
all three are present, so each model has its own rows. With absent entries set to
zero and masks of what is present, the counts, sums and products of all models
are matrix products of predictor columns with response columns. Each task forms
them for its rows, one key after the other, about a shift of its own near the
means; it passes on a short row of counts, means and centred products per key and
block of columns. These rows are merged in two steps by the update formula for
centred products, so nothing large is subtracted and no key is one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effectgrid.functions.scalars import nan_to_null, quoted

#: Predictors and responses of a block.
BLOCK_X, BLOCK_Y = 16, 128
#: Numbers that a task holds before it passes its moments on.
HELD = 1 << 22
#: Rows of a key's moments that are merged in the first step share one of so many slots.
SLOTS = 64

#: Over the rows with x, over those with x and y, over those with x, y and z: counts, means, centred products.
X_ONLY = ("x_n", "x_mean", "x_xx")
Z_ONLY = ("z_n", "z_mean", "z_zz")
PAIRED = ("pair_n", "pair_mx", "pair_my", "pair_xx")
COMPLETE = ("n", "mx", "mz", "my", "xx", "zz", "yy", "xz", "xy", "zy")
PLANES = X_ONLY + Z_ONLY + PAIRED + COMPLETE
#: Which planes are a count, its means, and the products with the two means that they are about.
GROUPS = (
    ("x_n", ("x_mean",), {"x_xx": ("x_mean", "x_mean")}),
    ("z_n", ("z_mean",), {"z_zz": ("z_mean", "z_mean")}),
    ("pair_n", ("pair_mx", "pair_my"), {"pair_xx": ("pair_mx", "pair_mx")}),
    (
        "n", ("mx", "mz", "my"),
        {"xx": ("mx", "mx"), "zz": ("mz", "mz"), "yy": ("my", "my"), "xz": ("mx", "mz"), "xy": ("mx", "my"), "zy": ("mz", "my")},
    ),
)
_AT = {name: i for i, name in enumerate(PLANES)}


class _Sums:
    """Running sums of one key about a fixed shift."""

    def __init__(self, x: np.ndarray, y: np.ndarray, z: np.ndarray):
        def centre(a):
            # the lower median: a value of the column, so that a constant one has no spread at all
            seen = np.isfinite(a)
            ordered = np.sort(np.where(seen, a, np.inf), axis=0)
            at = np.maximum(seen.sum(axis=0) - 1, 0) // 2
            middle = np.take_along_axis(ordered, at[None, ...], axis=0)[0]
            return np.where(np.isfinite(middle), middle, 0.0)

        self.shift = centre(x), centre(y), float(centre(z))
        self.total = np.zeros((len(PLANES), x.shape[1], y.shape[1]))
        self.add(x, y, z)

    def add(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> None:
        def parted(a, shift):
            seen = ~np.isnan(a)
            endless = np.isinf(a)
            return np.where(seen & ~endless, a - shift, 0.0), seen.astype(float), endless.astype(float)

        (x, mx, ix), (y, my, iy), (z, mz, iz) = (parted(a, s) for a, s in zip((x, y, z), self.shift))
        z, mz, iz = z[:, None], mz[:, None], iz[:, None]
        ones = np.ones((1, self.total.shape[2]))
        t = self.total
        for name, value in (
            ("x_n", mx.sum(axis=0)[:, None] * ones), ("x_mean", x.sum(axis=0)[:, None] * ones), ("x_xx", (x * x).sum(axis=0)[:, None] * ones),
            ("z_n", mz.sum()), ("z_mean", z.sum()), ("z_zz", (z * z).sum()),
            ("pair_n", mx.T @ my), ("pair_mx", x.T @ my), ("pair_my", mx.T @ y), ("pair_xx", (x * x).T @ my),
            ("n", (mx * mz).T @ my), ("mx", (x * mz).T @ my), ("mz", (mx * z).T @ my), ("my", (mx * mz).T @ y),
            ("xx", (x * x * mz).T @ my), ("zz", (mx * z * z).T @ my), ("yy", (mx * mz).T @ (y * y)),
            ("xz", (x * z).T @ my), ("xy", (x * mz).T @ y), ("zy", (mx * z).T @ y),
        ):
            t[_AT[name]] += value
        if ix.any() or iy.any() or iz.any():
            # an infinite value makes the moments of the models that it is in undefined
            for names, bad in (
                (X_ONLY, ix.sum(axis=0)[:, None] * ones), (Z_ONLY, iz.sum() * np.ones_like(t[0])),
                (PAIRED, ix.T @ my + mx.T @ iy), (COMPLETE, (ix * mz).T @ my + (mx * mz).T @ iy + (mx * iz).T @ my),
            ):
                for name in names[1:]:
                    t[_AT[name]][bad > 0] = np.nan

    def centred(self) -> np.ndarray:
        """Counts, means and centred products in place of the sums."""
        sx, sy, sz = self.shift
        base = {
            "x_mean": sx[:, None], "z_mean": sz, "pair_mx": sx[:, None], "pair_my": sy[None, :], "mx": sx[:, None], "mz": sz, "my": sy[None, :],
        }
        out = np.zeros_like(self.total)
        for count, means, products in GROUPS:
            n = self.total[_AT[count]]
            some = np.maximum(n, 1)
            out[_AT[count]] = n
            for name, (a, b) in products.items():
                out[_AT[name]] = self.total[_AT[name]] - self.total[_AT[a]] * self.total[_AT[b]] / some
            for name in means:
                out[_AT[name]] = np.where(n > 0, self.total[_AT[name]] / some + base[name], 0.0)
        return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of two sets of rows taken together."""
    out = np.empty_like(a)
    for count, means, products in GROUPS:
        na, nb = a[_AT[count]], b[_AT[count]]
        n = na + nb
        some = np.maximum(n, 1)
        out[_AT[count]] = n
        step = {name: b[_AT[name]] - a[_AT[name]] for name in means}
        for name in means:
            out[_AT[name]] = np.where(nb == 0, a[_AT[name]], np.where(na == 0, b[_AT[name]], a[_AT[name]] + step[name] * nb / some))
        for name, (u, v) in products.items():
            out[_AT[name]] = a[_AT[name]] + b[_AT[name]] + np.where((na > 0) & (nb > 0), step[u] * step[v] * na * nb / some, 0.0)
    return out


def model_moments(
    df: DataFrame, keys: list[str], responses: list[str], predictors: list[str], covariate: str,
    names: tuple[str, str] = ("pathway", "predictor"), clean: Callable[[Column], Column] = lambda c: c,
) -> DataFrame:
    """keys, response name, predictor name and PLANES: a row per model; the input is read once.

    NaN is missing; `clean` is applied to predictors and responses. A model with
    an infinite value among its rows has null moments. Every key that occurs has a
    row for each model, with counts of zero where no row has both.
    """
    number = lambda c: nan_to_null(quoted(c).cast("double"))
    held = lambda c: F.coalesce(c, F.lit(float("nan")))
    rows = df.select(
        *keys,
        held(number(covariate)).alias("__z"),
        F.array(*[held(clean(number(c))) for c in predictors]).alias("__x"),
        F.array(*[held(clean(number(c))) for c in responses]).alias("__y"),
    )
    key_fields = [rows.schema[k] for k in keys]
    width, height = len(predictors), len(responses)
    blocks = [(i, j) for i in range(0, width, BLOCK_X) for j in range(0, height, BLOCK_Y)]
    part_schema = T.StructType(
        [*key_fields, T.StructField("__i", T.IntegerType()), T.StructField("__j", T.IntegerType()), T.StructField("__part", T.ArrayType(T.DoubleType()))]
    )
    shape = lambda i, j: (len(PLANES), min(BLOCK_X, width - i), min(BLOCK_Y, height - j))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_sums: dict[tuple, _Sums] = {}

        def put():
            for key, sums in held_sums.items():
                moments = sums.centred()
                for i, j in blocks:
                    part = moments[:, i : i + BLOCK_X, j : j + BLOCK_Y].ravel()
                    arrays = [pa.array([k], f.type) for k, f in zip(key, key_types)]
                    arrays += [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([part], pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(arrays, [*keys, "__i", "__j", "__part"])
            held_sums.clear()

        key_types = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key_types = [batch.schema.field(k) for k in range(len(keys))]
            columns = [batch.column(k).to_pylist() for k in range(len(keys))]
            x = batch.column(len(keys) + 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y = batch.column(len(keys) + 2).flatten().to_numpy(zero_copy_only=False).reshape(-1, height)
            z = batch.column(len(keys)).to_numpy(zero_copy_only=False)
            where: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*columns)):
                where.setdefault(key, []).append(at)
            for key, at in where.items():
                if key in held_sums:
                    held_sums[key].add(x[at], y[at], z[at])
                else:
                    held_sums[key] = _Sums(x[at], y[at], z[at])
                if len(held_sums) * width * height * len(PLANES) > HELD:
                    yield from put()
        yield from put()

    def together(frame: pd.DataFrame) -> np.ndarray:
        i, j = int(frame["__i"].iloc[0]), int(frame["__j"].iloc[0])
        total = None
        for part in frame["__part"]:
            part = np.asarray(part, float).reshape(shape(i, j))
            total = part if total is None else merged(total, part)
        return total

    def halfway(frame: pd.DataFrame) -> pd.DataFrame:
        out = frame[[*keys, "__i", "__j"]].iloc[:1].copy()
        out["__part"] = [together(frame).ravel()]
        return out

    def models(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = int(frame["__i"].iloc[0]), int(frame["__j"].iloc[0])
        total = together(frame)
        p, r = total.shape[1:]
        out = {k: [frame[k].iloc[0]] * (p * r) for k in keys}
        out[names[0]] = [responses[j + b] for _ in range(p) for b in range(r)]
        out[names[1]] = [predictors[i + a] for a in range(p) for _ in range(r)]
        return pd.DataFrame(out | {name: total[at].ravel() for name, at in _AT.items()})

    model_schema = T.StructType(
        [*key_fields, *[T.StructField(n, T.StringType()) for n in names], *[T.StructField(n, T.DoubleType()) for n in PLANES]]
    )
    parts = rows.mapInArrow(partial, part_schema).withColumn("__slot", F.pmod(F.spark_partition_id(), F.lit(SLOTS)))
    own = [quoted(k) for k in keys]
    half = parts.groupBy(*own, "__i", "__j", "__slot").applyInPandas(halfway, part_schema)
    return half.groupBy(*own, "__i", "__j").applyInPandas(models, model_schema)
