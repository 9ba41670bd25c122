"""Embedding whitening by shifted CholeskyQR.

Entries become integers, equal vectors count once. With the vectors' sums S known,
a row of the centred matrix is (n x - S) / n, exact up to its last division, and
A holds it over the root of n, so that A'A is the covariance. Then

1. G = A'A + shift, R1 its Cholesky factor: the shift keeps G positive definite in
   floating point however badly conditioned A is;
2. twice more: the rows are put through the triangular solves of the factors so
   far (Q = A R1^-1 R2^-1 ..), and the factor of Q'Q is the next one.

R = R3 R2 R1 has the singular values and right singular vectors of A to double
precision, with no squaring of the condition. Every pass over the rows is a Spark
job whose tasks return one small matrix each; Spark sums these, and the driver
holds d x d numbers (d the length of a vector), never rows.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectgrid.llm.tables import stored

#: Entries are cut to multiples of 1/256. Fixed by the task.
SCALE = 256
COMPONENTS = 4
#: Gram passes after the shifted one.
REPEATS = 2
LONGEST = 2**63 - 1


def whole_vectors(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, x): x = floor(256 c) of rows whose vector has neither null nor non-finite entries."""
    vector = F.col(f"`{vector_column}`")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.where(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    x = F.transform(vector, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long"))
    return rows.select(F.col(f"`{id_column}`").alias("id"), x.alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], d: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _totals(fit: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The sum over all blocks of rows of `of(block)`, an array of `width` doubles."""

    def partial(batches):
        total = np.zeros(width)
        for _, block in _blocks(batches, d):
            total += of(block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["at", "part"])

    parts = fit.mapInArrow(partial, "at long, part double")
    out = np.zeros(width)
    for row in parts.groupBy("at").agg(F.sum("part").alias("total")).collect():  # width rows
        out[row["at"]] = row["total"]
    return out


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int], int]:
    """Rows, exact sums by dimension, and the largest size of an entry."""

    def partial(batches):
        n, total, most = 0, [0] * d, 0
        for _, block in _blocks(batches, d):
            n += len(block)
            here = max(int(block.max()), -int(block.min()))
            most = max(most, here)
            exact = block.astype(object) if here * len(block) > LONGEST else block
            total = [a + int(b) for a, b in zip(total, exact.sum(axis=0))]
        values = [decimal.Decimal(v) for v in (*total, n, most)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 2), pa.int64()), pa.array(values, pa.decimal128(38, 0))], ["at", "part"])

    parts = fit.mapInArrow(partial, "at long, part decimal(38,0)")
    found = {r["at"]: r for r in parts.groupBy("at").agg(F.sum("part").alias("total"), F.max("part").alias("most")).collect()}  # d + 2 rows
    return int(found[d]["total"]), [int(found[k]["total"]) for k in range(d)], int(found[d + 1]["most"])


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows R^-1 for an upper triangular R, by substitution, all rows at once."""
    out = np.empty_like(rows)
    for j in range(len(r)):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular R with R'R = gram + shift; the shift grows until that is positive definite."""
    eye = np.eye(len(gram))
    least = np.finfo(float).eps * len(gram) * max(np.trace(gram), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * eye).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, least)


def _centred(n: int, sums: list[int], most: int) -> Callable[[np.ndarray], np.ndarray]:
    """x -> x - S / n in doubles; numerators are exact where 64 bits hold them."""
    small = 2 * n * most < LONGEST
    total = np.array(sums, np.int64) if small else np.array([float(s) for s in sums])

    def centred(block: np.ndarray) -> np.ndarray:
        return (n * block - total) / n if small else block - total / n

    return centred


class Whitening:
    """Fitted: n, sums, components (rows of unit length), their singular values, and the trace."""

    def __init__(self, fit: DataFrame, d: int, components: int = COMPONENTS, repeats: int = REPEATS):
        self.d = d
        self.n, self.sums, self.most = _sums(fit, d)
        n, centred = self.n, _centred(self.n, self.sums, self.most)
        factors: list[np.ndarray] = []

        def gram(block: np.ndarray) -> np.ndarray:
            rows = centred(block) / np.sqrt(n)
            for r in factors:
                rows = solved(rows, r)
            return (rows.T @ rows).ravel()

        whole = np.eye(d)
        for k in range(1 + repeats):
            g = _totals(fit, d * d, gram, d).reshape(d, d)
            if k == 0:
                unit = np.finfo(float).eps / 2
                # the shift of the published method, with the trace as bound of the norm
                shift = 11 * (n * d + d * (d + 1)) * unit * np.trace(g)
                if not np.trace(g) > 0:  # a single vector: nothing varies
                    self.trace, self.values, self.components = 0.0, np.zeros(0), np.zeros((0, d))
                    self.identity_error = 0.0
                    return
            r = factor(g, shift if k == 0 else 0.0)
            whole = r @ whole
            factors.append(r)
        _, values, vectors = np.linalg.svd(whole)
        self.trace = float((values**2).sum())
        kept = int((values[:components] > d * np.finfo(float).eps * values[0]).sum())
        vectors = vectors[:kept]
        # the largest entry of a component is positive
        sign = np.sign(vectors[np.arange(kept), np.abs(vectors).argmax(axis=1)])
        self.values, self.components = values[:kept], vectors * sign[:, None]
        self.identity_error = self._identity_error(fit)

    def whitened(self) -> Callable[[np.ndarray], np.ndarray]:
        centred = _centred(self.n, self.sums, self.most)
        weights = self.components.T / self.values
        return lambda block: centred(block) @ weights

    def _identity_error(self, fit: DataFrame) -> float:
        k, whitened = len(self.values), self.whitened()

        def moments(block: np.ndarray) -> np.ndarray:
            w = whitened(block)
            return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

        total = _totals(fit, k + k * k, moments, self.d) / self.n
        mean, cross = total[:k], total[k:].reshape(k, k)
        return float(np.abs(cross - np.outer(mean, mean) - np.eye(k)).max())

    def deviations(self) -> Callable[[np.ndarray], np.ndarray]:
        """The exact sums of (n x - S)^2 by row, as n (n x'x - 2 x'S) + S'S."""
        n, square = self.n, sum(s * s for s in self.sums)
        small = self.d * self.most * max(max(map(abs, self.sums)), self.most) < LONGEST
        total = np.array(self.sums, np.int64 if small else object)

        def deviations(block: np.ndarray) -> np.ndarray:
            x = block if small else block.astype(object)
            return n * (n * (x * x).sum(axis=1).astype(object) - 2 * (x @ total).astype(object)) + square

        return deviations


def whitened(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows with a null vector, or null or non-finite entries, are left out, as are
    rows whose vector has another length than most (of equal numbers the longer
    length counts). Repeated rows and ids are returned one by one; in the fit equal
    vectors count once. Components without variance (fewer different vectors than
    components, constant dimensions) have no row, so a table with one vector or none
    gives an empty result. A deviation beyond 64 bits is null. Other columns are not
    read.
    """
    rows = stored(whole_vectors(embeddings, id_column, vector_column))
    kind = dict(rows.dtypes)["id"]
    schema = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None or common["d"] < 1:
        return embeddings.sparkSession.createDataFrame([], schema)
    d = common["d"]
    rows = rows.where(F.size("x") == d)
    model = Whitening(stored(rows.select("x").distinct()), d, components)
    k, n, identity_error = len(model.values), model.n, model.identity_error
    explained = model.values**2 / model.trace if k else np.zeros(0)
    of, deviations = model.whitened(), model.deviations()

    def put(batches):
        for batch, block in _blocks(batches, d, 1):
            m = len(block)
            far = [int(v) if v <= LONGEST else None for v in deviations(block)]
            repeated = np.repeat(np.arange(m), k)
            arrays = [
                batch.column(0).take(pa.array(repeated)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                pa.array(far, pa.int64()).take(pa.array(repeated)),
                pa.array(of(block).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(put, schema)
