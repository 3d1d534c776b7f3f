"""Whitening of embeddings by a randomised range finder.

Entries become whole numbers, each distinct vector is fitted once. A random basis of a few more columns than components are wanted goes through
power passes: every pass reads all centred rows, each task sums its rows' part of the covariance times the basis, and Spark adds up the
parts, so only a matrix of the dimensions reaches the driver. Rayleigh-Ritz on the basis gives components and their residuals. If residuals
aren't small beside the gaps between eigenvalues after `powers` passes, the basis is expanded to the full dimension, and one pass more gives all components.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped; shorter vectors count as if zeros followed; repeated vectors are fitted once, and
every row of them, null ids too, is in the result; with fewer dimensions than components there are as many components as dimensions; a component without
variance has a null whitened value, and identity_error is over the others; no rows give an empty result; other columns aren't read. Numbers
too large for an exact deviation in a long raise an error.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import materialise
from .vectors import floored, matrices, matrix, padded, usable

SCALE, COMPONENTS = 256, 4
OVERSAMPLING, POWERS = 12, 8
#: Residuals at most so many times the gap to the next eigenvalue.
TOLERANCE = 1e-12
#: Eigenvalues under so many times the largest count as zero.
NOTHING = 1e-13


class Fit(NamedTuple):
    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    #: One component a column.
    vectors: np.ndarray
    passes: int
    expanded: bool


def _summed(fit: DataFrame, width: int, part, columns: int, kind: str = "double") -> np.ndarray:
    """The sum of part(rows) over all rows' batches, a matrix with so many columns."""
    schema = f"i int, sums array<{kind}>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        total = 0
        for rows in matrices(batches, 0, width):
            total = total + part(rows)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), arrow.field(1).type)], schema=arrow)

    parts = fit.select("x").mapInArrow(run, schema).select("i", F.posexplode("sums").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    out = np.zeros((1 + max((r.i for r in parts), default=-1), columns), dtype=np.int64 if kind == "bigint" else np.float64)
    for r in parts:
        out[r.i, r.j] = r.s
    return out


def _ritz(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (falling), vectors and residuals of a symmetric matrix on a basis, from its product with the basis."""
    small = basis.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(product @ turn - vectors * values, axis=0)


def settled(values: np.ndarray, residuals: np.ndarray, wanted: int, tolerance: float = TOLERANCE) -> bool:
    """Whether the wanted components' residuals are small beside the gaps around their values."""
    gaps = np.abs(np.subtract.outer(values, values)) + np.diag(np.full(len(values), np.inf))
    return bool((residuals[:wanted] <= tolerance * gaps.min(axis=1)[:wanted]).all())


def fit_components(fit: DataFrame, width: int, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, powers: int = POWERS, seed: int = 0) -> Fit:
    """fit: x, each vector once."""
    first = _summed(fit, width, lambda rows: np.vstack([rows.sum(axis=0), np.full(rows.shape[1], len(rows))]), width, "bigint")
    n, sums = int(first[1, 0]), first[0]
    mean = sums / n
    wanted, columns = min(components, width), min(width, components + oversampling)

    def product(basis: np.ndarray) -> np.ndarray:
        def part(rows: np.ndarray) -> np.ndarray:
            centred = rows - mean
            return np.vstack([centred.T @ (centred @ basis), np.pad(((centred**2).sum()).reshape(1, 1), ((0, 0), (0, basis.shape[1] - 1)))])

        return _summed(fit, width, part, basis.shape[1]) / n

    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, columns)))[0]
    for k in range(powers):
        whole = product(basis)
        values, vectors, residuals = _ritz(basis, whole[:-1])
        if columns == width or settled(values, residuals, wanted):
            return Fit(n, sums, float(whole[-1, 0]), values[:wanted], _signed(vectors[:, :wanted]), k + 1, False)
        basis = np.linalg.qr(whole[:-1])[0]
    basis = np.linalg.qr(np.hstack([basis, np.random.default_rng(seed + 1).standard_normal((width, width - columns))]))[0]
    whole = product(basis)
    values, vectors, _ = _ritz(basis, whole[:-1])
    return Fit(n, sums, float(whole[-1, 0]), values[:wanted], _signed(vectors[:, :wanted]), powers + 1, True)


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Of both signs the one by which a component's largest entry is positive."""
    return vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)


def _projector(found: Fit) -> np.ndarray:
    alive = found.values > NOTHING * max(found.values.max(initial=0), 0)
    return found.vectors[:, alive] / np.sqrt(found.values[alive])


def identity_error(fit: DataFrame, width: int, found: Fit) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    mean, turn = found.sums / found.n, _projector(found)
    if not turn.shape[1]:
        return None
    middle = _summed(fit, width, lambda rows: ((rows - mean) @ turn).sum(axis=0)[None], turn.shape[1])[0] / found.n

    def part(rows: np.ndarray) -> np.ndarray:
        white = (rows - mean) @ turn - middle
        return white.T @ white

    return float(np.abs(_summed(fit, width, part, turn.shape[1]) / found.n - np.eye(turn.shape[1])).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, powers: int = POWERS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every row and component."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    rows = materialise(vectors.filter(usable(vector_col)).select(F.col(id_col).alias("id"), floored(vector_col, scale).alias("x")), "vectors")
    rows, width = padded(rows, "x")
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)
    fit = materialise(rows.select("x").distinct(), "fit")
    found = fit_components(fit, width, components, oversampling, powers)
    error, n, sums, mean = identity_error(fit, width, found), found.n, found.sums, found.sums / found.n
    wanted = len(found.values)
    alive = found.values > NOTHING * max(found.values.max(initial=0), 0)
    turn = np.where(alive, found.vectors / np.sqrt(np.where(alive, found.values, 1)), np.nan)
    explained = (found.values / found.trace).tolist() if found.trace > 0 else [math.nan] * wanted

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), width)
            if ((n * x.astype(np.float64) - sums) ** 2).sum(axis=1).max() > 2**62 or n * np.abs(x.astype(np.float64)).max() > 2**62:
                raise OverflowError("deviations don't fit in a long")
            deviation = ((n * x - sums) ** 2).sum(axis=1)
            white = ((x - mean) @ turn).ravel()
            rep = lambda v: np.repeat(v, wanted)
            per = lambda v: np.tile(np.array(v), len(x))
            columns = (
                batch.column(0).take(pa.array(rep(np.arange(len(x))))), per(range(1, wanted + 1)).astype(np.int32), np.full(len(white), n), rep(deviation), pa.array(white, from_pandas=True),
                pa.array(per(explained), from_pandas=True), pa.array([error] * len(white), pa.float64()),
            )
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=arrow)

    return rows.select("id", "x").mapInArrow(project, schema)
