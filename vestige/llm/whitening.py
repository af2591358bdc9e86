"""Whitened embeddings from an exact integer scatter."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare

#: x = floor(SCALE * c) + SHIFT for an entry c.
SCALE, SHIFT = 64, 1_000_000
#: Components given for each row; most dimensions, which bound what the driver decomposes (2,048 squared doubles are 34 MB).
COMPONENTS, MOST_DIMENSIONS = 32, 2048
#: Bits of a limb: a sum travels as limbs, whose totals over 2^32 partitions still fit a long.
LIMB = 30
_EXACT = 1 << 53


class Fit(NamedTuple):
    """What the fit list gives: n, the exact sums of x - SHIFT, mean, axes (a column each), and by component its eigenvalue and share."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: list[float | None]


def integers(vectors: pa.Array, size: int) -> np.ndarray:
    """floor(64 c) of flattened entries as rows; entries are finite and fit a long."""
    return np.floor(np.asarray(vectors.flatten(), np.float64) * SCALE).astype(np.int64).reshape(-1, size)


def scatter(y: np.ndarray) -> list[list[int]]:
    """The exact cross-products of y's columns.

    Products are summed in doubles as long as no sum can pass 2^53, in blocks of as many rows as that allows; larger entries go through
    Python's integers.
    """
    most = int(np.abs(y).max(initial=0))
    rows = _EXACT // (most * most) if most else len(y)
    total = np.zeros((y.shape[1], y.shape[1]), object)
    if rows:
        for i in range(0, len(y), max(rows, 1)):
            part = y[i : i + rows].astype(np.float64)
            total += (part.T @ part).astype(np.int64).astype(object)
    else:
        big = y.astype(object)
        total += big.T @ big
    return total.tolist()


def limbs(value: int) -> list[int]:
    """value as signed digits of LIMB bits, least first."""
    sign, value, out = (-1, -value, []) if value < 0 else (1, value, [])
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and entries (doubles) of the rows that are fit and whitened, all of one size."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("entries")).where(F.size("entries") > 0)
    finite = ~F.exists("entries", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(2**62 // SCALE)))
    v = v.where(finite)
    top = v.groupBy(F.size("entries").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return v.where(F.size("entries") == (top["size"] if top else 0))


def exact_sums(v: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums of y, cross-products of y) of all rows, exact; y = x - SHIFT.

    Each task sends the limbs of its own totals, size squared over two of them whatever its rows; they are added by key.
    """

    def run(batches):
        n, sums, cross = 0, [0] * size, None
        for b in batches:
            y = integers(b.column("entries"), size)
            n += len(y)
            sums = [a + int(s) for a, s in zip(sums, y.sum(axis=0, dtype=object) if len(y) else sums)]
            part = scatter(y)
            cross = part if cross is None else [[p + q for p, q in zip(r, s)] for r, s in zip(cross, part)]
        if n:
            rows = [(-1, -1, k, x) for k, x in enumerate(limbs(n))] + [(-1, i, k, x) for i, s in enumerate(sums) for k, x in enumerate(limbs(s))]
            rows += [(i, j, k, x) for i in range(size) for j in range(i, size) for k, x in enumerate(limbs(cross[i][j]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["i", "j", "limb", "part"])

    parts = v.select("entries").mapInArrow(run, "i long, j long, limb long, part long").groupBy("i", "j", "limb").agg(F.sum("part").alias("part"))
    got: dict[tuple[int, int], int] = {}
    for i, j, k, x in parts.collect():  # as many rows as pairs of dimensions have limbs
        got[i, j] = got.get((i, j), 0) + (x << (LIMB * k))
    cross = [[got.get((min(i, j), max(i, j)), 0) for j in range(size)] for i in range(size)]
    return got.get((-1, -1), 0), [got.get((-1, i), 0) for i in range(size)], cross


def decomposed(n: int, sums: list[int], cross: list[list[int]], most: int = COMPONENTS) -> Fit:
    """Eigenvectors of the covariance (n times the cross-products less the products of sums, over n squared), which is exact until it is rounded once.

    The shift cancels in it.  A component's eigenvalue is 0 where it is not above what rounding leaves of a zero one.
    """
    size = len(sums)
    v = np.array([[(n * cross[i][j] - sums[i] * sums[j]) / (n * n) for j in range(size)] for i in range(size)], np.float64)
    scale = float(np.abs(v).max()) or 1.0
    values, axes = np.linalg.eigh(v / scale)
    order = np.argsort(-values, kind="stable")[:most]
    values, axes = values[order], axes[:, order]
    values = np.where(values > size * np.finfo(float).eps * max(float(values.max(initial=0)), 0.0), values, 0.0) * scale
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])
    trace = sum(n * cross[i][i] - sums[i] * sums[i] for i in range(size)) / (n * n)
    return Fit(n, sums, axes, values, [float(e / trace) if trace else None for e in values])


def centred(y: np.ndarray, fit: Fit) -> tuple[np.ndarray, list[int | None]]:
    """(x - mean, the sum of (n x - S)^2), the second exact or null beyond a long.  n x - S is n y less the sums of y: the shift cancels."""
    most = int(np.abs(y).max(initial=0)) * fit.n + max(map(abs, fit.sums), default=0)
    if most * most * y.shape[1] < 1 << 63:
        d = y * fit.n - np.array(fit.sums, np.int64)
        return d / fit.n, (d * d).sum(axis=1).tolist()
    d = y.astype(object) * fit.n - np.array(fit.sums, object)
    square = [s if s < 1 << 63 else None for s in (d * d).sum(axis=1).tolist()]
    return (d / fit.n).astype(np.float64), square


def whitened(vectors: DataFrame) -> DataFrame:
    """A row for each usable vector and component up to 32: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold a null, non-finite or (times 64) longer than long entry have no rows; of vectors of several sizes
    the most frequent size has rows (the larger of equals).  Repeated rows and ids, and a null vec_id, each count as rows.  A component
    without variance has null for whitened and 0 explained (null if nothing varies) and doesn't count in identity_error, which is null
    without any other.  deviation is null where it doesn't fit a long.  An empty table has no rows.

    Three passes over the vectors: exact sums, the covariance of the whitened rows (for identity_error), the rows.  The driver holds
    matrices of the dimensions alone; a task adds a batch at a time.
    """
    prepare(vectors.sparkSession)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    v = usable(vectors)
    first = v.first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size = len(first.entries)
    if size > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {size} dimensions; at most {MOST_DIMENSIONS} can be decomposed")
    fit = decomposed(*exact_sums(v, size))
    k = len(fit.values)
    varied = fit.values > 0
    turn = fit.axes[:, varied] / np.sqrt(fit.values[varied])

    def spread(batches):
        m = turn.shape[1]
        total, cross = np.zeros(m), np.zeros((m, m))
        for b in batches:
            w = centred(integers(b.column("entries"), size), fit)[0] @ turn
            total += w.sum(axis=0)
            cross += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([cross.ravel().tolist()], pa.list_(pa.float64()))], names=["total", "cross"])

    error = None
    if varied.any():
        parts = v.select("entries").mapInArrow(spread, "total array<double>, cross array<double>").select(F.posexplode(F.concat("total", "cross")).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
        flat = np.array([x for _, x in sorted(map(tuple, parts.collect()))])
        m = turn.shape[1]
        mean = flat[:m] / fit.n
        error = float(np.abs(flat[m:].reshape(m, m) / fit.n - np.outer(mean, mean) - np.eye(m)).max())

    def rows(batches):
        for b in batches:
            centre, square = centred(integers(b.column("entries"), size), fit)
            w, n = np.full((len(centre), k), np.nan), len(centre)
            w[:, varied] = centre @ turn
            cols = [b.column("vec_id").take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, fit.n, np.int64))]
            cols += [pa.array(square, pa.int64()).take(pa.array(np.repeat(np.arange(n), k))), pa.array(w.ravel(), mask=np.tile(~varied, n)), pa.array(fit.explained * n, pa.float64()), pa.array([error] * (n * k), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return v.mapInArrow(rows, schema)
