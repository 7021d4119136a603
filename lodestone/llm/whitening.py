"""Embedding whitening by LOBPCG: the leading principal components without a decomposition of the whole covariance.

The covariance is never gathered. The driver holds blocks of a few vectors, and one pass over the centred rows gives the
covariance's product with a block: every task adds up its rows, what moves is one block a task. The locally optimal block
preconditioned conjugate gradient method takes the Rayleigh-Ritz vectors of the iterate, the residual and the previous
direction block, until the residuals of all wanted components, taken from a product of its own and not from updated ones,
certify them. Only then rows are whitened.

Entries are whole numbers: sums, the mean and the centring are exact up to one rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches

#: Whole numbers are floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries of this size and more have no exact whole number.
LARGEST = 2.0**44
#: Vectors of the block beside the wanted ones: they speed up the last wanted ones.
GUARDS = 8
#: Residuals, as a part of the largest eigenvalue: certified at the first, an error above the second.
CERTIFIED, FAILED = 1e-13, 1e-9
MOST_ROUNDS = 200


def blocks(vectors: DataFrame, scratch: Scratch, rows: int = 500) -> DataFrame:
    """d, ids, x of all valid vectors, written: up to ``rows`` vectors of one dimension d, x as little-endian 64-bit numbers.

    A vector is left out if it is null or empty, or if an entry is null, not finite or at least ``LARGEST`` in size.
    """
    bounded_batches(vectors)
    schema = pa.schema([("d", pa.int32()), ("ids", pa.list_(pa.int64())), ("x", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            held = part.column(1)
            size = np.diff(held.offsets.to_numpy()) * held.is_valid().to_numpy(zero_copy_only=False)
            flat = held.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            with np.errstate(invalid="ignore"):
                bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < LARGEST))])
            good = (size > 0) & (bad[start + size] == bad[start])
            for d in np.unique(size[good]).tolist():
                own = np.flatnonzero(good & (size == d))
                for a in range(0, len(own), rows):
                    at = own[a : a + rows]
                    x = np.floor(SCALE * flat[start[at][:, None] + np.arange(d)]).astype("<i8") + SHIFT
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part.column(0).take(pa.array(at)).to_pylist()], schema.field(1).type), pa.array([x.tobytes()])], schema=schema)

    return scratch.write(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "d int, ids array<long>, x binary"), "blocks", "zstd")


def summed(held: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all blocks of the array that ``part`` makes of a block's numbers (rows by dimensions), flat.

    A task adds up its blocks and gives one row a place, which are then added up by place.
    """
    def run(parts: Iterator[pa.RecordBatch]):
        total = None
        for got in parts:
            for n, x in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
                more = part(np.frombuffer(x, "<i8").reshape(-1, n)).ravel()
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    rows = held.select("d", "x").mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
    return rows["v"].to_numpy(np.int64 if kind == "long" else np.float64)


class Centre:
    """The exact mean of whole numbers: the nearest whole numbers and what is left, over ``n``."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.near = n, np.rint(sums / n).astype(np.int64)
        self.left = sums - n * self.near

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - self.left / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S) ** 2 for each row; None where it does not fit into 64 bits."""
        off, top = x - self.near, 2**63 - 1
        most = (self.n * float(np.abs(off).max(initial=0)) + float(np.abs(self.left).max(initial=0))) ** 2 * x.shape[1]
        if most < 2**62:
            return ((self.n * off - self.left) ** 2).sum(1).tolist()
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(r, self.left.tolist())) for r in off.tolist()]
        return [v if v <= top else None for v in exact]


def orthonormal(columns: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``columns`` add to the span of ``against`` (orthonormal); what adds nothing goes."""
    norm = np.linalg.norm(columns, axis=0)
    own = columns[:, norm > 0] / norm[norm > 0]
    for _ in range(2):
        own = own - against @ (against.T @ own)
    u, s, _ = np.linalg.svd(own, full_matrices=False)
    u = u[:, s > 1e-8][:, : columns.shape[0] - against.shape[1]]
    if not u.shape[1]:
        return u
    for _ in range(2):
        u = np.linalg.qr(u - against @ (against.T @ u))[0]
    return u


def lobpcg(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric map of dimension ``d``, falling, their unit vectors and certified residual norms.

    ``times`` gives the map's product with a block, one pass over the data. The basis of a round holds the iterate, its
    residuals and the previous directions, each orthonormal against what is before it.
    """
    m = min(d, k + GUARDS)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    ax, p, best, still = times(x), np.zeros((d, 0)), np.inf, 0
    fresh = True
    for _ in range(MOST_ROUNDS):
        values, c = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        values, c = values[::-1], c[:, ::-1]
        x, ax = x @ c, ax @ c
        residual = ax - x * values
        norms = np.linalg.norm(residual[:, :k], axis=0)
        worst = norms.max() / max(values[0], np.finfo(float).tiny)
        if fresh:  # the product is the data's own
            still = 0 if worst < best / 2 else still + 1
            best = min(best, worst)
            if worst <= CERTIFIED or still > 2 and worst <= FAILED:
                return values[:k], x[:, :k], norms
        elif worst <= CERTIFIED:  # certify
            x = np.linalg.qr(x)[0]
            ax, fresh = times(x), True
            continue
        basis = orthonormal(residual, x)
        basis = np.hstack([basis, orthonormal(p, np.hstack([x, basis]))]) if p.shape[1] else basis
        if not basis.shape[1]:  # the iterate spans the space: only rounding is left
            x = np.linalg.qr(x)[0]
            ax, fresh = times(x), True
            continue
        ab = times(basis)
        whole, a_whole = np.hstack([x, basis]), np.hstack([ax, ab])
        gram = whole.T @ a_whole
        _, c = np.linalg.eigh((gram + gram.T) / 2)
        c = c[:, ::-1][:, :m]
        p = basis @ c[m:]  # the direction: what the new iterate has beside the old one
        x, ax, fresh = whole @ c, a_whole @ c, False
    if norms.max() <= FAILED * values[0]:
        return values[:k], x[:, :k], norms
    raise ArithmeticError(f"residuals of {norms.max() / values[0]:.1e} of the largest eigenvalue after {MOST_ROUNDS} rounds")


def whiten(vectors: DataFrame, most_components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, residual: a row for each valid vector and component.

    ``vectors`` has vec_id and embedding; other columns are not read, whatever their names. Valid are vectors without null or
    non-finite entries (nor entries of ``LARGEST`` or more, which have no exact whole number) of the most frequent dimension
    (on a tie the largest); others are left out, as are null vectors. Repeated rows and null ids are returned each. Components
    are numbered from 1 by falling eigenvalue; those of no variance to double precision are left out, so equal vectors, a
    single vector or an empty table give an empty result. ``deviation`` is null where it exceeds 64 bits. ``residual`` is the
    component's certified residual norm over its eigenvalue.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double")
    held = blocks(vectors, Scratch(spark, "whitening"))
    sizes = held.groupBy("d").agg(F.sum(F.size("ids").cast("long")).alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if sizes is None:
        return empty
    d, n = sizes.d, sizes.n
    held = held.where(F.col("d") == d)
    centre = Centre(n, summed(held, lambda x: x.sum(0), "long"))
    variance = summed(held, lambda x: (centre.centred(x) ** 2).sum(0), "double") / n
    if not variance.any():
        return empty

    def times(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ block)

        return summed(held, part, "double").reshape(block.shape) / n

    values, axes, norms = lobpcg(times, d, min(most_components, d))
    real = values > d * np.finfo(float).eps * values[0] * 16
    values, axes, norms = values[real], axes[:, real], norms[real]
    scaled = axes / np.sqrt(values)
    k = len(values)
    mean = summed(held, lambda x: (centre.centred(x) @ scaled).sum(0), "double") / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ scaled - mean
        return w.T @ w

    error = float(np.abs(summed(held, spread, "double").reshape(k, k) / n - np.eye(k)).max())
    explained, residual = values / variance.sum(), norms / values
    names = empty.schema.names

    def run(parts: Iterator[pa.RecordBatch]):
        for got in parts:
            for ids, x in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
                rows = np.frombuffer(x, "<i8").reshape(-1, d)
                many, at = len(rows), np.repeat(np.arange(len(rows)), k)
                own = [pa.array(ids, pa.int64()).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, n)), pa.array(centre.deviations(rows), pa.int64()).take(pa.array(at))]
                yield pa.RecordBatch.from_arrays([*own, pa.array((centre.centred(rows) @ scaled).ravel()), pa.array(np.tile(explained, many)), pa.array(np.full(many * k, error)), pa.array(np.tile(residual, many))], names=names)

    return held.select("ids", "x").mapInArrow(run, empty.schema)
