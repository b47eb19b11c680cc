"""Embedding whitening by Chebyshev-filtered subspace iteration (operator 11).

A block of vectors, some more than the components asked for, is multiplied again and again with the covariance of the
rows; each product is one distributed pass over the centred rows that adds up ``X^T (X Q)``, a matrix of the
dimensions by the block. The passes of one turn are a Chebyshev recurrence: on the interval of the unwanted part of the
spectrum the polynomial stays within one, above it it grows fast, so that what the block holds of the unwanted part
fades. The block is then made orthogonal (QR), and a Rayleigh-Ritz step turns it into approximate eigenvectors and gives
the next interval. That is repeated until every wanted pair is certified by its residual; leading pairs that are certified
are projected out of the filter.

The driver holds matrices of the dimensions by the block only. Sums are exact where they are of integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextrail.sources.tables import stage

#: Vectors of the block beyond the components asked for.
GUARDS = 16
#: Passes of one turn, and of the estimate of the spectrum's lower end.
DEGREE, LANCZOS = 8, 12
#: A pair is certified if its residual is at most this share of its eigenvalue, or what rounding leaves of the largest one.
RESIDUAL, ROUNDING = 1e-13, 2e-14
#: One turn lets the largest pair outgrow the last wanted one by this factor at most, lest rounding drowns the latter.
GROWTH = 1e8
#: After so many turns without an end the block grows by half; one of all dimensions ends at once.
STALLED = 12
#: Components whose eigenvalue is at most this share of the trace count as zero and are left out.
ZERO = 1e-12
#: Numbers of a row that an output batch holds at most.
_BATCH_ROWS = 2048


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, dims)


class Rows:
    """Staged integer vectors ``x`` with their number and sums; each method but the constructor is one pass."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
        if sizes["n"] and sizes["low"] != sizes["high"]:
            raise ValueError("vectors differ in length")
        self.n, self.dims = sizes["n"], sizes["high"] or 0
        self.sums = np.zeros(self.dims, np.int64)
        self.sums = self.total(lambda x: x.sum(axis=0), (self.dims,), np.int64, centred=False)

    def total(self, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: type, centred: bool = True) -> np.ndarray:
        """The sum over all rows of what ``part`` makes of a block of rows, an array of ``shape``.

        Each task sends its own sum, cell by cell, and Spark adds the cells up.
        """
        dims, n, sums, cells = self.dims, self.n, self.sums, int(np.prod(shape))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(shape, kind)
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch, dims)
                    found += part((n * x - sums) / n if centred else x)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(found.reshape(-1))], ["cell", "value"])

        name = "long" if kind is np.int64 else "double"
        parts = self.rows.select("x").mapInArrow(add, f"cell int, value {name}")
        table = parts.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(cells, kind)
        out[table["cell"].to_numpy()] = table["value"].to_numpy()
        return out.reshape(shape)

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance of the rows times ``block``: one pass of centred ``X^T (X Q)``, divided by ``n``."""
        return self.total(lambda c: c.T @ (c @ block), block.shape, np.float64) / self.n


def lower_end(times: Callable[[np.ndarray], np.ndarray], dims: int, steps: int, seed: int = 0) -> float:
    """A number that is at most about the smallest eigenvalue, 0 or more: the least Ritz value less its residual.

    ``steps`` of the Lanczos recurrence, made orthogonal anew each time.
    """
    q = np.random.default_rng(seed).standard_normal(dims)
    basis, alphas, betas = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, dims)):
        v = times(basis[-1][:, None])[:, 0]
        alphas.append(float(basis[-1] @ v))
        known = np.array(basis)
        for _ in range(2):
            v = v - known.T @ (known @ v)
        betas.append(float(np.linalg.norm(v)))
        if betas[-1] <= 1e-12 * max(map(abs, alphas)):
            break
        basis.append(v / betas[-1])
    size = len(alphas)
    small = np.diag(alphas) + np.diag(betas[: size - 1], 1) + np.diag(betas[: size - 1], -1)
    values, vectors = np.linalg.eigh(small)
    return max(0.0, float(values[0] - betas[-1] * abs(vectors[-1, 0])))


def chebyshev(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of ``degree`` on ``[low, high]``, of the operator, times ``block``.

    It is scaled step by step by its value at ``top``, so that nothing overflows.
    """
    middle, half = (high + low) / 2, (high - low) / 2
    first = half / (top - middle)
    scale, before = first, block
    now = (times(block) - middle * block) * (first / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        now, before = 2 * (following / half) * (times(now) - middle * now) - scale * following * before, now
        scale = following
    return now


def degree_for(top: float, wanted: float, low: float, high: float) -> int:
    """The degree, ``DEGREE`` at most, by which values of ``top`` grow up to ``GROWTH`` times as much as those of ``wanted``."""
    middle, half = (high + low) / 2, (high - low) / 2
    far, near = (np.arccosh(max(1.0, (x - middle) / half)) for x in (top, wanted))
    return int(np.clip(np.log(GROWTH) / max(far - near, 1e-9), 1, DEGREE))


def eigenpairs(times: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, trace: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns, certified.

    ``times`` multiplies a block with a symmetric positive operator of ``dims`` dimensions. Pairs of (next to) no share
    of the trace are left out.
    """
    wanted = min(wanted, dims)
    random = np.random.default_rng(seed + 1)
    low = lower_end(times, dims, LANCZOS, seed)
    block, _ = np.linalg.qr(random.standard_normal((dims, min(dims, wanted + GUARDS))))
    for turns in count(1):
        product = times(block)
        values, turn = np.linalg.eigh((block.T @ product + product.T @ block) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        residual = np.linalg.norm(product - block * values, axis=0)[:wanted]
        keep = values[:wanted] > ZERO * trace
        certified = (residual <= np.maximum(RESIDUAL * values[:wanted], ROUNDING * values[0])) | ~keep
        if certified.all() or block.shape[1] == dims:
            # Signs are arbitrary; one rule for them makes runs agree.
            vectors = block[:, :wanted][:, keep]
            return values[:wanted][keep], vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        done = int(certified.argmin())
        known, rest = block[:, :done], block[:, done:]
        # The unwanted part ends at the block's least value; where the spectrum is flat the interval stays open.
        high = max(float(values[-1]), low + 1e-9 * float(values[done]))
        top = max(float(values[done]), high * (1 + 1e-9))
        degree = degree_for(top, float(values[wanted - 1]), low, high)
        rest = chebyshev(lambda q, known=known: _without(known, times(q)), rest, low, high, top, degree)
        more = random.standard_normal((dims, min(dims - block.shape[1], block.shape[1] // 2) if turns % STALLED == 0 else 0))
        block, _ = np.linalg.qr(np.hstack([known, _without(known, rest), more]))


def _without(known: np.ndarray, block: np.ndarray) -> np.ndarray:
    return block - known @ (known.T @ block)


def whiten(vectors: DataFrame, components: int, id_col: str = "vec_id", vector_col: str = "x") -> DataFrame:
    """For each row and component ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    ``vectors`` has an id of any kind and an array<long> per row; rows whose array is null take no part, null and repeated
    ids and repeated rows do. All vectors must have one length. ``n`` is the number of rows, ``deviation`` the sum over the
    dimensions of ``(n * x - S) ** 2`` (null if it is no long), ``whitened`` the centred row on the component over the root
    of its eigenvalue, ``explained`` its share of the trace, ``identity_error`` the largest entry of the whitened rows'
    covariance less the identity. Components are numbered from 1 by falling eigenvalue; those without variance are left
    out, so a table of equal rows, of one row or of none gives no rows.
    """
    kept = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].alias("x")).where(F.col("x").isNotNull())
    rows = Rows(stage(kept))
    n, dims, sums = rows.n, rows.dims, rows.sums
    trace = float(rows.total(lambda c: (c * c).sum(axis=0), (dims,), np.float64).sum()) / max(n, 1)
    values, basis = np.zeros(0), np.zeros((dims, 0))
    if trace > 0:
        values, basis = eigenpairs(rows.times, dims, components, trace)
    scaled, found = basis / np.sqrt(values), len(values)
    error = 0.0
    if found:
        covariance = rows.total(lambda c: (c @ scaled).T @ (c @ scaled), (found, found), np.float64) / n
        error = float(np.abs(covariance - np.eye(found)).max())
    explained = values / trace if found else values

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows if found else 0, _BATCH_ROWS):
                batch = whole.slice(start, _BATCH_ROWS)
                moved = n * _matrix(batch, dims) - sums
                near = moved.astype(np.float64)
                fits = (near * near).sum(axis=1) < 2.0**62
                deviation = pa.array((moved * moved).sum(axis=1), pa.int64(), mask=~fits)
                each = pa.array(np.repeat(np.arange(batch.num_rows), found))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(each),
                        pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), batch.num_rows)),
                        pa.array(np.full(len(each), n, np.int64)),
                        deviation.take(each),
                        pa.array((near / n @ scaled).reshape(-1)),
                        pa.array(np.tile(explained, batch.num_rows)),
                        pa.array(np.full(len(each), error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = kept.schema["vec_id"].dataType.simpleString()
    return rows.rows.mapInArrow(
        project,
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double",
    )
