"""Whitening of embeddings, exact up to the eigendecomposition: digit-slice GEMM.

Entries become integers, x = floor(64 c) + 1 000 000. The model is fitted on each distinct x vector once. One pass gives
the sums S; a second one subtracts the integer m nearest S / n from every entry before anything is multiplied, and cuts
the differences z = x - m into digits of DIGIT bits. Products of two digit matrices are float64 BLAS products that stay
below 2^53, so they are exact; each task recombines them to big integers and adds those up, and Spark adds the tasks'
integers, cut into long words, by cell. With s = S - n m the covariance is (n sum(z z') - s s') / n^2 exactly; only its
quotient is rounded. Its eigenvectors come from `eigh`, refined in extended precision against the exact matrix.

What reaches the driver is d sums and d (d + 1) / 2 cells, whatever the number of rows; a task holds BLOCK rows.

Defined results: rows whose vector is null, empty, or holds null, NaN or infinite entries are left out, as are rows of
another length than the most frequent one (of equally frequent ones the longest); entries beyond +-2^55 count as +-2^55,
which keeps x and z within 64 bits; null and repeated ids stay as they are; repeated vectors count once in the fit and
have a row each in the result; without rows there is nothing to fit and the result is empty; a component without variance
(its eigenvalue within rounding of zero) has null for `whitened`, and doesn't count in the identity error. Other columns,
whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import drop_table, materialize

SCALE, SHIFT, LIMIT = 64.0, 1_000_000, 2.0**61
#: Bits of a digit, and rows multiplied at once: BLOCK * 2^(2 DIGIT) is 2^52.
DIGIT, BLOCK = 18, 1 << 16
#: Bits of the words that big integers are summed in.
WORD = 32


def quantized(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and x, the vector as longs, of the rows with a vector of finite entries."""
    c = F.col(vec_col).cast("array<double>")
    finite = F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).where(finite)
    bounded = lambda v: F.least(F.greatest(v * SCALE, F.lit(-LIMIT)), F.lit(LIMIT))
    return rows.select(F.col(id_col).alias("id"), F.transform(c, lambda v: F.floor(bounded(v)) + F.lit(SHIFT).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield _matrix(batch.column("x").slice(at, BLOCK))


def digits(z: np.ndarray) -> list[np.ndarray]:
    """z as float matrices of signed digits, the lowest first: z is the sum of digit k times 2^(DIGIT k)."""
    out, rest = [], z
    while True:
        low = rest & ((1 << DIGIT) - 1) if np.abs(rest).max(initial=0) >= 1 << DIGIT else rest
        out.append(low.astype(np.float64))
        rest = (rest - low) >> DIGIT
        if not rest.any():
            return out


def exact_gram(z: np.ndarray) -> np.ndarray:
    """z' z of an integer matrix of at most BLOCK rows, as Python integers."""
    parts = digits(z)
    total = np.zeros((z.shape[1], z.shape[1]), dtype=object)
    for p, x in enumerate(parts):
        for q, y in enumerate(parts):
            total += (x.T @ y).astype(np.int64).astype(object) << (DIGIT * (p + q))
    return total


def _words(cells: dict[tuple[int, int], int]) -> pa.RecordBatch:
    """i, j, k, word: each integer is the sum of its words times 2^(WORD k); the last word has the sign."""
    rows = []
    for (i, j), value in cells.items():
        for k in count():
            last = -(1 << WORD) <= value < 1 << WORD
            rows.append((i, j, k, value if last else value & ((1 << WORD) - 1)))
            if last:
                break
            value >>= WORD
    i, j, k, w = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(k, pa.int32()), pa.array(w, pa.int64())], names=["i", "j", "k", "word"])


def _summed(cells: DataFrame) -> dict[tuple[int, int], int]:
    """The integers of all tasks, by cell: a grouped sum, then one integer for each cell on the driver."""
    out: dict[tuple[int, int], int] = {}
    for r in cells.groupBy("i", "j", "k").agg(F.sum(F.col("word").cast("decimal(38,0)")).alias("word")).collect():
        out[r.i, r.j] = out.get((r.i, r.j), 0) + (int(r.word) << (WORD * r.k))
    return out


CELLS = "i int, j int, k int, word long"


def _sums(fit: DataFrame) -> dict[tuple[int, int], int]:
    """The sum of each dimension at (i, 0), and the number of rows at (-1, 0)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for x in _blocks(batches):
            own = x.sum(axis=0, dtype=object) if np.abs(x).max(initial=0) >= 1 << 46 else x.sum(axis=0).astype(object)
            n, total = n + len(x), own if total is None else total + own
        if n:
            yield _words({(-1, 0): n} | {(i, 0): int(v) for i, v in enumerate(total)})

    return _summed(fit.mapInArrow(each, CELLS))


def _products(fit: DataFrame, centre: np.ndarray) -> dict[tuple[int, int], int]:
    """The sum of z_i z_j at (i, j), i <= j, z = x - centre."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches):
            own = exact_gram(x - centre)
            total = own if total is None else total + own
        if total is not None:
            yield _words({(i, j): int(total[i, j]) for i in range(len(total)) for j in range(i, len(total))})

    return _summed(fit.mapInArrow(each, CELLS))


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns; `eigh`, then two steps of refinement in extended precision against v."""
    wide = np.asarray(v, dtype=np.longdouble)
    size = np.abs(wide).max(initial=0) or np.longdouble(1)
    _, q = np.linalg.eigh((wide / size).astype(np.float64))
    q = q.astype(np.longdouble)
    for _ in range(2):
        r, s = np.eye(len(q), dtype=np.longdouble) - q.T @ q, q.T @ (wide / size) @ q
        e = np.diag(s) / (1 - np.diag(r))
        near = 2 * (np.abs(s - np.diag(e)).max(initial=0) + np.abs(r).max(initial=0))
        gap = e[None, :] - e[:, None]
        apart = np.abs(gap) > near
        q = q + q @ np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), r / 2)
    q = q[:, np.argsort(-np.diag(q.T @ wide @ q), kind="stable")]
    for j in range(len(q)):  # close eigenvalues leave their vectors a little askew
        q[:, j] /= np.sqrt(q[:, j] @ q[:, j])
        q[:, j + 1 :] -= np.outer(q[:, j], q[:, j] @ q[:, j + 1 :])
    return (q * (wide @ q)).sum(axis=0).astype(np.float64), q.astype(np.float64)


@dataclass
class Model:
    """What the fit found: n vectors, integer centre m, remainders s = S - n m, the falling eigenvalues and their eigenvectors as columns."""

    n: int
    centre: np.ndarray
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.centre)

    def usable(self, components: int) -> np.ndarray:
        """Which of the first `components` components have variance."""
        return self.values[:components] > self.trace * self.dim * 2.0**-50

    def projector(self, components: int) -> np.ndarray:
        """The first `components` eigenvectors over the square roots of their eigenvalues; NaN for one without variance."""
        scale = np.where(self.usable(components), self.values[:components], np.nan)
        return self.vectors[:, :components] / np.sqrt(scale)

    def offsets(self) -> np.ndarray:
        """S / n - m, at most one half each."""
        return np.array([s / self.n for s in self.rest])


def fit(distinct: DataFrame) -> Model | None:
    """The model of distinct x vectors of one length; None without any. Reads them twice."""
    sums = _sums(distinct)
    n = sums.pop((-1, 0), 0)
    if not n:
        return None
    totals = [sums[i, 0] for i in range(len(sums))]
    centre = [(2 * t + n) // (2 * n) for t in totals]
    rest = [t - n * m for t, m in zip(totals, centre)]
    cells = _products(distinct, np.array(centre, dtype=np.int64))
    d, square = len(totals), n * n
    v = np.empty((d, d), dtype=np.longdouble)
    for (i, j), value in cells.items():
        num = n * value - rest[i] * rest[j]
        high = num / square
        top, bottom = high.as_integer_ratio()
        v[i, j] = v[j, i] = np.longdouble(high) + np.longdouble((num * bottom - top * square) / (square * bottom))
    values, vectors = eigen(v)
    return Model(n, np.array(centre, dtype=np.int64), rest, values, vectors, float(np.trace(v)))


def deviations(z: np.ndarray, n: int, rest: list[int]) -> list[int]:
    """The sum over dimensions of (n z - s)^2 of each row, exact."""
    parts = digits(z)
    squares = np.zeros(len(z), dtype=object)
    for p, x in enumerate(parts):
        for q, y in enumerate(parts):
            squares += (x * y).sum(axis=1).astype(np.int64).astype(object) << (DIGIT * (p + q))
    crossed = np.zeros(len(z), dtype=object)
    low, k = list(rest), 0
    while any(low):
        digit = np.array([abs(s) % (1 << DIGIT) * (1 if s >= 0 else -1) for s in low], dtype=np.float64)
        for p, x in enumerate(parts):
            crossed += (x @ digit).astype(np.int64).astype(object) << (DIGIT * (p + k))
        low, k = [(abs(s) >> DIGIT) * (1 if s >= 0 else -1) for s in low], k + 1
    return list(n * n * squares - 2 * n * crossed + sum(s * s for s in rest))


def transform(rows: DataFrame, model: Model, components: int) -> DataFrame:
    """id, deviation (null beyond 64 bits), deviation_digits (its decimal digits), whitened: array of the first `components` components."""
    kind = dict(rows.dtypes)["id"]
    centre, offsets, projector, n, rest = model.centre, model.offsets(), model.projector(components), model.n, model.rest

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                z = _matrix(part.column("x")) - centre
                white = (z - offsets) @ projector
                exact = deviations(z, n, rest)
                flat = pa.array(white.ravel(), mask=np.isnan(white.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * white.shape[1], pa.int32()), flat)
                fits = [v if v < 1 << 63 else None for v in exact]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fits, pa.int64()), pa.array([str(v) for v in exact]), lists], names=["id", "deviation", "deviation_digits", "whitened"])

    return rows.mapInArrow(each, f"id {kind}, deviation long, deviation_digits string, whitened array<double>")


def identity_error(distinct: DataFrame, model: Model, components: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over components with variance.

    Whitened values are already centred up to rounding; what their means are is taken off the summed products.
    """
    good = np.flatnonzero(model.usable(components))
    centre, offsets, projector = model.centre, model.offsets(), model.projector(components)[:, good]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches):
            w = np.hstack([((x - centre) - offsets) @ projector, np.ones((len(x), 1))])
            total = w.T @ w if total is None else total + w.T @ w
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    if not len(good):
        return 0.0
    total = np.zeros((len(good) + 1, len(good) + 1))
    for r in distinct.mapInArrow(each, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r.i, r.j] = r.s / model.n
    covariance = total[:-1, :-1] - np.outer(total[:-1, -1], total[:-1, -1])
    return float(np.abs(covariance - np.eye(len(good))).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error, deviation_digits: a row for each vector and each of the first `components` components.

    The distinct vectors are written once, as three passes read them, and deleted at the end.
    """
    rows = quantized(vectors, id_col, vec_col)
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (length.d if length else 0))
    distinct = materialize(rows.select("x").distinct(), "fit-list")
    model = fit(distinct)
    if model is None:
        drop_table(distinct)
        return vectors.sparkSession.createDataFrame([], f"vec_id {dict(rows.dtypes)['id']}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string")
    components = min(components, model.dim)
    error = identity_error(distinct, model, components)
    drop_table(distinct)
    share = [float(e) / model.trace if model.trace > 0 else 0.0 for e in model.values[:components]]
    cells = transform(rows, model, components).select("*", F.posexplode("whitened").alias("at", "value"))
    return cells.select(
        F.col("id").alias("vec_id"),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        F.element_at(F.array(*[F.lit(s) for s in share]), F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
        "deviation_digits",
    )
