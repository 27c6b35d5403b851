"""Whitening of embeddings: leading components of their covariance, found by spectrum slicing, scaled to unit variance."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024.0, 100_000  # fixed values of the integer form of an entry
LARGEST = 2.0**50  # entries from here on have no integer form
SAFE = 1 << 62


# --- eigenvalues ------------------------------------------------------------------------------------------------------


def above(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: by Sylvester's law the positive ones of D in an LDLᵀ factorisation of
    a - shift * I, with diagonal blocks of one or two rows chosen by size."""
    m = a - shift * np.eye(len(a))
    positive = 0
    while len(m):
        size = np.abs(m)
        one = int(size.diagonal().argmax())
        np.fill_diagonal(off := size.copy(), 0)
        two = np.unravel_index(int(off.argmax()), off.shape)
        if size[one, one] >= 0.6404 * off[two]:
            if not size[one, one]:
                return positive  # what is left is zero: eigenvalues at the shift
            positive += int(m[one, one] > 0)
            rest = np.delete(np.arange(len(m)), one)
            column = m[rest, one]
            m = m[np.ix_(rest, rest)] - np.outer(column, column) / m[one, one]
        else:
            positive += 1  # a block whose off-diagonal entry prevails has one eigenvalue of either sign
            rest = np.delete(np.arange(len(m)), two)
            columns = m[np.ix_(rest, two)]
            m = m[np.ix_(rest, rest)] - columns @ np.linalg.solve(m[np.ix_(two, two)], columns.T)
    return positive


class Slices:
    """Counts of eigenvalues above the points looked at so far, kept for all components."""

    def __init__(self, a: np.ndarray):
        self.a = a
        radius = np.abs(a).sum(axis=1) - np.abs(a.diagonal())
        self.norm = float(max(np.abs(a).sum(axis=1).max(), np.finfo(float).tiny))
        margin = 1e-12 * self.norm
        low, high = float((a.diagonal() - radius).min()) - margin, float((a.diagonal() + radius).max()) + margin
        self.counts = {low: len(a), high: 0}

    def count(self, x: float) -> int:
        if x not in self.counts:
            self.counts[x] = above(self.a, x)
        return self.counts[x]

    def around(self, k: int) -> tuple[float, float]:
        """The narrowest known interval with the k-th largest eigenvalue."""
        return max(x for x, n in self.counts.items() if n >= k), min(x for x, n in self.counts.items() if n < k)

    def isolate(self, k: int, narrowest: float) -> tuple[float, float, bool]:
        """An interval whose only eigenvalue is the k-th; not alone if equal ones are with it at the narrowest width."""
        while True:
            low, high = self.around(k)
            alone = self.counts[low] == k and self.counts[high] == k - 1
            if alone or high - low <= narrowest:
                return low, high, alone
            self.count((low + high) / 2)


def _solved(a: np.ndarray, shift: float, v: np.ndarray, norm: float) -> np.ndarray:
    for nudge in (0.0, 1e-15, 1e-13):
        try:
            z = np.linalg.solve(a - (shift + nudge * norm) * np.eye(len(a)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(z).all():
            return z
    raise np.linalg.LinAlgError("no shift can be solved")


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as rows; fewer if the rank is lower.

    Bisection by counts isolates each eigenvalue. Two steps of inverse iteration at the middle give a vector, and
    Rayleigh quotient iteration goes on from it; should the quotient leave the interval, the interval is halved and it
    starts again. Counts just below and above the result certify its number. Equal eigenvalues can't be isolated: their
    vectors are taken orthogonal to those found before.
    """
    slices, values, vectors = Slices(a), [], []
    zero = len(a) * np.finfo(float).eps * slices.norm
    start = np.random.default_rng(0).standard_normal(len(a))
    for number in range(1, min(k, len(a)) + 1):
        if slices.count(4 * zero) < number:
            break
        while True:
            low, high, alone = slices.isolate(number, zero)
            v, shift = start, (low + high) / 2
            for step in range(12):
                z = _solved(a, shift, v, slices.norm)
                for _ in range(2):
                    for u in vectors:
                        z = z - (u @ z) * u
                v = z / np.linalg.norm(z)
                quotient = float(v @ a @ v)
                residual = float(np.linalg.norm(a @ v - quotient * v))
                if step > 0 and residual <= 8 * zero:
                    break
                if step > 0 and alone and low < quotient < high:
                    shift = quotient
            margin = max(16 * zero, residual)
            if slices.count(quotient - margin) >= number > slices.count(quotient + margin):
                break
            if high - low <= zero:
                raise ArithmeticError(f"component {number} can't be certified")
            slices.count((low + high) / 2)
        values.append(quotient)
        vectors.append(v)
    return np.array(values), np.array(vectors).reshape(len(vectors), len(a))


# --- passes over the vectors ------------------------------------------------------------------------------------------


def _usable(embedding: Column) -> Column:
    entry = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LARGEST)  # noqa: E731  (NaN is larger than all)
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, entry)


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * entries).astype(np.int64).reshape(-1, dim) + OFFSET


def _summed(vectors: DataFrame, part, names: list[str]) -> dict[tuple, float]:
    """Sums over all tasks of what ``part`` gives for a batch: an array of numbers per place. Tasks add up their batches
    first; the driver gets one number a place."""
    kind = ", ".join(f"{n} int" for n in names)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(batch)
                total = own if total is None else total + own
        if total is not None:
            places = np.indices(total.shape).reshape(total.ndim, -1)
            arrays = [pa.array(p, pa.int32()) for p in places]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total.ravel())], [*names, "v"])

    number = "bigint" if part.whole else "double"
    rows = vectors.mapInArrow(added, f"{kind}, v {number}").groupBy(*names).agg(F.sum("v").alias("v")).collect()
    return {tuple(r[n] for n in names): r.v for r in rows}


def _part(whole: bool):
    def mark(f):
        f.whole = whole
        return f

    return mark


class Centre:
    """Number and sums of all integer vectors, and the centred form of some of them."""

    def __init__(self, n: int, sums: np.ndarray, largest: int):
        self.n, self.sums = n, sums
        self.exact = n * max(largest, 1) < SAFE // 4
        widest = 2 * n * max(largest, 1)
        self.squares = len(sums) * widest * widest < SAFE

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean. n * x - sums is a whole number, so nothing is lost by taking the difference first."""
        if self.exact:
            return (self.n * x - self.sums) / float(self.n)
        return x - self.sums.astype(np.float64) / float(self.n)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sums of the squares of n * x - sums, exact; NULL beyond 38 digits."""
        narrow = self.exact and int(np.abs(self.n * x - self.sums).max(initial=0)) ** 2 * len(self.sums) < SAFE
        if narrow:
            away = self.n * x - self.sums
            return pa.array((away * away).sum(axis=1)).cast(pa.decimal128(38, 0))
        sums = [int(s) for s in self.sums]
        out = [sum((self.n * int(e) - s) ** 2 for e, s in zip(row, sums, strict=True)) for row in x]
        return pa.array([Decimal(v) if v < 10**38 else None for v in out], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = 8) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    An entry c becomes floor(1024 * c) + 100000; sums of these are exact. Four passes without a shuffle of vectors: sums,
    covariance of the centred vectors, covariance of what comes out, and the output. Between tasks only sums per
    place travel, and the driver gets as many numbers as the covariance has. Components are numbered by falling
    eigenvalue. ``whitened`` is the centred vector's part along the component over the root of the eigenvalue,
    ``explained`` the eigenvalue's share of the trace, ``identity_error`` how far the whitened values' covariance is from
    the identity, ``deviation`` the exact sum of (n * x - sum)^2 over the dimensions, NULL beyond 38 digits.

    Vectors that are NULL or empty, have a NULL or not finite entry or one of 2^50 or more go; so do those whose length isn't
    the most frequent one (of equally frequent ones the largest). Components without variance are left out, so one
    vector alone, or equal ones, give no rows, nor does an empty table. Repeated rows and ids count each. Other columns
    are ignored.
    """
    e = F.col(embedding)
    usable = vectors.where(_usable(e)).select(F.col(vec_id).alias("vec_id"), e.cast("array<double>").alias("x"))
    sizes = usable.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    kind = dict(usable.dtypes)["vec_id"]
    schema = (
        f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double,"
        " identity_error double"
    )
    if most is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, n = most.dim, most.n
    fit = usable.where(F.size("x") == dim)
    only = fit.select("x")

    @_part(whole=True)
    def sums(batch: pa.RecordBatch) -> np.ndarray:
        return _integers(batch.column(0), dim).sum(axis=0)

    found = _summed(only, sums, ["i"])
    entry = only.select(F.array_max(F.transform("x", lambda c: F.abs(c))).alias("m")).agg(F.max("m")).first()[0]
    centre = Centre(n, np.array([found[(i,)] for i in range(dim)], np.int64), int(SCALE * entry) + OFFSET + 1)

    @_part(whole=False)
    def products(batch: pa.RecordBatch) -> np.ndarray:
        y = centre.centred(_integers(batch.column(0), dim))
        return y.T @ y

    found = _summed(only, products, ["i", "j"])
    covariance = np.array([[found[i, j] for j in range(dim)] for i in range(dim)]) / n
    covariance = (covariance + covariance.T) / 2
    values, directions = leading(covariance, components)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    scaled = (directions / np.sqrt(values)[:, None]).T

    # Whitened values are centred up to rounding, so their mean may be taken off after multiplying.
    @_part(whole=False)
    def checks(batch: pa.RecordBatch) -> np.ndarray:
        w = centre.centred(_integers(batch.column(0), dim)) @ scaled
        return np.vstack([w.sum(axis=0), w.T @ w])

    found, k = _summed(only, checks, ["i", "j"]), len(values)
    table = np.array([[found[i, j] for j in range(k)] for i in range(k + 1)]) / n
    error = float(np.abs(table[1:] - np.outer(table[0], table[0]) - np.eye(k)).max())
    share = values / covariance.trace()

    def output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _integers(batch.column(1), dim)
            rows = len(x)
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array(np.full(rows * k, n), pa.int64()),
                    centre.deviation(x).take(each),
                    pa.array((centre.centred(x) @ scaled).ravel()),
                    pa.array(np.tile(share, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return fit.mapInArrow(output, schema)
