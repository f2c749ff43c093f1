"""Whitening of embeddings by their own principal components.

Two sums over all vectors give the covariance: the sums of each dimension, then the
scatter of the vectors centred at the whole numbers next to their means. The entries are
whole numbers, so each task adds exact products, and what the rounded centre leaves over
is taken off exactly: the covariance is the true one, correctly rounded, in whatever order
the tasks end. It has dimensions x dimensions numbers however many vectors there are, and
this is all that comes to the driver.

There it is factored by Cholesky's method with pivots, and Jacobi rotations make the
columns of the triangular factor orthogonal. Their squared norms are the eigenvalues, and
the columns over their norms the components. A last pass projects the vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlight.llm.frames import pick
from loomlight.session import stored

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Scaled entries beyond this size count as it; entries of embeddings are near one.
LARGEST = 1 << 40
#: Numbers are split in limbs of so many bits, and so many rows are multiplied at once: sums stay exact below 2 ** 53.
LIMB = 20
ROWS = 2048
SUMS = "dims int, dim int, n bigint, total decimal(38,0)"
PRODUCTS = "i int, j int, total decimal(38,0)"


@dataclass
class Fit:
    """n vectors, their sums, and components as columns with falling eigenvalues; trace is that of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def centre(self) -> list[int]:
        """The whole numbers next to the means."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def left(self) -> list[int]:
        """What n times the centre leaves of the sums."""
        return [s - self.n * m for s, m in zip(self.sums, self.centre)]


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and the whole numbers x of each vector without null, NaN or infinity."""
    rows = pick(embeddings, vec_id="bigint", embedding="array<double>")
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    scaled = F.transform(
        "embedding",
        lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))) + SHIFT,
    )
    return rows.filter(F.col("embedding").isNotNull() & finite).select("vec_id", scaled.cast("array<bigint>").alias("x"))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(lists), dims)


def limbs(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """high and low with z = high * 2 ** LIMB + low, low within half a limb on both sides of zero."""
    high = (z + (1 << (LIMB - 1))) >> LIMB
    return high, z - (high << LIMB)


def decimals(numbers: list[int]) -> pa.Array:
    return pa.array([Decimal(x) for x in numbers], pa.decimal128(38, 0))


def _sums(batches):
    """For each length of vectors in this task: their number and the sum of each dimension."""
    held: dict[int, list] = {}
    for batch in batches:
        lists = batch.column(0)
        lengths = np.diff(lists.offsets.to_numpy())
        for dims in np.unique(lengths).tolist():
            own = matrix(lists.filter(pa.array(lengths == dims)), dims)
            n, total = held.get(dims, (0, [0] * dims))
            held[dims] = (n + len(own), [a + b for a, b in zip(total, own.sum(0).tolist())])
    for dims, (n, total) in held.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([dims] * dims, pa.int32()), pa.array(range(dims), pa.int32()),
                pa.array([n] * dims, pa.int64()), decimals(total),
            ],
            names=["dims", "dim", "n", "total"],
        )


def _products(centre: list[int]):
    """The products of centred dimensions, summed over the vectors of a task."""
    dims = len(centre)

    def run(batches):
        whole = np.zeros((2 * dims, 2 * dims), object)
        now, slices = np.zeros((2 * dims, 2 * dims), np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                high, low = limbs(matrix(batch.column(0).slice(at, ROWS), dims) - np.array(centre, np.int64))
                both = np.hstack([high, low]).astype(float)
                now += (both.T @ both).astype(np.int64)
                slices += 1
                if slices % 1000 == 0:  # each slice adds less than 2 ** 53
                    whole, now = whole + now.astype(object), np.zeros_like(now)
        whole = whole + now.astype(object)
        a, b = whole[:dims], whole[dims:]
        total = a[:, :dims] * (1 << 2 * LIMB) + (a[:, dims:] + b[:, :dims]) * (1 << LIMB) + b[:, dims:]
        i, j = np.triu_indices(dims)
        if slices:
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), decimals(total[i, j].tolist())],
                names=["i", "j", "total"],
            )

    return run


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order): v[order][:, order] = factor factor', lower triangular with falling diagonal.

    It has as many columns as ``v`` has rank, to the precision of doubles.
    """
    dims = len(v)
    rest, order = np.diag(v).copy(), np.arange(dims)
    factor = np.zeros((dims, dims))
    least = dims * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    for k in range(dims):
        best = k + int(np.argmax(rest[order[k:]]))
        if rest[order[best]] <= least:
            return factor[order, :k], order
        order[[k, best]] = order[[best, k]]
        at, below = order[k], order[k + 1 :]
        factor[at, k] = np.sqrt(rest[at])
        factor[below, k] = (v[below, at] - factor[below, :k] @ factor[at, :k]) / factor[at, k]
        rest[below] -= factor[below, k] ** 2
    return factor[order], order


def rotated(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of ``factor`` turned against each other until all are orthogonal.

    A sweep meets each pair of columns once, in rounds of disjoint pairs.
    """
    columns = np.array(factor.T)  # a column is a row here, so that it is together in memory
    n = len(columns)
    ring = list(range(n + n % 2))  # the last place is empty where n is odd
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(a, b) for a, b in zip(ring[:half], ring[:half - 1 : -1]) if max(a, b) < n]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = np.array(pairs, int).reshape(-1, 2).T
            x, y = columns[p], columns[q]
            a, b, g = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            on = np.abs(g) > 4 * np.finfo(float).eps * np.sqrt(a * b)
            if not on.any():
                continue
            turned = True
            p, q, x, y, a, b, g = p[on], q[on], x[on], y[on], a[on], b[on], g[on]
            zeta = (b - a) / (2 * g)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            columns[p], columns[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
        if not turned:
            return columns.T
    raise ArithmeticError(f"columns are not orthogonal after {sweeps} sweeps")


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, components): falling eigenvalues over zero, and unit columns whose largest entry is positive."""
    factor, order = pivoted_cholesky(v)
    if not factor.shape[1]:
        return np.zeros(0), np.zeros((len(v), 0))
    columns = rotated(factor)
    norms = np.sqrt((columns * columns).sum(0))
    falling = np.argsort(-norms, kind="stable")
    unit = np.empty_like(columns)
    unit[order] = columns / norms
    unit = unit[:, falling]
    sign = np.sign(unit[np.abs(unit).argmax(0), np.arange(unit.shape[1])])
    return norms[falling] ** 2, unit * sign


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The components of the vectors ``x`` of ``rows``; None without vectors.

    Vectors of another length than most have are left out; of two such lengths the longer
    one counts.
    """
    parts = rows.select("x").mapInArrow(_sums, SUMS)
    sums = parts.groupBy("dims", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    listed = F.array_sort(F.collect_list(F.struct("dim", "total")))
    by_length = sums.groupBy("dims").agg(F.max("n").alias("n"), listed.alias("s"))
    most = by_length.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not most:
        return None
    n, dims = most[0].n, most[0].dims
    found = Fit(n, [int(x.total) for x in most[0].s], np.zeros((dims, 0)), np.zeros(0), 0.0)
    own = rows.filter(F.size("x") == dims).select("x")
    products = own.mapInArrow(_products(found.centre), PRODUCTS).groupBy("i", "j").agg(F.sum("total").alias("total"))
    left, v = found.left, np.zeros((dims, dims))
    for i, j, total in products.collect():  # dims * (dims + 1) / 2 rows
        v[i, j] = v[j, i] = (n * int(total) - left[i] * left[j]) / (n * n)
    values, unit = eigen(v)
    return Fit(n, found.sums, unit[:, :components], values[:components], float(np.trace(v)))


def _projected(found: Fit):
    """Each vector on the components, and its distance from the mean, n times and squared."""
    n, dims, k = found.n, len(found.sums), len(found.values)
    centre, left = np.array(found.centre, np.int64), np.array(found.left, np.int64)
    onto = found.components / np.sqrt(found.values)
    high_left, low_left = limbs(left)
    rest = sum(x * x for x in found.left)

    def run(batches):
        for batch in batches:
            z = matrix(batch.column(1), dims) - centre
            high, low = limbs(z)
            squares = [(x * y).sum(1).tolist() for x, y in ((high, high), (high, low), (low, low))]
            crossed = [
                x.tolist() for x in (high @ high_left, high @ low_left + low @ high_left, low @ low_left)
            ]
            deviation = [
                n * n * ((a << 2 * LIMB) + (b << LIMB + 1) + c) - 2 * n * ((d << 2 * LIMB) + (e << LIMB) + f) + rest
                for a, b, c, d, e, f in zip(*squares, *crossed)
            ]
            white = (z - left / n) @ onto
            ends = pa.array(np.arange(len(z) + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.ListArray.from_arrays(ends, pa.array(white.ravel(), pa.float64())),
                    pa.array([x if x < 1 << 63 else None for x in deviation], pa.int64()),
                    pa.array(map(str, deviation), pa.string()),
                ],
                names=["vec_id", "whitened", "deviation", "deviation_digits"],
            )

    return run


def whitened(rows: DataFrame, found: Fit) -> DataFrame:
    """vec_id, whitened (one number for each component), deviation and its digits for ``x`` of ``rows``."""
    schema = "vec_id bigint, whitened array<double>, deviation bigint, deviation_digits string"
    own = rows.filter(F.size("x") == len(found.sums))
    return own.select("vec_id", "x").mapInArrow(_projected(found), schema)


def identity_error(white: DataFrame, components: int) -> float | None:
    """The largest entry of the covariance of ``whitened`` minus the identity, by size."""
    entries = [
        F.abs(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) - float(i == j))
        for i in range(components)
        for j in range(i, components)
    ]
    return white.agg(F.array_max(F.array(*entries)).alias("error")).first().error


def report(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits.

    One row for each vector and component. Vectors that are null or hold null, NaN or
    infinity are left out, and so are those of another length than most have. Entries
    beyond a thousand million count as that. A deviation of more than 63 bits is null and
    stands in deviation_digits alone. Directions without spread are no components, so equal
    vectors, a single one, empty vectors and an empty table give no rows; equal eigenvalues
    may change places. Repeated rows count as often as they stand there and each get
    theirs. Extra columns do no harm.
    """
    rows = vectors(embeddings)
    found = fit(rows, components)
    if found is None or not len(found.values):
        return embeddings.sparkSession.createDataFrame(
            [], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
            "identity_error double, deviation_digits string",
        )
    white = stored(whitened(rows, found), "whitened")
    error = identity_error(white, len(found.values))
    shares = F.array(*[F.lit(float(e / found.trace)) for e in found.values])
    return white.select(
        "vec_id", "deviation", "deviation_digits", F.posexplode("whitened").alias("at", "whitened")
    ).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n).cast("bigint").alias("n"), "deviation",
        "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"), "deviation_digits",
    )
