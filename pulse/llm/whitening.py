"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

X holds the vectors, as whole numbers and centred, in its rows, far too many to
be brought together; a vector of its width is small. From a unit vector v_1 the
process alternates u_k = X v_k - b_(k-1) u_(k-1) and v_(k+1) = X'u_k - a_k v_k,
each made orthogonal to all before it and scaled to length one. X then acts on
these vectors as a small bidiagonal matrix with the a on its diagonal and the b
beside it, whose singular value decomposition gives X's own: squares over n are
the variances, the right vectors the components.

A step is one pass over the rows. The long vectors u are never stored: each is
X w for a short w, so a task rebuilds its rows' part of all of them and adds up
its part of X'u, of u'u and of u's products with the earlier ones; removing
those products afterwards is exact arithmetic on the short sums. All short
vectors are kept orthogonal on the driver, twice over. Where the process breaks
down (the start vector has no part in what is left, as with equal variances), it
goes on from a new vector. When the wanted components have converged it starts
once more, for as many steps, to find components of equal variance that the
first start could not see; at most it takes as many steps as X has columns.

Defined results: rows whose vector is null, empty, or holds a null, NaN or
infinite entry are left out; so are rows whose vector has not the most frequent
length (of equally frequent ones, the greatest). Entries whose whole number is
beyond 2^60 count as that. Repeated rows count as often as they stand there, and
null ids are kept. Only components with variance are returned, so fewer than
asked where the vectors span fewer, and none for one vector, equal vectors or an
empty table. ``deviation`` is null where it does not fit a long. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.session import materialize

from .common import batch_of, small_batches

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 60
# Sums of so many tasks go to the driver at once; more are added up in tasks first.
FAN = 64
# Relative residual of a converged component, and size of a broken-down vector.
CONVERGED, BROKEN = 1e-15, 1e-13
OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double,"
       " identity_error double")


def whole_numbers(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, x: floor(1024 c) + 100000 of every entry of the vectors that can be used."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    big = F.lit(LARGEST)
    whole = F.transform(vector, lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE), -big), big) + SHIFT)
    ok = table.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(F.coalesce(fine, F.lit(False)))
    return ok.select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def added_up(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray | list:
    """The sum over all rows of ``part(x)``, which takes the rows of a batch and
    gives numbers of ``kind``. A task sends one row."""
    name, arrow = ("long", pa.int64()) if kind is int else ("double", pa.float64())
    schema = pa.schema([("sums", pa.list_(arrow))])

    def one(batches: Iterator[pa.RecordBatch], of: Callable) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                s = of(b)
                total = s if total is None else total + s
        if total is not None:
            yield batch_of(schema, [[total]])

    sums = rows.select("x").mapInArrow(lambda bs: one(bs, lambda b: part(matrix(b.column(0), width))), f"sums array<{name}>")
    if rows.rdd.getNumPartitions() > FAN:
        sums = sums.repartition(FAN).mapInArrow(
            lambda bs: one(bs, lambda b: np.array(b.column(0).to_pylist()).sum(axis=0)), f"sums array<{name}>")
    got = [r["sums"] for r in sums.collect()]
    return [sum(c) for c in zip(*got)] if kind is int else np.array(got).sum(axis=0)


class Centre:
    """Takes the mean off whole numbers without losing places: an exact whole
    part first, then what is left of it."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([round(Fraction(s, n)) for s in sums], np.int64)
        self.rest = [s - n * int(w) for s, w in zip(sums, self.whole)]
        self.fraction = np.array([float(Fraction(r, n)) for r in self.rest])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the entries of (n x - sum)^2, exactly; null beyond a long."""
        off = x - self.whole
        most = (self.n * (int(np.abs(off).max(initial=0)) + 1)) ** 2 * x.shape[1]
        if most < 2 ** 63:
            return ((self.n * off - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(o) - r) ** 2 for o, r in zip(row, self.rest)) for row in off]
        return [s if s < 2 ** 63 else None for s in exact]


def components(rows: DataFrame, width: int, centre: Centre, wanted: int, seed: int = 0):
    """(variances, components as rows, trace of the covariance), by falling variance."""
    rng = np.random.default_rng(seed)
    trace = float(added_up(rows, width, lambda x: np.array([(centre(x) ** 2).sum()]), float)[0]) / centre.n
    if not trace:
        return np.zeros(0), np.zeros((0, width)), trace
    size = np.sqrt(trace * centre.n)  # no singular value is above it
    v_all, w_all, z_all = (np.zeros((width, 0)) for _ in range(3))
    a, b = [], []

    def orthogonal(z):
        for _ in range(2):
            z = z - v_all @ (v_all.T @ z)
        return z

    def fresh():
        z = orthogonal(rng.normal(size=width))
        return z / np.linalg.norm(z)

    v, beta, run, before = fresh(), 0.0, 0, None
    while True:
        # u = X v - beta u_before = X w; its sums, and X'u, from one pass.
        w = v - beta * w_all[:, -1] if beta else v

        def part(x, w=w, w_all=w_all):
            x = centre(x)
            u = x @ w
            return np.concatenate([x.T @ u, (x @ w_all).T @ u, [u @ u]])

        sums = added_up(rows, width, part, float)
        k = len(a)
        z, c, uu = sums[:width], sums[width:width + k], float(sums[-1])
        alpha = np.sqrt(max(uu - c @ c, 0.0))
        if alpha > BROKEN * size:
            w, z = (w - w_all @ c) / alpha, (z - z_all @ c) / alpha
        else:
            alpha, w, z = 0.0, np.zeros(width), np.zeros(width)
        v_all, w_all, z_all = (np.column_stack(x) for x in ((v_all, v), (w_all, w), (z_all, z)))
        a.append(alpha)
        run += 1
        z = orthogonal(z - alpha * v)
        beta = float(np.linalg.norm(z))
        small = np.diag(a) + np.diag(b, 1)
        left, sigma, right = np.linalg.svd(small)
        done = len(a) == width
        if beta <= BROKEN * size:
            beta = 0.0
        elif k + 1 >= wanted and (beta * np.abs(left[-1, :wanted]) <= CONVERGED * sigma[0]).all():
            # Converged. A further start must see nothing new in as many steps.
            if before is None:
                before, beta, run = (run, sigma[:wanted]), 0.0, 0
            elif run >= before[0]:
                done = done or np.allclose(before[1], sigma[:wanted], rtol=1e-12)
                before, beta, run = (run, sigma[:wanted]), 0.0, 0
        if done:
            break
        b.append(beta)
        v = z / beta if beta else fresh()
    # The vectors v are orthogonal to the last places; so is what they make.
    keep = [i for i in range(min(wanted, len(sigma))) if sigma[i] > 1e-12 * sigma[0]]
    return sigma[keep] ** 2 / centre.n, right[keep] @ v_all.T, trace


def whiten(table: DataFrame, wanted: int = COMPONENTS, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """One row per vector and component: n, deviation, whitened, explained, identity_error."""
    spark = table.sparkSession
    small_batches(spark)
    rows = materialize(whole_numbers(table, vector, vec_id), "whole-vectors")
    most = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if most is None:
        return spark.createDataFrame([], OUT)
    width, n = most
    rows = rows.filter(F.size("x") == width)
    centre = Centre(n, added_up(rows, width, lambda x: x.sum(axis=0), int))
    variances, directions, trace = components(rows, width, centre, wanted)
    if not len(variances):
        return spark.createDataFrame([], OUT)
    project = (directions / np.sqrt(variances)[:, None]).T
    k = len(variances)

    def products(x):
        y = centre(x) @ project
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    sums = added_up(rows, width, products, float) / n
    mean = sums[:k]
    error = float(np.abs(sums[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    explained = variances / trace
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"), width)
            deviation = pa.array(centre.deviations(x), pa.int64())
            each = np.repeat(np.arange(b.num_rows), k)
            yield batch_of(schema, [b.column("vec_id").take(pa.array(each)), np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows),
                                    np.full(len(each), n), deviation.take(pa.array(each)), (centre(x) @ project).ravel(),
                                    np.tile(explained, b.num_rows), np.full(len(each), error)])

    return rows.select("vec_id", "x").mapInArrow(run, OUT)


def report(table: DataFrame) -> DataFrame:
    return whiten(table)
