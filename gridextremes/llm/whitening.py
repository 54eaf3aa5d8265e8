"""Whitening of embeddings with the exact characteristic polynomial of their scatter.

Entries become integers, so the scatter matrix is exact. Its characteristic
polynomial is found modulo many primes (Hessenberg reduction, one prime after the
other in tasks) and put together by Chinese remainders. Roots are isolated on the
integer polynomial by counting sign changes and refined to 200 bits; components come
from inverse iteration in long decimals. Only matrices of the vectors' length,
never rows, pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal, localcontext
from fractions import Fraction
from math import comb, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import packed

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
LARGEST = 2.0**56  # entries from here on have no long x
LIMB = 20  # bits of a factor, so that the sum of CHUNK products is exact in a double
CHUNK = 4096
WORD = 40  # bits of a part of a sum on its way to the driver
PRIME_BITS = 31
ROOT_BITS = 200
CLUSTER_BITS = 100  # roots nearer than this, relative to the first, share their components
DIGITS = 120


def usable(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``row`` and ``x`` (long per entry) of the rows that take part."""
    vector = F.col(f"row.`{vector_col}`")
    fine = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("long"))
    return rows.select(packed(rows)).where(vector.isNotNull() & fine).withColumn("x", x)


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The ``x`` of a batch without the offset, which no covariance sees."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - OFFSET


def exact_products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` in Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    if not len(y):
        return total
    largest = max(int(y.max()), -int(y.min()))
    n_limbs = max(1, -(-(largest.bit_length() + 1) // LIMB))
    for at in range(0, len(y), CHUNK):
        rest, limbs = y[at:at + CHUNK], []
        for _ in range(n_limbs - 1):
            limbs.append((rest & ((1 << LIMB) - 1)).astype(float))
            rest = rest >> LIMB
        limbs.append(rest.astype(float))
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def scatter(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of vectors, sums, and ``n`` times the products less the products of sums, all exact.

    Tasks add up their vectors; their sums, cut in parts that fit a long, are added
    by Spark. ``width * (width + 3) / 2`` rows go to the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            y = matrix(batch, width)
            n += len(y)
            sums += exact_products(np.column_stack([y, np.ones(len(y), np.int64)]))[-1, :-1]
            products += exact_products(y)
        cells = [(-1, 0, n)] + [(-1, i + 1, v) for i, v in enumerate(sums)]
        cells += [(i, j, products[i, j]) for i in range(width) for j in range(i, width)]
        mask = (1 << WORD) - 1
        parts = [[int(v) >> (k * WORD) & mask for _, _, v in cells] for k in range(3)] + [[int(v) >> (3 * WORD) for _, _, v in cells]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c[k] for c in cells], pa.int32()) for k in range(2)] + [pa.array(p, pa.int64()) for p in parts],
            ["i", "j", "p0", "p1", "p2", "p3"])

    found = fit.mapInArrow(add, "i int, j int, p0 long, p1 long, p2 long, p3 long").groupBy("i", "j").agg(
        *[F.sum(f"p{k}").alias(f"p{k}") for k in range(4)]).collect()
    cell = {(r["i"], r["j"]): sum(r[f"p{k}"] << (k * WORD) for k in range(4)) for r in found}
    n = cell[-1, 0]
    sums = [cell[-1, i + 1] for i in range(width)]
    return n, sums, [[n * cell[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(width)] for i in range(width)]


def _is_prime(p: int) -> bool:
    """Miller-Rabin with bases that decide all numbers below 2**31."""
    twos = (p - 1 & 1 - p).bit_length() - 1
    for base in (2, 3, 5, 7):
        power = pow(base, (p - 1) >> twos, p)
        if power in (1, p - 1):
            continue
        for _ in range(twos - 1):
            power = power * power % p
            if power == p - 1:
                break
        else:
            return False
    return True


def primes_for(m: list[list[int]]) -> list[int]:
    """Primes whose product exceeds twice every coefficient of the polynomial of the positive semidefinite ``m``."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    # Of given trace the k-th symmetric function of the roots is largest when all are equal.
    bound = 2 * max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    out, product, p = [], 1, (1 << PRIME_BITS) - 1
    while product <= bound:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of the characteristic polynomial of ``m`` modulo ``p``."""
    h, d = m.copy(), len(m)
    for j in range(d - 2):
        below = np.flatnonzero(h[j + 1:, j])
        if not len(below):
            continue
        pivot = j + 1 + int(below[0])
        h[[j + 1, pivot]] = h[[pivot, j + 1]]
        h[:, [j + 1, pivot]] = h[:, [pivot, j + 1]]
        times = h[j + 2:, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2:] = (h[j + 2:] - times[:, None] * h[j + 1]) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2:] * times % p).sum(axis=1)) % p
    # Polynomials of the leading blocks, each from the smaller ones.
    leading = np.zeros((d + 1, d + 1), np.int64)
    leading[0, 0] = 1
    for k in range(1, d + 1):
        own = np.roll(leading[k - 1], 1) - h[k - 1, k - 1] * leading[k - 1] % p
        along = 1
        for i in range(k - 1, 0, -1):
            along = along * int(h[i, i - 1]) % p
            if not along:
                break
            own -= along * int(h[i - 1, k - 1]) % p * leading[i - 1] % p
        leading[k] = own % p
    return leading[d]


def characteristic_polynomial(fit: DataFrame, m: list[list[int]]) -> list[int]:
    """Exact coefficients, constant first; every prime is a row of a Spark job."""
    width, primes = len(m), primes_for(m)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                own = polynomial_mod(np.array([[v % p for v in line] for line in m], np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([own.tolist()], pa.list_(pa.int64()))], ["p", "c"])

    rows = _dealt(fit, [(p,) for p in primes], "p long").mapInArrow(reduce, "p long, c array<long>").collect()
    whole = prod(primes)
    out = [0] * (width + 1)
    for r in rows:
        rest = whole // r["p"]
        weight = rest * pow(rest, -1, r["p"])
        out = [(o + weight * c) % whole for o, c in zip(out, r["c"], strict=True)]
    return [o - whole if 2 * o > whole else o for o in out]


def _dealt(fit: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A small table dealt over tasks."""
    spark = fit.sparkSession
    return spark.createDataFrame(rows, schema).repartition(min(len(rows), spark.sparkContext.defaultParallelism))


def roots_above(c: list[int], a: int) -> int:
    """Number of roots above ``a`` of a polynomial all of whose roots are real: sign changes after moving it by ``a``."""
    c = list(c)
    for k in range(len(c) - 1):
        for i in range(len(c) - 2, k - 1, -1):
            c[i] += a * c[i + 1]
    signs = [v > 0 for v in c if v]
    return sum(s != t for s, t in zip(signs, signs[1:], strict=False))


def value_at(c: list[int], a: int) -> int:
    out = 0
    for v in reversed(c):
        out = out * a + v
    return out


def isolated_root(c: list[int], i: int, bits: int = ROOT_BITS) -> Fraction:
    """The i-th largest root, all of which are real and not negative and it positive, to ``bits`` bits.

    Halves an interval by exact counts until the root is alone in it, from there
    on by the sign of the polynomial. The scale grows when whole numbers do not do.
    """
    lo, hi, scale = 0, -c[-2], 0  # the sum of the roots bounds each
    above_lo, above_hi = roots_above(c, lo), 0
    while True:
        while hi - lo > 1 and (hi - lo) << bits > lo:
            mid = (lo + hi) // 2
            if above_lo - above_hi == 1:
                value = value_at(c, mid)
                above = i if value and (value > 0) != (i % 2 == 1) else i - 1
            else:
                above = roots_above(c, mid)
            if above >= i:
                lo, above_lo = mid, above
            else:
                hi, above_hi = mid, above
        if (hi - lo) << bits <= lo:
            return Fraction(lo + hi, 2 << scale)
        c = [v << (64 * (len(c) - 1 - k)) for k, v in enumerate(c)]
        lo, hi, scale = lo << 64, hi << 64, scale + 64


def _decimal(f: Fraction) -> Decimal:
    return Decimal(f.numerator) / Decimal(f.denominator)


def null_vectors(m: list[list[int]], root: Fraction, count: int) -> list[list[Decimal]]:
    """``count`` orthonormal vectors of the null space of ``m`` less ``root``, by inverse iteration."""
    d, shift = len(m), _decimal(root)
    lu = [[Decimal(v) - (shift if i == j else 0) for j, v in enumerate(line)] for i, line in enumerate(m)]
    tiny = max(abs(v) for line in lu for v in line) * Decimal(10) ** (10 - DIGITS)
    order = list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda r: abs(lu[r][k]))
        lu[k], lu[pivot], order[k], order[pivot] = lu[pivot], lu[k], order[pivot], order[k]
        if abs(lu[k][k]) < tiny:
            lu[k][k] = tiny
        top = lu[k]
        for r in range(k + 1, d):
            line = lu[r]
            times = line[k] / top[k]
            lu[r] = line[:k] + [times] + [v - times * t for v, t in zip(line[k + 1:], top[k + 1:], strict=True)]

    def solved(b: list[Decimal]) -> list[Decimal]:
        x = [b[k] for k in order]
        for r in range(d):
            x[r] -= sum(lu[r][k] * x[k] for k in range(r))
        for r in reversed(range(d)):
            x[r] = (x[r] - sum(lu[r][k] * x[k] for k in range(r + 1, d))) / lu[r][r]
        return x

    def orthonormal(vectors: list[list[Decimal]]) -> list[list[Decimal]]:
        out: list[list[Decimal]] = []
        for v in vectors:
            for _ in range(2):
                for u in out:
                    along = sum(a * b for a, b in zip(u, v, strict=True))
                    v = [a - along * b for a, b in zip(v, u, strict=True)]
                length = sum(a * a for a in v).sqrt()
                v = [a / length for a in v]
            out.append(v)
        return out

    # Starts without any pattern of the data; every round shrinks what is foreign by 2**-CLUSTER_BITS.
    starts = [[Decimal(pow(3, 1 + i + d * k, 1_000_003) % 2_001 - 1_000) for i in range(d)] for k in range(count)]
    vectors = orthonormal(starts)
    for _ in range(3):
        vectors = orthonormal([solved(v) for v in vectors])
    return vectors


def components(fit: DataFrame, m: list[list[int]], most: int = COMPONENTS) -> tuple[list[Fraction], list[list[float]]]:
    """Roots of ``m`` by falling value, at most ``most`` and all positive, and per root its vector over the root's square root.

    Roots and vectors are found in tasks, one row per root, one per cluster of roots.
    """
    poly = characteristic_polynomial(fit, m)
    rank = len(m) - next((k for k, v in enumerate(poly) if v), len(m))
    wanted = min(most, rank)
    if not wanted:
        return [], []

    def isolate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                f = isolated_root(poly, i)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([f"{f.numerator}/{f.denominator}"])], ["i", "f"])

    rows = _dealt(fit, [(i + 1,) for i in range(wanted)], "i long").mapInArrow(isolate, "i long, f string").collect()
    values = [Fraction(r["f"]) for r in sorted(rows)]
    clusters: list[list[int]] = []
    for i, value in enumerate(values):
        if i and (values[i - 1] - value) * 2**CLUSTER_BITS <= values[0]:
            clusters[-1].append(i)
        else:
            clusters.append([i])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with localcontext() as context:
                    context.prec = DIGITS
                    for k, v in enumerate(null_vectors(m, values[first], count)):
                        length = _decimal(values[first + k]).sqrt()
                        over = [float(a / length) for a in v]
                        yield pa.RecordBatch.from_arrays([pa.array([first + k]), pa.array([over])], ["i", "v"])

    found = _dealt(fit, [(g[0], len(g)) for g in clusters], "first long, count long").mapInArrow(
        vectors, "i long, v array<double>").collect()
    return values, [r["v"] for r in sorted(found)]


def centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * y - sums`` per row, exact: longs where they fit, else Python integers."""
    largest = max(int(y.max()), -int(y.min()), 0) if y.size else 0
    if n * largest + max(map(abs, sums)) < 1 << 62:
        return n * y - np.array(sums, np.int64)
    return n * y.astype(object) - np.array(sums, object)


def squares(z: np.ndarray) -> pa.Array:
    """Sum of squares per row as decimals; null where 38 digits do not hold it."""
    largest = max(int(z.max()), -int(z.min()), 0) if z.size else 0
    if z.dtype == object or z.shape[1] * largest**2 >= 1 << 63:
        sums = [sum(int(v) ** 2 for v in line) for line in z]
        with localcontext() as context:
            context.prec = 40
            return pa.array([Decimal(s) if s < 10**38 else None for s in sums], pa.decimal128(38, 0))
    return pa.array((z * z).sum(axis=1)).cast(pa.decimal128(38, 0))


def identity_error(fit: DataFrame, project: Callable[[pa.RecordBatch], np.ndarray], n: int, size: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity, centred first."""

    def sums(value: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                total = total + value(project(batch))
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["at", "v"])

        rows = fit.mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(rows)])

    mean = sums(lambda w: w.sum(axis=0)) / n
    products = sums(lambda w: (w - mean).T @ (w - mean)).reshape(size, size) / n
    return float(np.abs(products - np.eye(size)).max())


def whiten(rows: DataFrame, vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """``row`` (all columns of ``rows``), ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    An entry c becomes the integer x = floor(64 c) + 1 000 000. Mean and covariance
    are those of the distinct x vectors, n of them, divisor n. One row per row of
    ``rows`` and component, numbered from 1 by falling share of the variance
    (``explained``); ``deviation`` is the exact sum over dimensions of (n x - S)^2
    as a decimal, null beyond 38 digits; ``whitened`` has variance 1 per component.

    Rows take no part (and give no row) when their vector is null, holds a null or
    non-finite entry or one of 2^56 or more, whose x is no long, or has another
    length than most usable vectors (of equally frequent lengths the smallest
    counts). Repeated rows each give rows; the fit list has their vector once. A
    component needs variance: with fewer than ``most`` of them only those that
    exist are returned, so a table with one distinct vector, like an empty one,
    gives no row. Components of equal variance are one orthonormal choice, the same
    for all rows. Ids may be null and extra columns of any name stay inside ``row``.
    """
    given = usable(rows, vector_col)
    lengths = given.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").head(1)
    width = lengths[0]["width"] if lengths else 0
    given = given.where(F.size("x") == width)
    fit = materialise(given.select("x").distinct(), "fit")
    n, sums, m = scatter(fit, width) if width else (0, [], [])
    values, over = components(fit, m, most) if width else ([], [])
    onto = np.array(over).T

    def project(batch: pa.RecordBatch) -> np.ndarray:
        return centred(matrix(batch, width), n, sums).astype(float) @ onto

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = centred(matrix(batch, width), n, sums)
            whitened = pa.array((z.astype(float) @ onto).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), squares(z), whitened], ["row", "deviation", "w"])

    trace = sum(m[i][i] for i in range(width))
    error = identity_error(fit, project, n, len(values)) if values else 0.0
    explained: Column = F.array(*[F.lit(float(v / trace)) for v in values]).cast("array<double>")
    schema = T.StructType([given.schema["row"], T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("w", T.ArrayType(T.DoubleType()))])
    judged = (given if values else given.where("false")).mapInArrow(judge, schema)
    return judged.select("row", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "row", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
