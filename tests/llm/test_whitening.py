import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridextremes.llm.whitening import characteristic_polynomial, isolated_root, roots_above, scatter, usable, whiten

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


def integers(rows, kind=np.float32):
    """(id, x) of the usable rows, plainly."""
    out = []
    for i, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            out.append((i, [math.floor(64 * float(kind(c))) + 1_000_000 for c in v]))
    return out


def check(df, rows, most=16):
    """Against numpy, column by column; components up to their sign."""
    xs = integers(rows)
    fit = sorted({tuple(x) for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    dense = np.array(fit, float) - 1_000_000
    dense -= dense.mean(axis=0)
    values, axes = np.linalg.eigh(dense.T @ dense / n)
    values, axes = values[::-1], axes[:, ::-1]
    rank = np.linalg.matrix_rank(dense)
    got = df.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()
    count = min(most, rank)
    assert len(got) == len(xs) * count
    assert {r.component for r in got} == set(range(1, count + 1))
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    plain = {}
    for i, x in xs:
        plain.setdefault(i, []).append(x)
    for k in range(count):
        expected, found = [], []
        for i, members in plain.items():
            mine = sorted(by[k + 1][i], key=lambda r: (r.deviation, r.whitened))
            theirs = sorted((sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), x) for x in members)
            assert [r.deviation for r in mine] == [t[0] for t in theirs]
            if len(members) == 1:
                found.append(mine[0].whitened)
                expected.append((np.array(members[0]) - np.array(sums) / n) @ axes[:, k] / math.sqrt(values[k]))
            assert abs(mine[0].explained - values[k] / values.sum()) < 1e-9 * mine[0].explained + 1e-12
        sign = np.sign(np.dot(found, expected))
        assert np.allclose(np.array(found) * sign, expected, atol=1e-6)


def random_rows(seed, n, d, bad=True):
    deal = np.random.default_rng(seed)
    mix = deal.normal(size=(d, d)) * np.linspace(1, 0.05, d)
    rows = [(i, [float(c) for c in deal.normal(size=d) @ mix]) for i in range(n)]
    if bad:
        rows += [(n, None), (n + 1, [None] * d), (n + 2, [NAN] + [0.0] * (d - 1)), (n + 3, [INF] * d), (n + 4, [-INF] + [0.0] * (d - 1))]
        rows += [(n + 5, rows[0][1]), (n + 6, rows[0][1]), (7, rows[8][1]), (None, rows[3][1])]
    return rows


@pytest.mark.parametrize(("n", "d"), [(200, 6), (120, 24), (10, 20)])  # the last has fewer vectors than dimensions
def test_against_numpy(spark, n, d):
    rows = random_rows(n, n, d)
    check(whiten(vectors(spark, rows)), rows)


def test_polynomial_is_exact(spark):
    rows = random_rows(3, 40, 9, bad=False)
    fit = usable(vectors(spark, rows)).select("x").distinct()
    n, sums, m = scatter(fit, 9)
    # The same by Faddeev and LeVerrier, in whole numbers.
    exact, work, plain = np.array(m, object), np.zeros((9, 9), object), [1]
    for k in range(1, 10):
        work = exact.dot(work) + plain[-1] * np.eye(9, dtype=int).astype(object)
        trace = int(np.trace(exact.dot(work)))
        assert trace % k == 0
        plain.append(-trace // k)
    poly = characteristic_polynomial(fit, m)
    assert poly == plain[::-1]
    xs = sorted({tuple(x) for _, x in integers(rows)})
    assert n == len(xs) and sums == [sum(c) - 1_000_000 * n for c in zip(*xs, strict=True)]
    roots = np.linalg.eigvalsh(np.array(m, float))[::-1]
    for i in range(9):
        assert abs(float(isolated_root(poly, i + 1)) / roots[i] - 1) < 1e-9


def test_roots_are_counted_with_multiplicity():
    poly = [1]
    for r in (7, 7, 3, 0):  # (x - 7)^2 (x - 3) x
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0], strict=True)]
    assert [roots_above(poly, a) for a in (0, 2, 3, 6, 7)] == [3, 3, 2, 2, 0]
    assert [round(float(isolated_root(poly, i)), 12) for i in (1, 2, 3)] == [7, 7, 3]


def test_equal_variances(spark):
    d = 4
    rows = [(2 * i + s, [float(3 * (1 - 2 * s)) if j == i else 0.0 for j in range(d)]) for i in range(d) for s in (0, 1)]
    got = whiten(vectors(spark, rows)).collect()
    w = np.zeros((2 * d, d))
    for r in got:
        w[r.row.vec_id, r.component - 1] = r.whitened
        assert abs(r.explained - 1 / d) < 1e-12 and r.identity_error < 1e-12
    assert np.allclose(w.T @ w / len(rows), np.eye(d), atol=1e-12)


def test_large_entries_and_doubles(spark):
    deal = random.Random(4)
    rows = [(i, [deal.uniform(-1, 1) * 2.0**e for e in (50, 20, 0)]) for i in range(50)] + [(50, [2.0**60, 0.0, 0.0])]
    got = whiten(vectors(spark, rows, "double")).collect()
    xs = integers(rows[:50], float)
    n, sums = len(xs), [sum(c) for c in zip(*(x for _, x in xs), strict=True)]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in xs}
    assert len(got) == 150 and got[0].identity_error < 1e-9
    assert all(r.deviation == (deviation[r.row.vec_id] if deviation[r.row.vec_id] < 10**38 else None) for r in got)


def test_odd_tables(spark):
    rows = random_rows(9, 30, 5)
    df = vectors(spark, rows)
    assert whiten(df.where("false")).count() == 0
    assert whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    assert whiten(vectors(spark, [(1, []), (2, [])])).count() == 0
    mixed = vectors(spark, [*rows, (90, [1.0]), (91, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])])
    clash = mixed.withColumns({c: F.lit(1) for c in ("row", "x", "w", "at", "n", "component", "deviation", "whitened")})
    check(whiten(clash), rows)
