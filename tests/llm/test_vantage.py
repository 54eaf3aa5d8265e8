import numpy as np
import pytest
from pyspark.sql import functions as F

from gridextremes.llm import vantage

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    some = [(i, (centres[i % 6] + 0.4 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(600)]
    some += [(600 + i, some[3][1]) for i in range(200)]  # one vector held by very many rows
    some += [(900, None), (901, [0.0] * 8), (902, [NAN] + [1.0] * 7), (903, [INF] + [1.0] * 7), (904, [None] + [1.0] * 7), (None, [1.0] * 8),
             (905, [2.0, 1.0]), (920, [1.0, 2.0]), (906, []), (907, [30.0] * 8), (5, some[5][1]), (20, some[20][1])]
    return some


def brute(rows, k, every=20):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, v)
    out = {}
    for q, v in good.items():
        if q % every == 0:
            scored = [(-sum(np.float64(a) * np.float64(b) for a, b in zip(v, w)), i) for i, w in good.items() if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return {q: f for q, f in out.items() if f}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def search(spark, rows, **kw):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    return vantage.nearest(table, F.col("vec_id") % 20 == 0, **kw)


@pytest.mark.parametrize("shard_rows", [100, 10_000])
def test_factor_one_is_exact(spark, rows, shard_rows):
    assert found(search(spark, rows, shard_rows=shard_rows, block=7)) == brute(rows, 20)


def test_few_candidates(spark, rows):
    assert found(search(spark, rows[:13], k=20)) == brute(rows[:13], 20)


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_recall_falls_slowly_with_the_factor(spark, rows):
    """On vectors of one length; with very different lengths, only factor 1 keeps the distances apart."""
    unit = [(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in rows[:600]]
    assert recall(found(search(spark, unit, factor=1.2)), brute(unit, 20)) >= 0.9


def test_relaxed_search_visits_less():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    vectors = centres[rng.integers(0, 20, 4000)] + 0.2 * rng.normal(size=(4000, 16))
    tree = vantage.Tree(np.arange(4000), vectors, 21, leaf=32)
    seen = {}
    scan = tree._scan
    for factor in (1.0, 2.0):
        seen[factor] = 0

        def counted(node, who, *rest, factor=factor):
            seen[factor] += len(who)
            return scan(node, who, *rest)

        tree._scan = counted
        list(tree.search(vectors[:50], np.arange(50), 20, factor))
    assert seen[2.0] < 0.7 * seen[1.0] < 0.7 * 50 * len([n for n in tree.nodes if len(n) == 2])


def test_empty_and_clashing(spark, rows):
    assert search(spark, rows[:0]).count() == 0
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {c: F.lit(1) for c in ("id", "v", "query", "shard", "dim", "kind", "score", "rank")})
    assert found(vantage.nearest(table, F.col("vec_id") % 20 == 0)) == brute(rows, 20)
    with pytest.raises(ValueError):
        vantage.nearest(table, F.lit(True), factor=0.5)
