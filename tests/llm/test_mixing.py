from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridextremes.llm import mixing


def test_targets():
    t = mixing.targets({"a": 10, "b": 100, None: 890}, {"a": 3.0, "b": 1.0, None: 2.0}, 1000)
    assert t["a"] == 30 and t["b"] == 300 and abs(t[None] - 670) < 1e-9
    assert mixing.targets({"a": 0, "b": 5}, {"a": 1, "b": 1}, 5) == {"a": 0.0, "b": 5.0}
    assert mixing.targets({}, {}, 0) == {}


def best_sum(sizes, counts, want):
    sums = {0}
    for s, c in zip(sizes, counts):
        if s:
            sums = {x + k * s for x in sums for k in range(c + 1)}
    return min(abs(x - want) for x in sums)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 4)), max_size=6, unique_by=lambda t: t[0]), st.floats(0, 800))
def test_fit_is_as_near_as_possible(pairs, budget):
    sizes, counts = [s for s, _ in pairs], [c for _, c in pairs]
    got = mixing.fit_budget(sizes, counts, budget)
    assert all(0 <= g <= c for g, c in zip(got, counts))
    assert abs(sum(g * s for g, s in zip(got, sizes)) - round(budget)) == best_sum(sizes, counts, round(budget))


def test_fit_of_a_large_budget():
    sizes, counts = list(range(3, 900)), [7 + s % 5 for s in range(3, 900)]
    total = sum(s * c for s, c in zip(sizes, counts))
    for share in (0.1, 0.5, 0.99):
        got = mixing.fit_budget(sizes, counts, share * total, exact=2000)
        assert sum(g * s for g, s in zip(got, sizes)) == round(share * total)


def test_fit_with_huge_documents():
    assert mixing.fit_budget([10_000_000], [3], 4_000_000) == [0]
    assert mixing.fit_budget([10_000_000], [3], 6_000_000) == [1]
    big, small = mixing.fit_budget([1_000_000, 1], [3, 5], 2_000_004)
    assert abs(big * 1_000_000 + small - 2_000_004) <= 1


def mixture(spark, docs):
    return mixing.mix_sources(docs, mixing.cycled_weights(docs))


def test_mix(spark, documents):
    rows = [(i, "w " * (i % 23 + 1), f"s{i % 4}") for i in range(400)]
    rows += [(1000 + i, "hot words here", "s0") for i in range(500)] + [(2000, None, None), (2001, "", "s1"), (2002, "a b", None), (5, "w " * 6, "s1")]
    docs = documents(rows)
    out = mixture(spark, docs).select("row.doc_id", "row.source", "row.text", "size", "source_size", "target", "copies").collect()
    assert len(out) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["copies"] <= 3
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    want = mixing.targets(dict(sizes), mixing.cycled_weights(docs), sum(sizes.values()))
    assert target == {s: want[s] for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mixture(spark, documents(rows, 7)).select("row.doc_id", "size", "copies").collect()
    assert sorted(map(str, again)) == sorted(str(a) for a in mixture(spark, docs).select("row.doc_id", "size", "copies").collect())


def test_empty_and_clashing(spark, documents):
    assert mixture(spark, documents([]).where("false")).count() == 0
    clash = documents([(1, "a b", "x"), (2, "c", None)]).withColumns(
        {c: F.lit(1) for c in ("row", "size", "hash", "bucket", "sid", "target", "copies", "take", "before", "rank", "named", "n")})
    assert mixture(spark, clash).count() == 2


def test_more_than_100_000_sources(spark):
    n = 100_020
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("two words").alias("text"),
                                 F.when(F.col("id") > 0, F.concat(F.lit("host-"), "id")).alias("source"))
    names = sorted(f"host-{i}" for i in range(1, n))
    want = {s: i % 3 + 1.0 for i, s in enumerate([*names, None])}
    assert mixing.cycled_weights(docs) == want
    some = docs.where("doc_id % 50 = 0")
    out = mixing.mix_sources(some, mixing.weight_table(docs)).select("row.source", "target", "copies").collect()
    target = mixing.targets({r["source"]: 2 for r in out}, want, 2 * len(out))
    assert len(out) == 2001 and {r["source"]: r["target"] for r in out} == target
    assert all(abs(2 * r["copies"] - r["target"]) <= 1 for r in out)


def test_table_of_weights_gives_what_a_dict_gives(spark, documents):
    rows = [(i, "w " * (i % 23 + 1) * (1 + 40 * (i % 7 == 3)), f"s{i % 7}" if i % 11 else None) for i in range(600)] + [(700, None, "none"), (701, "", "")]
    docs = documents(rows)
    weights = {f"s{k}": float(3 ** k) for k in range(7)} | {None: 5.0, "none": 2.0, "": 1.0}
    table = spark.createDataFrame(list(weights.items()), "source string, weight double")
    columns = ["row.doc_id", "size", "source_size", "target", "copies"]
    got, want = (sorted(tuple(r) for r in mixing.mix_sources(docs, w).select(*columns).collect()) for w in (table, weights))
    assert len(got) == len(rows) and got == want
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, table.where("source != 's1'"))
