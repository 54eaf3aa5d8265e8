from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridextremes.llm import jaccard

rng = np.random.default_rng(9)


def words(n, of=5000):
    return [f"w{i}" for i in rng.integers(0, of, n)]


def edited(base, n):
    out = list(base)
    for i in rng.integers(0, len(out), n):
        out[i] = f"e{rng.integers(0, 10**6)}"
    return out


def near_groups():
    out = []
    for size, members, edits in ((60, 12, 1), (200, 15, 3), (25, 8, 1), (12, 6, 1), (400, 10, 12), (300, 10, 4)):
        base = words(size)
        out += [base] + [edited(base, edits) for _ in range(members)]
        out += [base[: size - k] for k in (1, 2, size // 6)]
    shared = words(50)
    out += [words(30) + shared + words(30) for _ in range(12)]  # a passage that many hold
    template = [words(40) for _ in range(3)]
    out += [sum((template[i] for i in order), []) for order in ((0, 1, 2), (2, 1, 0), (0, 1, 2), (1, 0, 2))]
    return [" ".join(t) for t in out]


def special():
    return [None, "", "  \n ", "One two", "one  TWO", "one two three four", "a b c d e", "A B C D E", "a b c d e f", "É b c d e", "é b c d e", "x" * 50_000,
            " ".join(words(20_000))]


def sets(rows):
    return [(i, frozenset(jaccard.shingle_set(None if t is None else t.encode()).tolist())) for i, t in rows]


def brute(rows):
    own = sets(rows)
    up = list(range(len(own)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = set()
    for (i, (_, a)), (j, (_, b)) in combinations(enumerate(own), 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            links.add((i, j))
            up[root(j)] = root(i)
    least = {}
    for i, (doc, s) in enumerate(own):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, (d, s) in enumerate(own)), key=str), links


@pytest.fixture(scope="module")
def rows():
    texts = near_groups() + special()
    out = [(1000 - i, t) for i, t in enumerate(texts)]
    return out + [(5000 + i, t) for i, t in enumerate(texts[:40])] + [(None, texts[0]), (None, "only null ids here five"), (2, texts[3]), (2, texts[3])]


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("cells,frequent", [(1 << 22, 0.01), (1 << 14, 0.5), (1 << 14, 0.0)])
def test_groups_against_brute_force(documents, rows, cells, frequent):
    want, links = brute(rows)
    assert len(links) > 200
    assert found(jaccard.similar_groups(documents(rows, 5), cells=cells, frequent=frequent)) == want


def test_all_links(documents, rows):
    links, classes = jaccard.similar_pairs(documents(rows, 5))
    ids = {}
    for r in classes.where("id is not null and n > 0").collect():
        ids.setdefault(r["node"], r["id"])
    own = dict(sets(rows))
    want = set()
    for a, b in combinations(sorted(ids), 2):
        x, y = own[ids[a]], own[ids[b]]
        if 100 * len(x & y) >= 80 * len(x | y):
            want.add((a, b))
    assert {(r["a"], r["b"]) for r in links.collect() if {r["a"], r["b"]} <= set(ids)} == want


def test_salted_keys_change_nothing(documents, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "KEY_SHARE", 1_000_000)  # every key with more than four entries
    shared = " ".join(words(30))
    more = rows + [(9000 + i, f"{' '.join(words(4))} {shared}") for i in range(60)] + [(9500 + i, f"{shared} {' '.join(words(40))}") for i in range(60)]
    assert found(jaccard.similar_groups(documents(more, 5), frequent=0.1)) == brute(more)[0]


def odd_rows():
    long = " ".join(f"t{i}" for i in range(40))
    return [(1, long), (None, long), (5, long + " more"), (5, "a quite different text with its own words"), (None, "another text that has no id at all"),
            (7, "one row that comes twice as it is"), (7, "one row that comes twice as it is"), (None, "no id and twice the same words"),
            (None, "no id and twice the same words"), (8, ""), (8, ""), (None, None), (9, long + " other"), (6, "a quite different text with its own words too")]


def test_ids_that_repeat_or_are_missing(documents):
    """Sets that share an id stay apart, and one row of every component stays."""
    assert found(jaccard.similar_groups(documents(odd_rows()))) == brute(odd_rows())[0]
    kept = sorted([(r["doc_id"], r["text"]) for r in jaccard.one_per_group(documents(odd_rows())).collect()], key=str)
    t = dict((i, odd_rows()[i][1]) for i in range(14))
    want = [(1, t[0]), (5, t[3]), (None, t[4]), (7, t[5]), (None, t[7]), (8, ""), (8, ""), (None, None)]
    assert kept == sorted(want, key=str)


def test_one_per_group_against_brute_force(documents, rows):
    up = {}
    for (i, _, part, _), (_, text) in zip(brute_in_order(rows), rows, strict=True):
        up.setdefault(part, []).append((i is None, i or 0, text))
    kept = jaccard.one_per_group(documents(rows, 5)).collect()
    assert len(kept) == len(up)
    least = {part: min(m[:2] for m in members) for part, members in up.items()}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(least.values())
    assert jaccard.one_per_group(documents(rows[:20]).where("false")).count() == 0


def brute_in_order(rows):
    """(id, size, component, place): the component by a place in ``rows``, every empty set alone."""
    _, links = brute(rows)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in links:
        up[root(j)] = root(i)
    return [(d, len(s), root(k), k) for k, (d, s) in enumerate(sets(rows))]


def test_large_group_takes_rounds(documents):
    base = words(300)
    many = [(i, " ".join(edited(base, 5))) for i in range(150)] + [(900 + i, " ".join(words(100))) for i in range(50)]
    assert found(jaccard.similar_groups(documents(many, 4))) == brute(many)[0]


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_similar_sets_share_a_key(percent):
    own = np.random.default_rng(4)
    pool = own.integers(0, 2**63, 400).astype(np.uint64)
    counts = dict(zip(pool.tolist(), own.integers(1, 100, 400).tolist()))
    for _ in range(1500):
        n = int(own.integers(1, 60))
        a = np.unique(own.choice(pool, n))
        b = np.setdiff1d(a, own.choice(a, own.integers(0, max(1, len(a) // 4))))
        b = np.union1d(b, own.choice(pool, own.integers(0, 4)))
        if not np.array_equal(a, b) and len(b) and jaccard.similar(a, b, percent):
            keys = [set(jaccard.index_keys(x, np.array([counts[t] for t in x.tolist()]), 30, percent).tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


def test_keys_grow_in_proportion():
    """Frequent shingles are indexed in combinations without a square of the size."""
    own = np.random.default_rng(4)
    for n in (100, 1000, 20_000):
        hashes = np.unique(own.integers(0, 2**63, n).astype(np.uint64))
        assert len(jaccard.index_keys(hashes, np.full(n, 100), 1000)) <= 0.2 * n + 2
        assert len(jaccard.index_keys(hashes, np.full(n, 100), 10)) <= 2.5 * n


def test_empty_and_clashing(documents, rows):
    assert jaccard.similar_groups(documents([]).where("false")).count() == 0
    small = rows[:30]
    clash = documents(small).withColumns({c: F.lit(1) for c in ("id", "n", "digest", "keys", "node", "part", "key", "a", "b", "text_hash")})
    assert found(jaccard.similar_groups(clash)) == brute(small)[0]
    with pytest.raises(ValueError):
        jaccard.similar_groups(clash, percent=40)


def test_marks_come_to_the_driver_as_bits(spark, monkeypatch):
    """The bitmap and the sums it is made of are a bit per place, not a number."""
    sent, summed = [], jaccard.summed_arrays

    def seen(*given):
        found = summed(*given)
        sent.append(sum(memoryview(part).nbytes for part in found.values()))
        return found

    monkeypatch.setattr(jaccard, "summed_arrays", seen)
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    want = np.zeros(jaccard.MARKS, bool)
    want[[r["h"] & (jaccard.MARKS - 1) for r in hashes.collect()]] = True
    assert (jaccard._marks(hashes, jaccard.MARKS) == np.packbits(want)).all()
    assert sent[0] <= jaccard.MARKS // 8
