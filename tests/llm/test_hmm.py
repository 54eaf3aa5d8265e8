import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridextremes.llm import hmm

A = "red blue green yellow orange purple black white".split()
B = "uno dos tres cuatro cinco seis siete ocho".split()


def text(i):
    rng = np.random.default_rng(i)
    return " ".join(rng.choice(A if i % 2 else B, 30))


ROWS = [(i, text(i)) for i in range(120)] + [(200, None), (201, ""), (202, "Red RED rED É é"), (203, "unseen words " * 3), (204, "uno " * 3000),
                                             (None, "red blue"), (5, text(5)), (5, text(5))]


def remainder():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def scored(docs, **kw):
    kw = {"own": 12, "buckets": 4, "known": 14, "states": 3} | kw
    return hmm.score_texts(docs, remainder() == 2, **kw).collect()


def toks(t):
    return [*(t or "").encode().lower().split(), b""]


def test_base_score_and_counts(documents):
    out = scored(documents(ROWS))
    assert len(out) == len(ROWS)
    counts = Counter(t for i, x in ROWS if not held(i) for t in toks(x))
    n, v = sum(counts.values()), len(counts)
    by = {}
    for i, x in ROWS:
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in toks(x))
        by.setdefault(i, []).append((held(i), len(toks(x)), sum(counts[t] > 0 for t in toks(x)), n, round(base, 6)))
    got = {}
    for r in out:
        got.setdefault(r["id"], []).append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)))
    assert got == by


def test_model_beats_base_on_held_out_texts(documents):
    out = [r for r in scored(documents(ROWS), rounds=8) if r["held_out"] and r["id"] is not None and r["id"] < 120]
    assert len(out) > 5 and sum(r["score"] for r in out) > sum(r["base_score"] for r in out) * 0.95
    assert all(r["score"] < 0 for r in out)


def test_texts_of_a_length_add_up_to_one(documents):
    """With every token its own symbol, all sequences of two words and an end have a probability of at most one in total."""
    counts = Counter(t for _, x in ROWS[:20] for t in toks(x))
    words = hmm.Vocabulary({t: i for i, t in enumerate(counts)}, np.array([*counts.values(), 0]), np.arange(len(counts)), len(counts), 1,
                           sum(counts.values()), len(counts), np.ones(1))
    model = hmm.first_model(words, 3)
    size = len(model.emit)
    every = [np.array(s) for s in product(range(size), repeat=2)]
    assert (10 ** hmm.Batch(every).forward(model)[0]).sum() == pytest.approx(1)


def brute_forward(model, s):
    a = model.start * model.emit[s[0]]
    for x in s[1:]:
        a = a @ model.move * model.emit[x]
    return math.log10(a.sum())


def brute_expected(model, sequences):
    k = len(model.start)
    start, moves, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, len(model.emit)))
    for s in sequences:
        paths = {p: model.start[p[0]] * model.emit[s[0], p[0]] * np.prod([model.move[p[t - 1], p[t]] * model.emit[s[t], p[t]] for t in range(1, len(s))])
                 for p in product(range(k), repeat=len(s))}
        total = sum(paths.values())
        for p, w in paths.items():
            start[p[0]] += w / total
            for t, x in enumerate(s):
                emit[p[t], x] += w / total
                if t:
                    moves[p[t - 1], p[t]] += w / total
    return start, moves, emit


def test_recursions_against_all_paths():
    rng = np.random.default_rng(3)
    soft = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hmm.Model(soft(rng.random(3), 0), soft(rng.random((3, 3)), 1), soft(rng.random((5, 3)), 0))
    sequences = [rng.integers(0, 5, n) for n in (1, 4, 2, 6, 1, 3)]
    batch = hmm.Batch(sequences)
    assert np.allclose(batch.forward(model)[0], [brute_forward(model, s) for s in sequences])
    for a, b in zip(batch.expected(model), brute_expected(model, sequences)):
        assert np.allclose(a, b)


def test_training_raises_likelihood(spark, documents):
    rows = documents(ROWS).select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"), F.lit(True).alias("train"))
    words = hmm.vocabulary(hmm.token_counts(rows.select("text")), own=12, buckets=4, known=14)
    table = hmm.encoded(rows, words)
    sequences = [np.frombuffer(r["symbols"], "<u2") for r in table.collect()]
    totals = [hmm.Batch(sequences).forward(hmm.trained(table, words, 3, rounds))[0].sum() for rounds in (0, 1, 3, 6)]
    assert totals == sorted(totals)


def test_shared_symbols_keep_the_probability(documents):
    """Splitting tokens over shared symbols must leave a distribution: known shares and one unseen token add up to one."""
    rows = documents(ROWS).select(F.col("text").cast("binary").alias("text"))
    counts = {bytes(r["token"]): r["c"] for r in hmm.token_counts(rows).collect()}
    words = hmm.vocabulary(hmm.token_counts(rows), own=5, buckets=3, known=8)
    for b in range(3):
        inside = [c for t, c in counts.items() if hmm.bucket_of(t, 3) == b and (t not in words.rank or words.rank[t] >= 5)]
        assert sum(c + 1 for c in inside) + 1 == words.shared[b]


def test_empty_clashing_and_nothing_to_learn(documents):
    assert scored(documents([]).where("false")) == []
    clash = documents(ROWS[:10]).withColumns({c: F.lit(1) for c in ("id", "train", "uid", "token", "n", "known", "logs", "symbols", "chain")})
    assert len(scored(clash)) == 10
    none = hmm.score_texts(documents(ROWS[:10]), F.lit(True)).collect()
    assert {r["train_tokens"] for r in none} == {0} and {r["n_known"] for r in none} == {0} and all(math.isfinite(r["score"]) for r in none)
