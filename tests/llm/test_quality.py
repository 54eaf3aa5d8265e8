import math
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridextremes.llm import quality

WORDS = "the quiet river runs past old stone houses while people walk and talk about weather".split()


def text(i, junk):
    rng = np.random.default_rng(i)
    some = rng.choice(WORDS, 40)
    return " ".join(w + ("$$$" if junk else "") for w in some) + "."


@pytest.fixture(scope="module")
def table(documents, spark):
    rows = [(i, text(i, i % 5 == 0), f"s{i % 4}" if i % 5 else "s0") for i in range(400)]
    rows += [(1000, None, "s1"), (1001, "", None), (1002, "z" * 200_000, "s1"), (1003, "!" * 200_000 + "a", "s1"), (3, text(3, False), "s3")]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (6, None, 0), (2, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    return documents(rows), labels


def judged(table, **kw):
    docs, labels = table
    return quality.judge(docs, labels, docs["source"], docs["lang"], **kw)


def test_held_out_documents(table):
    out = judged(table).select("row.doc_id", "posterior", "kept").collect()
    assert len(out) == 405
    for r in out:
        if r["doc_id"] < 400 and r["doc_id"] % 2:
            assert r["kept"] == (r["doc_id"] % 5 != 0)
        assert 0 <= r["posterior"] <= 1


def test_rates_shrink(table):
    docs, labels = table
    rows = judged(table).select("row.source", "evidence", "host_rate", "path_rate").collect()
    p = np.array([1 / (1 + np.exp(-r["evidence"])) for r in rows])
    mean = p.mean()
    for s in ("s0", "s1", "s2", "s3"):
        own = np.array([r["source"] == s for r in rows])
        for r, q in zip([r for r, o in zip(rows, own) if o], p[own]):
            others = (p[own].sum() - q) / (own.sum() - 1)
            assert min(others, mean) - 1e-9 <= r["host_rate"] <= max(others, mean) + 1e-9
    alone = [r for r in rows if r["source"] is None][0]
    assert abs(alone["host_rate"] - mean) < 1e-9 and abs(alone["path_rate"] - mean) < 1e-9


def test_no_labels_or_rows(table, documents):
    docs, labels = table
    same = quality.judge(docs, labels.where("false"), docs["source"], docs["lang"])
    assert {r["evidence"] for r in same.select("evidence").collect()} == {0.0} and same.where("kept").count() == 405
    none = docs.where("false")
    assert quality.judge(none, labels, none["source"], none["lang"]).count() == 0
    clash = docs.withColumns({c: F.lit(1) for c in ("row", "host", "path", "odds", "p", "s", "n", "good", "label_id", "kept", "of_host")})
    assert quality.judge(clash, labels, clash["source"], clash["lang"]).count() == 405


def test_fit_is_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    y = (rng.random(500) < 1 / (1 + np.exp(-(x[:, 0] * 2 - 1)))).astype(float)
    w, mean, scale = quality.fit(x, y)
    z = np.column_stack([(x - mean) / scale, np.ones(500)])
    gradient = z.T @ (y - 1 / (1 + np.exp(-z @ w))) - np.diag([1, 1, 1, 1e-6]) @ w
    assert np.abs(gradient).max() < 1e-6 and w[0] > 1


def test_features(spark):
    rows = spark.createDataFrame([("a b## c, -- --x A1 a a b b b",)], "text string").select(
        *[c.alias(n) for n, c in quality.features(F.col("text")).items()]).first()
    assert rows["marked_words"] * 11 == pytest.approx(2) and rows["symbol_words"] * 11 == pytest.approx(1)
    assert rows["repeated_words"] * 11 == pytest.approx(2)


def test_shares_of_digits_and_letters(spark):
    texts = ["", None, "ab 12", "٣٤ é\U0001d400 x1", "№ ½ -- 007", "q" * 50_000 + "5" * 50_000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select("text", *[c.alias(n) for n, c in quality.features(F.col("text")).items()]).collect()
    for r in got:
        t = r["text"] or ""
        assert r["digits"] == pytest.approx(sum(unicodedata.category(c) == "Nd" for c in t) / max(1, len(t)))
        assert r["letters"] == pytest.approx(sum(unicodedata.category(c)[0] == "L" for c in t) / max(1, len(t)))


def test_pages_of_numbers_are_told_from_prose(documents, spark):
    """Numbers in place of words, of the same lengths: only digits and letters differ."""
    def page(i):
        t = text(i, False)
        return t if i % 2 else "".join(str(ord(c) % 10) if c.isalpha() else c for c in t)

    docs = documents([(i, page(i), "s") for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    out = quality.judge(docs, labels, docs["source"], docs["lang"]).where("row.doc_id >= 200").select("row.doc_id", "kept").collect()
    assert len(out) == 100 and all(r["kept"] == (r["doc_id"] % 2 == 1) for r in out)


def brute(rows):
    """Rates and posteriors in plain code, from the evidence of each row: (host, path, odds, prior)."""
    odds, prior = [r[2] for r in rows], rows[0][3]
    p = [1 / (1 + math.exp(-o)) for o in odds]
    mean = sum(p) / len(p)

    def groups(keys):
        out = {}
        for k, v in zip(keys, p, strict=True):
            s, n = out.get(k, (0.0, 0))
            out[k] = (s + v, n + 1)
        return out

    def strength(found):
        n, inside = len(p), mean * (1 - mean)
        spread = sum(c * (s / c - mean) ** 2 for s, c in found.values())
        between = (spread - (len(found) - 1) * inside) / max(n - sum(c * c for _, c in found.values()) / n, 1e-9)
        return min(1000.0, max(1.0, inside / max(between, 1e-9) - 1)) if len(found) > 1 else 100.0

    hosts, paths = groups([r[0] for r in rows]), groups([r[:2] for r in rows])
    of_hosts, of_paths = strength(hosts), strength(paths)
    base = math.log(prior / (1 - prior))
    out = []
    for (host, path, o, _), own in zip(rows, p, strict=True):
        (hs, hn), (ps, pn) = hosts[host], paths[host, path]
        host_rate = (of_hosts * mean + hs - own) / (of_hosts + hn - 1)
        path_rate = (of_paths * host_rate + ps - own) / (of_paths + pn - 1)
        out.append((host_rate, path_rate, 1 / (1 + math.exp(-(o - base + math.log(path_rate / (1 - path_rate)))))))
    return out


def test_posteriors_against_plain_code(documents, spark):
    rng = np.random.default_rng(6)
    rows = [(i, text(i, rng.random() < (0.9, 0.5, 0.1)[i % 3]), None if i % 11 == 0 else f"host{i % 3}") for i in range(240)]
    rows += [(900, None, "small"), (901, "", "small"), (902, text(902, True), "alone")]
    docs = documents(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("p"), F.col("doc_id") % 5)))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(120)], "doc_id long, quality int")
    got = quality.judge(docs, labels, docs["source"], docs["lang"]).select("row.source", "row.lang", "evidence", "host_rate", "path_rate", "posterior", "kept").collect()
    want = brute([(r["source"], r["lang"], r["evidence"], 0.75) for r in got])
    for r, w in zip(got, want, strict=True):
        assert (r["host_rate"], r["path_rate"], r["posterior"]) == pytest.approx(w, rel=1e-6)
        assert r["kept"] == (r["posterior"] >= 0.5)
