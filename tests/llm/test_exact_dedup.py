import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gridextremes.llm.exact_dedup import exact_dedup

ROWS = [
    (1, "a b c"), (2, "abc"), (3, "a  b c"), (4, "A b c"), (5, None), (6, ""), (7, " \t\n\x0b\x0c\r"), (8, "a\u00a0b"), (9, "a b"),
    (10, "x" * 200_000), (11, "x " * 200_000), (None, "abc"), (12, "zz"), (12, "zz"), (12, "zz"), (None, "only"), (13, "x" * 40 + "y"),
    (14, "x" * 40 + "z"), (15, "x" * 40 + " z"),
]


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    out = []
    for n, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for k, (_, _, i) in enumerate(members):
            out.append((i, members[0][2], len(members), k == 0, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    rows = df.select("row.doc_id", "keep_id", "group_size", "kept", F.sha2("normalised", 256).alias("h")).collect()
    return sorted([tuple(r) for r in rows], key=str)


@pytest.mark.parametrize("hot_share", [1, 3, 10_000])  # none hot, the large groups hot, every repeated text hot
def test_against_brute_force(documents, hot_share):
    assert found(exact_dedup(documents(ROWS), hot_share=hot_share)) == brute(ROWS)


def test_hot_group(documents):
    rows = [(i, "the same text" + " " * (i % 3)) for i in range(300)] + [(1000 + i, f"text {i}") for i in range(300)]
    assert found(exact_dedup(documents(rows, 8))) == brute(rows)


def test_empty_and_clashing_columns(documents):
    docs = documents(ROWS)
    assert exact_dedup(docs.where("false")).count() == 0
    clash = docs.withColumns({c: F.lit(1) for c in ("row", "hash", "head", "normalised", "keep_id", "kept", "id", "chars")})
    assert found(exact_dedup(clash, hot_share=3)) == brute(ROWS)


def test_no_python(documents):
    df = exact_dedup(documents(ROWS), hot_share=3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
