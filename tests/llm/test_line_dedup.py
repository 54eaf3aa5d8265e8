import random

import pytest
from pyspark.sql import functions as F

from gridextremes.llm.line_dedup import without_repeated_lines

WHITE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "A line of some length"
ROWS = [
    (3, f"{LONG}\nown text here\n{LONG}"), (1, "first\nshort\n" + LONG.upper() + " \t"), (2, f"  {LONG}\r\nshort\nshort"),
    (4, None), (5, ""), (6, "\n\n"), (7, "ÄÖÜ is not lowered\nx"), (8, "äöü is not lowered\nx"), (9, "äöü IS not lowered\ny"),
    (None, f"{LONG}\nonly without id"), (None, "only without id"), (10, "within a row\nwithin a row"), (11, "same id line"),
    (11, "same id line\nanother text of it"), (12, "tail line at the end\n"), (13, "tail line at the end\n"), (13, "tail line at the end\n"),
    (14, " kept white space"), (15, "kept white space\n kept white space"), (16, "123456789\n1234567890"), (17, "123456789\n1234567890"),
]


def key(line):
    return line.strip(WHITE).translate(UPPER)


def brute(rows, least=10):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add((i is None, i or 0))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if len(key(s)) < least or min(holders[key(s)]) == (i is None, i or 0)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()], key=str)


@pytest.mark.parametrize(("hot_share", "sample"), [(200, 64), (2, 1), (10_000, 1)])  # none salted, hot ones, all repeated ones
def test_against_brute_force(documents, hot_share, sample):
    assert found(without_repeated_lines(documents(ROWS), hot_share=hot_share, sample=sample)) == brute(ROWS)


def test_random_documents(documents):
    deal = random.Random(5)
    pool = [f"pooled line number {i}" for i in range(40)] + ["tiny", "", " padded pooled line 1 "]
    rows = [(deal.randrange(60), "\n".join(deal.choice(pool) for _ in range(deal.randrange(30)))) for _ in range(120)]
    assert found(without_repeated_lines(documents(rows), hot_share=20, sample=2)) == brute(rows)


def test_one_line_in_every_document_and_a_long_text(documents):
    rows = [(i, f"the line that all have\nline {i} alone here") for i in range(2000)]
    rows.append((5000, "\n".join(f"numbered line {i}" if i % 2 else "The Line That All Have" for i in range(60_000))))
    assert found(without_repeated_lines(documents(rows, 8))) == brute(rows)


def test_bitmaps_tell_the_kept_lines(documents):
    for r in without_repeated_lines(documents(ROWS)).collect():
        lines = (r.row.text or "").split("\n")
        kept = [line for run in r.keep for line in lines[run.start:run.start + run.length]]
        assert "\n".join(kept) == r.kept_text and len(kept) == r.n_lines - r.n_dropped


def test_empty_and_clashing_columns(documents):
    docs = documents(ROWS)
    assert without_repeated_lines(docs.where("false")).count() == 0
    clash = docs.withColumns({c: F.lit(1) for c in ("row", "id", "body", "pos", "high", "low", "salt", "first", "keep", "dropped")})
    assert found(without_repeated_lines(clash)) == brute(ROWS)


def test_one_shuffle_of_the_lines_and_no_python(documents):
    plan = without_repeated_lines(documents(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("rangepartitioning") == 1
