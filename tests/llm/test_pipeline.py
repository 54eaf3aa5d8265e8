import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from gridextremes.llm import jaccard, mixing  # noqa: E402
from gridextremes.llm import queries as Q  # noqa: E402
from gridextremes.session import materialise  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and gives."""
    docs = Q.table(spark, DATA, "documents")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        result = materialise(stage(spark, docs, DATA), name)
        out.append((docs, result))
        docs = result
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_keep_the_columns(stages):
    for before, after in stages[:-1]:
        assert before.dtypes == after.dtypes


def test_quality_keeps_labelled_good(spark, stages):
    before, after = stages[0]
    labels = Q.table(spark, DATA, "labels")
    good = {r[0] for r in labels.where("quality = 1").select("doc_id").collect()}
    bad = {r[0] for r in labels.where("quality = 0").select("doc_id").collect()}
    left = {r[0] for r in after.select("doc_id").collect()}
    assert good <= left and len(bad & left) <= 0.1 * len(bad)
    assert not rows(after) - rows(before)


def test_exact_duplicates(stages):
    before, after = stages[1]
    best = {}
    for r in before.collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"] or ""), r["doc_id"]))
    assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(i for _, i in best.values())


def test_near_duplicates(stages):
    before, after = stages[2]
    found = [(r["doc_id"], set(jaccard.shingle_set((r["text"] or "").encode()).tolist())) for r in sorted(before.collect())]
    up = {i: i for i, _ in found}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(found):
        for j, b in found[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted({root(i) for i, _ in found})


def test_mixing(stages):
    before, after = stages[3]
    sizes, taken = Counter(), Counter()
    for df, total in ((before, sizes), (after, taken)):
        for r in df.collect():
            total[r["source"]] += len(r["text"].split())
    want = mixing.targets(dict(sizes), mixing.cycled_weights(before), sum(sizes.values()))
    assert not set(taken) - set(sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(20, 0.02 * want[s])
    copies, own = rows(after), rows(before)
    assert all(n <= 3 * own[r] for r, n in copies.items())


def test_packing(stages):
    before, after = stages[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in before.collect())
    got, now = Counter(), []
    for r in sorted(after.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        now = (now if r["start"] else []) + np.frombuffer(r["ids"], "<u4").tolist()
        if len(now) == r["doc_tokens"]:
            got[r["doc_id"], tuple(now)] += 1
    assert got == want


def test_stages_take_nulls_and_repeated_ids(spark):
    docs = Q.table(spark, DATA, "documents")
    odd = spark.createDataFrame(
        [(None, None, "en", "s", None), (None, "", "en", "s", 0), (3, "two words", None, None, 9), (3, "two words", None, None, 9),
         (3, "another text under the same id", "en", "s", 30), (None, "a text that has no id at all", "en", None, 28)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        alone = materialise(stage(spark, odd, DATA), name)
        assert stage(spark, docs.where("false"), DATA).count() == 0
        texts = Counter(r["text"] for r in alone.collect()) if "text" in alone.columns else None
        if name == "exact_duplicates":
            assert sum(texts.values()) == 4 and texts["two words"] == 1
        if name == "near_duplicates":
            assert texts == Counter([None, "", "two words", "another text under the same id", "a text that has no id at all"])
        if name == "mixing":
            assert texts[None] == texts[""] == 1 and 1 <= texts["another text under the same id"] <= 3
        if name == "packing":
            assert alone.count() >= 6


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == stages[-1][1].count()


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_sql_on_other_tables(spark, name):
    """The queries with SQL, on the smallest tables."""
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = con.execute(Q.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    df = Q.QUERIES[name](spark, DATA).select(*columns)
    assert Counter(map(str, map(tuple, df.collect()))) == Counter(map(str, cursor.fetchall()))


def test_no_row_of_a_stage_is_lost_to_clashes(spark):
    docs = Q.table(spark, DATA, "documents").withColumns({"row": F.lit(1), "copies": F.lit(2), "kept": F.lit(False)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, DATA), "stage")
        assert docs.columns[-3:] == ["row", "copies", "kept"] and not docs.isEmpty()
