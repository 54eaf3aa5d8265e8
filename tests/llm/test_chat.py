import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridextremes.llm import chat

ROWS = [
    (1, 1, "assistant", "### Assistant: </turn>"), (1, 0, "user", "\\### #### </turn></turn> \\h \\l \\s"), (2, 0, "system", None), (2, 1, None, "x"),
    (3, None, "assistant", "last"), (3, 5, "assistant", ""), (None, 0, "user", "no id"), (4, 0, "assistant", "🙂é\n\n</turn>\n### user:\n"),
    (5, 0, "a:\nb", "odd role"), (8, 0, "human", "roles stay"), (8, 1, "gpt", "as they are"), (8, 2, None, "null"), (6, 0, "user", "t"), (6, 0, "user", "t"), (6, 0, "assistant", "tie"), (7, 0, "assistant", "y" * 100_000),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def found(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_read_back(spark):
    table = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    pieces = chat.format_conversations(table)
    assert found(chat.digests(pieces)) == brute(ROWS)
    lengths = {r[0]: r[1] for r in pieces.groupBy("conv_id").agg(F.sum(F.length("piece"))).collect()}
    assert {r["conv_id"]: r["formatted_chars"] for r in chat.digests(pieces).collect()} == lengths


def test_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(5000)] + [(i, 0, "user", "t") for i in range(2, 500)]
    assert found(chat.digests(chat.format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(6)))) == brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("#a:\n\\", max_size=4), st.text("\\#<>/turn \nslhc:", max_size=20)), max_size=4), st.integers(1, 9))
def test_reader_on_any_parts(turns, size):
    def escape(text):
        import re

        return re.sub("<(?=/turn>)", r"\\l", re.sub("#(?=##)", r"\\h", text.replace("\\", "\\s")))

    whole = "".join(
        chat.HEAD + escape(r).replace(":", "\\c").replace("\n", "\\n") + chat.MIDDLE + escape(t) + chat.TAIL for r, t in turns)
    reader = chat.Reader()
    assert [t for k in range(0, len(whole), size) for t in reader.turns(whole[k : k + size])] == turns


def test_layouts_of_tables(spark):
    messages = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from: string, value: string>>")
    assert [tuple(r) for r in chat.turns_of_table(messages).orderBy("turn").collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    pair = spark.createDataFrame([(1, "do", None, "done"), (2, "do", "it", None)], "conv_id long, instruction string, input string, output string")
    assert [tuple(r) for r in chat.turns_of_table(pair).orderBy("conv_id", "turn").collect()] == [
        (1, 0, "user", "do"), (1, 2, "assistant", "done"), (2, 0, "user", "do"), (2, 1, "user", "it"), (2, 2, "assistant", "")]
    clash = spark.createDataFrame(ROWS, SCHEMA).withColumns({"prompt": F.lit("p"), "piece": F.lit(1), "head": F.lit(1)})
    assert found(chat.digests(chat.format_conversations(clash))) == brute(ROWS)
    with pytest.raises(ValueError):
        chat.turns_of_table(spark.createDataFrame([(1, "x")], "conv_id long, other string"))


def test_json_of_mixed_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"prompt": "p", "response": "r"},
        {"response": "r", "prompt": "p", "system": "s"}, {"instruction": "i", "input": "x", "output": "o"}, {"question": "q", "answer": None},
        {"unknown": 1}, [1, 2], "text", {"conversations": [{"from": "gpt", "value": "v"}]},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(100, "{broken"), (101, None)]
    turns, rest = chat.turns_of_json(spark.createDataFrame(rows, "conv_id long, record string"))
    by = {}
    for r in turns.orderBy("turn").collect():
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert by == {
        0: [("user", "q"), ("assistant", "a")], 1: [("user", "p"), ("assistant", "r")], 2: [("system", "s"), ("user", "p"), ("assistant", "r")],
        3: [("user", "i"), ("user", "x"), ("assistant", "o")], 4: [("user", "q"), ("assistant", "")], 8: [("assistant", "v")]}
    assert sorted(r["conv_id"] for r in rest.collect()) == [5, 6, 7, 100, 101]


def test_fingerprint_ignores_order():
    assert chat.fingerprint(["b", "a[].c"]) == chat.fingerprint(["a[].c", "b"]) != chat.fingerprint(["a.c", "b"])
    assert len({layout.fingerprint() for layout in chat.LAYOUTS}) == len(chat.LAYOUTS)


def test_empty(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
