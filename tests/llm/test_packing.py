import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridextremes.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(1, "A first text."), (2, None), (3, ""), (4, "word " * 3000), (5, "  lead  and   trail  "), (None, "no id"), (6, "same"), (6, "same"),
        (7, "x" * 5000), (8, "<|endoftext|> inside"), (11, "a <|endoftext|> b <|endoftext|>"), (12, "word " * 900 + "é<|endoftext|>é"), (9, "é漢字🙂 \n\n  tab\t\tend\u00a0 "), (10, " ")]


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(" \n\t ab'sZ1é漢🙂\u00a0\u3000.,!<|>\r"), max_size=40))
def test_chunks_give_the_ids_of_the_whole_text(text):
    own = packing.encoder(PATH, 1)
    tokenizer = own.tokenizer
    ids = np.frombuffer(own._by_chunks([text])[0], own.dtype).tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids + [1]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(" \n\t\rabsStTreEé ÿÀ'19.,!<|>-_\x7e"), max_size=60))
def test_plain_texts_take_the_faster_way_to_the_same_ids(text):
    own = packing.encoder(PATH, 1)
    assert own.plain is not None and packing.PLAIN.fullmatch(text)
    assert np.frombuffer(own.encode([text])[0], own.dtype).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids + [1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", " a", "b ", "é", "\n", "<|", "|>", "word"]), max_size=6).map("".join), max_size=5))
def test_ids_are_those_of_the_plain_call(texts):
    own, plain = packing.encoder(PATH, 1), Tokenizer.from_file(PATH)
    assert [np.frombuffer(b, own.dtype).tolist() for b in own.encode(texts)] == [
        plain.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_every_token_by_both_ways():
    """Each token's text, and each plain sign beside others, alone and in a row."""
    own = packing.encoder(PATH, 1)
    texts = [own.tokenizer.decode([i]) for i in range(50_000)]
    plain = [chr(c) for c in range(256) if packing.PLAIN.fullmatch(chr(c))]
    texts += [a + b + c for b in plain for a in "a1 .\n" for c in "a1 .\n"] + [c * 9 for c in plain]
    texts = [t for t in texts if packing.PLAIN.fullmatch(t)]
    assert len(texts) > 40_000
    want = [x.ids for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [own.plain.encode_ordinary(t) for t in texts] == want


@pytest.mark.parametrize("window", [1, 7, 2048])
def test_pieces(spark, documents, whole, window):
    out = packing.pack(documents(ROWS), PATH, window=window).collect()
    left = sorted((str(i), tuple(whole(t))) for i, t in ROWS)
    texts, sequences, now = [], {}, {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        at = sequences.setdefault(r["sequence_id"], 0)
        assert r["offset"] == at
        sequences[r["sequence_id"]] += len(ids)
        if r["start"] == 0:
            now = []
        assert r["start"] == len(now)
        now += ids
        if len(now) == r["doc_tokens"]:
            texts.append((str(r["id"]), tuple(now)))
    assert sorted(texts) == left
    total = sum(len(t) for _, t in left)
    assert sorted(sequences) == list(range(-(-total // window)))
    assert all(n == window for s, n in sequences.items() if s != max(sequences)) and max(sequences.values()) <= window


def test_empty_and_clashing(spark, documents):
    assert packing.pack(documents([]).where("false"), PATH).count() == 0
    clash = documents(ROWS).withColumns({c: F.lit("x") for c in ("id", "part", "at", "n", "ids", "width", "first", "before")})
    assert packing.pack(clash, PATH).count() >= len(ROWS)
