import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from gridextremes.llm.spelling import near_words, spelling_groups

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(UPPER)
            h = crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 97 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            counts[low] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def neighbours(counts):
    return {a: [b for b in counts if abs(len(a) - len(b)) < 2 and is_near(a, b)] for a in counts}


def brute(rows):
    counts = counted(rows)
    form, out = {}, []
    near = neighbours(counts)
    for a, others in near.items():
        if others:
            best = min(others, key=lambda b: (-counts[b], b))
            if counts[best] >= 2 * counts[a]:
                form[a] = best
    for a, n in counts.items():
        root = a
        while root in form:
            root = form[root]
        out.append((a, form.get(a), root, n, len(near[a]), counts.get(form.get(a))))
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()], key=str)


def variants(deal, word):
    kind, at, c = deal.randrange(3), deal.randrange(len(word) + 1), deal.choice("abcéÿ")
    return word[:at] + (c if kind < 2 else "") + word[at + (kind > 0):]


ROWS = [
    (1, "Hello hello HELLO hellö hellö hellö helloo helloo helloo helo helo helo"), (2, None), (3, ""), (None, "world world world wor1d"),
    (4, "ÉCOLE École École école école école ecole " * 4), (5, "aaaaa aaaaaa aaaaaaa " * 9 + "aaaaa aaaab " * 30), (5, "world words words words"),
    (6, "abcde " * 3 + "abcdf " * 6 + "abcdg " * 6 + "abcdef " * 12 + "abcdeff " * 24), (7, "m×n÷o m×n÷o m×n÷o don't can’t"),
]


@pytest.mark.parametrize("block_rows", [16_384, 2])  # blocks as they are, and entered anew until single letters
def test_against_brute_force(documents, block_rows):
    rows = ROWS + [(i, f"many words {ROWS[i % 9][1]}") for i in range(10, 40)]
    assert found(spelling_groups(documents(rows), block_rows=block_rows)) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_words_and_lost_letters(documents, seed):
    deal = random.Random(seed)
    words = ["".join(deal.choice("abc") for _ in range(deal.randrange(4, 9))) for _ in range(60)]
    words += [variants(deal, w) for w in words for _ in range(3)]
    words += ["prefixed" + "".join(deal.choice("xy") for _ in range(6)) for _ in range(60)]
    weights = [deal.randrange(1, 60) for _ in words]
    rows = [(i, " ".join(deal.choices(words, weights, k=40)).title() if i % 3 else " ".join(deal.choices(words, k=40))) for i in range(300)]
    assert found(spelling_groups(documents(rows), block_rows=50)) == brute(rows)


def test_pairs_are_found_once(spark):
    counts = {w: i + 3 for i, w in enumerate(["aaaaa", "aaaaaa", "aaaaaaa", "aabaa", "aaaaab", "baaaaa", "aaabaa", "aabaaa", "abaaa", "aaaaaab"])}
    got = {r.word: r.n_near for r in near_words(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == {w: len(o) for w, o in neighbours(counts).items() if o}


def test_long_text_and_long_words(documents):
    word = "ab" * 50_000
    rows = [(1, "filler words " * 100_000), (2, f"{word} {word} {word} {word}x {word}x {word}x {word}x {word}x {word}x")]
    got = {r.word: r for r in spelling_groups(documents(rows)).collect()}
    assert {w: r.n for w, r in got.items()} == counted(rows)
    assert got[word].form == word + "x"


def test_empty_and_clashing_columns(documents):
    docs = documents(ROWS)
    assert spelling_groups(docs.where("false")).count() == 0
    clash = docs.withColumns({c: F.lit(1) for c in ("id", "word", "n", "key", "lo", "hi", "longer", "near", "root", "form")})
    assert found(spelling_groups(clash)) == brute(ROWS)
