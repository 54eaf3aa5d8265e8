"""Spelling variants: words that differ by one code point, grouped under the frequent one.

Words are counted once over all texts. Two words at one edit agree but for one
stretch, so every word is entered once per stretch, under what lies around it.
The words of such a block have a bit-sliced index: one bitset over the block for
every (position, letter). A word runs through the positions once and a few word
operations track, for the whole block, which words agree so far and which are one
error away.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_join
from ..session import materialise

MIN_CHARS = 5
MIN_COUNT = 3
TIMES = 2  # how many times as frequent a form must be
SLIP = 97  # a run whose checksum this divides loses a letter
STRETCHES = 3
BLOCK_ROWS = 16_384  # a larger block is entered anew by shorter stretches
FLUSH_WORDS, FLUSH_CHARS = 100_000, 8_000_000  # what a task counts before it hands on
LONG_TEXT = 1_000_000
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the texts with their counts, handed on whenever a bounded number has come together."""
    counts: Counter[str] = Counter()
    lowered: dict[str, tuple[str, bytes]] = {}
    chars = 0

    def handed_on() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py() or ""
            start = crc32(f"{doc.as_py() or ''}:".encode())
            # A list of all runs is faster, but of a long text too large.
            runs = RUN.findall(text) if len(text) < LONG_TEXT else (m.group() for m in RUN.finditer(text))
            for run, n in Counter(runs).items():
                known = lowered.get(run)
                if known is None:
                    low = run.translate(LOWER)
                    known = lowered[run] = (low, low.encode())
                    chars += len(run)
                word = known[0]
                sum32 = crc32(known[1], start)
                if sum32 % SLIP == 0:
                    at = sum32 % len(word)
                    word = word[:at] + word[at + 1:]
                if len(word) >= MIN_CHARS:
                    counts[word] += n
            if len(counts) > FLUSH_WORDS or len(lowered) > FLUSH_WORDS or chars > FLUSH_CHARS:
                yield handed_on()
                counts.clear()
                lowered.clear()
                chars = 0
    if counts:
        yield handed_on()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``n``: words of at least 5 code points with at least 3 occurrences.

    A word is a maximal run of Latin letters with A-Z lower-cased; where the
    checksum of ``<id>:<run>`` is a multiple of 97, the run loses a letter first.
    Null texts have no words; a null id counts as empty before the colon.
    """
    texts = docs.select(docs[f"`{id_col}`"].cast("string").alias("id"), docs[f"`{text_col}`"].alias("text"))
    counted = texts.where(F.col("text").isNotNull()).mapInArrow(_count_runs, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _entries(rows: DataFrame) -> DataFrame:
    """``rows`` (``word``, ``n``, ``longer``, ``lo``, ``hi``) once per third of the stretch ``lo`` to ``hi``.

    ``longer`` is 1 where the word stands for one with a letter more than the
    stretch is counted in. ``key`` is a hash of what lies around the new stretch.
    """
    width = F.col("hi") - F.col("lo")

    def cut(j: Column) -> Column:
        return (F.col("lo") + F.floor(j * width / STRETCHES)).cast("int")

    thirds = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda j: F.struct(cut(j).alias("lo"), cut(j + 1).alias("hi")))
    rows = rows.select("word", "n", "longer", F.explode(F.filter(thirds, lambda t: t["lo"] < t["hi"])).alias("t"))
    rows = rows.select("word", "n", "longer", "t.lo", "t.hi")
    length = F.length("word")
    before = F.substring(F.col("word"), F.lit(1), F.col("lo"))
    after = F.substring(F.col("word"), F.col("hi") + F.col("longer") + 1, length)
    return rows.withColumn("key", F.xxhash64(length - F.col("longer"), "lo", "hi", before, after))


def blocks(words: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every word under each of its keys, no key with more than ``block_rows`` rows.

    A word is entered by its own length and, as the longer of a pair, by one less.
    Blocks that are too large are found by a count combined map-side and entered
    again by thirds of their stretch: an edit lies in one of them. A stretch of one
    letter holds at most 90 * 91 words, so ``block_rows`` of 8 190 or more is kept
    after a few rounds. The broadcast keys are fewer than rows / ``block_rows``.
    """
    length = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    whole = whole.select("*", F.lit(0).alias("lo"), (length - F.col("longer")).alias("hi")).where(F.col("hi") >= MIN_CHARS)
    entered, out = _entries(whole), None
    while True:
        sizes = entered.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("hi") - F.col("lo")).alias("width"))
        large = materialise(sizes.where((F.col("rows") > block_rows) & (F.col("width") > 1)).select("key"), "large_blocks")
        if large.isEmpty():
            return entered if out is None else out.unionByName(entered)
        small = entered.join(F.broadcast(large), "key", "left_anti").select(entered.columns)
        out = small if out is None else out.unionByName(small)
        entered = _entries(entered.join(F.broadcast(large), "key", "left_semi"))


class BitIndex:
    """For every (position, letter) the set of words with that letter there, as bits of one number."""

    def __init__(self, stretches: list[str]):
        self.all = (1 << len(stretches)) - 1
        slices: dict[tuple[int, str], int] = defaultdict(int)
        for k, stretch in enumerate(stretches):
            for at in enumerate(stretch):
                slices[at] |= 1 << k
        self.slices = dict(slices)

    def replaced(self, letters: str) -> int:
        """Words of the same length with exactly one other letter."""
        same, one = self.all, 0
        for at in enumerate(letters):
            here = self.slices.get(at, 0)
            same, one = same & here, (one & here) | (same & ~here)
        return one

    def inserted(self, letters: str, last: bool) -> int:
        """Words with one letter more, put in before the end of the stretch (or, in the last one, at it)."""
        same, one = self.all, 0
        for i, c in enumerate(letters):
            one = (one | same) & self.slices.get((i + 1, c), 0)
            same &= self.slices.get((i, c), 0)
        return one | same if last else one & ~same

    def deleted(self, letters: str, last: bool) -> int:
        """Words with one letter less; where the stretch goes on after them only those that end differently."""
        same, one = self.all, 0
        for i, c in enumerate(letters):
            one = (one & self.slices.get((i - 1, c), 0)) | same
            if i + 1 < len(letters):
                same &= self.slices.get((i, c), 0)
        return one if last else one & ~same


def _near_in_block(rows: list[tuple[str, int, int, int, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, how many near it, count of the most frequent, the most frequent) of one block."""
    _, _, longer, lo, hi = rows[0]
    last = hi == len(rows[0][0]) - longer
    # The most frequent word has bit 0, so the best of a set is its lowest bit.
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    sides = [[r for r in rows if r[2] == side] for side in (0, 1)]
    if not sides[0]:
        return
    plain = BitIndex([r[0][lo:hi] for r in sides[0]])
    more = BitIndex([r[0][lo:hi + 1] for r in sides[1]])

    def best(hits: int, among: list[tuple]) -> tuple[int, int, str]:
        first = among[(hits & -hits).bit_length() - 1]
        return hits.bit_count(), first[1], first[0]

    for word, *_ in sides[0]:
        letters = word[lo:hi]
        if hits := plain.replaced(letters):
            yield word, *best(hits, sides[0])
        if sides[1] and (hits := more.inserted(letters, last)):
            yield word, *best(hits, sides[1])
    for word, *_ in sides[1]:
        if hits := plain.deleted(word[lo:hi + 1], last):
            yield word, *best(hits, sides[0])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of all blocks of a partition sorted by key; one block is held at a time."""

    def searched(rows: list[tuple]) -> Iterator[tuple[str, int, int, str]]:
        if len(rows) < 2:
            return
        alike = defaultdict(list)  # keys are hashes: words are only compared where what is hashed agrees
        for r in rows:
            word, _, longer, lo, hi = r
            alike[len(word) - longer, lo, hi, word[:lo], word[hi + longer:]].append(r)
        for block in alike.values():
            if len(block) > 1:
                yield from _near_in_block(block)

    def packed(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["word", "near", "best_n", "best"])

    key, rows, found = None, [], []
    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                found.extend(searched(rows))
                key, rows = k, []
                if len(found) > 10_000:
                    yield packed(found)
                    found = []
            rows.append(row)
    found.extend(searched(rows))
    if found:
        yield packed(found)


def near_words(words: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``word``, ``n_near``, ``best_n``, ``best`` of every word with a near word.

    Every pair of near words is found in exactly one block, that of the stretch in
    which their first difference lies, so counts of blocks add up and no pair is
    written out.
    """
    entered = blocks(words, block_rows).select("key", "word", "n", "longer", "lo", "hi")
    found = entered.repartition("key").sortWithinPartitions("key").mapInArrow(
        _search, "word string, near long, best_n long, best string"
    )
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.minus")).alias("best_n"), "b.best")


def roots(links: DataFrame) -> DataFrame:
    """``word`` and ``root``: the end of the chain that begins at each word of ``links`` (``word``, ``form``).

    Every round doubles the stretch a word has gone; counts at least double along a
    chain, so a chain has at most 63 links and a few rounds do. A root that
    many words share is no hot key: its rows are spread.
    """
    at = materialise(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(hot_join(at, ahead, ["root"], "left"), "roots")
        if moved.where(F.col("next").isNotNull()).isEmpty():
            return at
        at = moved.select("word", F.coalesce("next", "root").alias("root"))


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Two words are near at exactly one inserted, deleted or replaced code point. The
    form of a word is its most frequent near word, of equally frequent ones the
    first in code-point order, if it is at least twice as frequent. ``root`` is
    where the chain of forms ends, the word itself if it has none.

    Null and empty texts have no words, an empty table gives an empty result,
    repeated rows count each, rows of the same or of no id are read like any others,
    and extra columns are not read. A text or a word may have any length; a text is
    read in one task, its words leave it counted.
    """
    words = materialise(word_counts(docs, id_col, text_col), "words")
    near = near_words(words, block_rows)
    fit = F.col("best_n") >= TIMES * F.col("n")
    judged = materialise(words.join(near, "word", "left").select(
        "word", F.when(fit, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fit, F.col("best_n")).alias("form_n"),
    ), "near_words")
    ends = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
