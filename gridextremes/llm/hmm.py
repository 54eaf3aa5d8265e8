"""A hidden Markov language model trained by Baum-Welch over all partitions."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import summed_arrays

STATES = 8
ROUNDS = 4
OWN = 28_672  # tokens that are symbols of their own
BUCKETS = 4_096  # symbols that the other tokens share, by their checksum
KNOWN = 1 << 18  # tokens whose counts are sent to the tasks
FLUSH = 400_000  # distinct tokens a task counts before it hands them on
BLOCK = 1_024  # symbols in a row of expected counts
LONG = 1_024  # tokens of a text that waits for others as long
BATCH = (500_000, 1_200_000)  # tokens of short and of long texts that are worked on together
SEED = 11
END = b""  # the end token: no word is empty


def tokens(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z only), then the end token."""
    words = text.lower().split() if text else []
    words.append(END)
    return words


@dataclass
class Vocabulary:
    """What tasks know about tokens: bounded by ``KNOWN``, ``OWN`` and ``BUCKETS`` whatever the data."""

    rank: dict[bytes, int]
    count: np.ndarray  # by rank, then 0 for any other token
    symbol: np.ndarray  # by rank
    own: int
    buckets: int
    total: int
    distinct: int
    shared: np.ndarray  # count + distinct + 1 of each shared symbol, so that it adds up to one with an unseen token


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol x state


def bucket_of(token: bytes, buckets: int) -> int:
    return zlib.crc32(token) % buckets


def token_counts(texts: DataFrame) -> DataFrame:
    """``token, c`` over all rows of binary column ``text``; counted per task, then added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridextremes.llm.hmm import tokens

        own: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.int64())], ["token", "c"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                own.update(tokens(text))
                if len(own) > FLUSH:
                    yield out()
                    own.clear()
        if own:
            yield out()

    return texts.mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, own: int = OWN, buckets: int = BUCKETS, known: int = KNOWN) -> Vocabulary:
    """The most frequent tokens, at most ``known`` of them, and totals over all tokens."""
    by_count = counts.groupBy("c").count().collect()
    total = sum(r["c"] * r["count"] for r in by_count)
    distinct = sum(r["count"] for r in by_count)
    least, taken = 1 << 62, 0
    for r in sorted(by_count, key=lambda r: -r["c"]):
        taken += r["count"]
        if taken > known:
            break
        least = r["c"]
    listed = [(r["token"], r["c"]) for r in counts.where(F.col("c") >= least).collect()]
    listed.sort(key=lambda t: (-t[1], t[0]))
    rank = {bytes(t): i for i, (t, _) in enumerate(listed)}
    own = min(own, len(listed))
    symbol = np.array([i if i < own else own + bucket_of(t, buckets) for t, i in rank.items()], np.int32)
    count = np.array([c for _, c in listed] + [0], np.int64)
    limit = listed[own - 1] if own else (b"", 1 << 62)
    is_own = (F.col("c") > int(limit[1])) | ((F.col("c") == int(limit[1])) & (F.col("token") <= F.lit(bytearray(limit[0]))))
    rest = counts.where(~is_own).groupBy((F.crc32("token") % buckets).cast("int").alias("b")).agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    shared = np.ones(buckets)
    for r in rest:
        shared[r["b"]] += r["c"] + r["v"]
    return Vocabulary(rank, count, symbol, own, buckets, total, distinct, shared)


def encoded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """Per row of ``id, text, train``: the symbols of its whole text and its tokens outside the list.

    ``uid`` numbers rows; the table is written, so it stays the same for all passes.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words)
    kind = docs.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridextremes.llm.hmm import bucket_of, tokens

        voc = shared.value
        other = len(voc.rank)
        log_count = np.log10(voc.count + 1.0)
        uid = TaskContext.get().partitionId() << 36
        get = voc.rank.get
        for batch in batches:
            for k in range(0, len(batch), 256):
                some = batch.slice(k, 256)
                n, symbols, known, logs, rare = [], [], [], [], []
                for text in some.column("text").to_pylist():
                    parts = tokens(text)
                    ranks = np.fromiter([get(t, other) for t in parts], np.int64, len(parts))
                    outside = np.flatnonzero(ranks == other)
                    code = np.empty(len(parts), np.int32)
                    inside = ranks < other
                    code[inside] = voc.symbol[ranks[inside]]
                    code[outside] = [voc.own + bucket_of(parts[i], voc.buckets) for i in outside.tolist()]
                    n.append(len(parts))
                    symbols.append(code.astype("<u2").tobytes())
                    known.append(int(inside.sum()))
                    logs.append((float(log_count[ranks].sum()), float(log_count[ranks[inside & (ranks >= voc.own)]].sum())))
                    rare.append([{"token": t, "n": c} for t, c in Counter(parts[i] for i in outside.tolist()).items()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + len(n))), some.column("id"), some.column("train"), pa.array(n, pa.int64()),
                     pa.array(known, pa.int64()), pa.array([x for x, _ in logs]), pa.array([x for _, x in logs]),
                     pa.array(symbols, pa.binary()), pa.array(rare, pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())])))],
                    ["uid", "id", "train", "n", "known", "logs", "shared_logs", "symbols", "rare"],
                )
                uid += len(n)

    schema = (f"uid long, id {kind}, train boolean, n long, known long, logs double, shared_logs double, "
              "symbols binary, rare array<struct<token: binary, n: long>>")
    return materialise(docs.mapInArrow(encode, schema), "symbols")


class Batch:
    """Sequences side by side: step t of all that are so long lies together, longest first."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.active = len(lengths) - np.cumsum(np.bincount(lengths, minlength=lengths[0] + 1))[:-1]
        self.first = np.concatenate([[0], np.cumsum(self.active)])
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        row = np.repeat(np.arange(len(lengths)), lengths)
        at = self.first[step] + row
        self.symbols = np.empty(len(at), np.int64)
        self.symbols[at] = np.concatenate([sequences[i] for i in self.order])
        self.row = np.empty(len(at), np.int64)
        self.row[at] = row

    def forward(self, model: Model, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray | None]:
        """log10 likelihood of each sequence; scaled forward values, scales and emissions for ``backward``."""
        emit = model.emit[self.symbols]
        alpha = np.empty_like(emit) if keep else None
        scale = np.empty(len(emit))
        now = None
        for t, n in enumerate(self.active.tolist()):
            a = self.first[t]
            now = model.start * emit[:n] if t == 0 else (now[:n] @ model.move) * emit[a : a + n]
            total = now.sum(axis=1)
            now /= total[:, None]
            scale[a : a + n] = total
            if keep:
                alpha[a : a + n] = now
        found = np.empty(len(self.order))
        found[self.order] = np.bincount(self.row, np.log10(scale), len(self.order))
        return found, alpha, scale, emit if keep else None

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions (state x symbol) of all sequences."""
        _, gamma, scale, emit = self.forward(model, keep=True)
        moves = np.zeros_like(model.move)
        beta = np.ones((self.active[-1], len(model.start)))
        for t in range(len(self.active) - 1, 0, -1):
            n, a, b = int(self.active[t]), self.first[t], self.first[t - 1]
            ahead = emit[a : a + n] * beta
            ahead /= scale[a : a + n, None]
            moves += gamma[b : b + n].T @ ahead
            gamma[a : a + n] *= beta
            before = int(self.active[t - 1])
            beta = np.ones((before, len(model.start)))
            beta[:n] = ahead @ model.move.T
        gamma[: self.active[0]] *= beta
        emissions = np.stack([np.bincount(self.symbols, gamma[:, k], len(model.emit)) for k in range(len(model.start))])
        return gamma[: self.active[0]].sum(axis=0), moves * model.move, emissions


def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """``uid`` and symbols of texts of like length, enough of them to be worked on together."""
    waiting: tuple[list, list] = ([], [])
    sizes = [0, 0]
    for batch in batches:
        for uid, symbols in zip(batch.column("uid").to_pylist(), batch.column("symbols"), strict=True):
            own = np.frombuffer(symbols.as_py(), "<u2")
            k = int(len(own) > LONG)
            waiting[k].append((uid, own))
            sizes[k] += len(own)
            if sizes[k] >= BATCH[k]:
                yield [u for u, _ in waiting[k]], [s for _, s in waiting[k]]
                waiting[k].clear()
                sizes[k] = 0
    for some in waiting:
        if some:
            yield [u for u, _ in some], [s for _, s in some]


def symbol_shares(words: Vocabulary) -> np.ndarray:
    """Share of each symbol among the training tokens, none of them zero."""
    counts = np.concatenate([words.count[: words.own].astype(float), words.shared - 1])
    return (counts + 0.5) / (counts + 0.5).sum()


def first_model(words: Vocabulary, states: int = STATES, seed: int = SEED) -> Model:
    """Sticky states whose emissions are the shares of the corpus, each disturbed at random."""
    share = symbol_shares(words)
    noise = np.random.default_rng(seed).normal(0, 0.5, (len(share), states))
    emit = share[:, None] * np.exp(noise)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def trained(table: DataFrame, words: Vocabulary, states: int = STATES, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """Baum-Welch over all training rows: every round adds up the expected counts of all partitions.

    A round sends back one array per state and symbol, of fixed size. Emissions
    are smoothed by the share of the symbol in the corpus, so none is zero.
    """
    model, share = first_model(words, states, seed), symbol_shares(words)
    context = table.sparkSession.sparkContext
    rows = table.where("train").select("uid", "symbols")
    size = len(share)
    for _ in range(rounds):
        shared = context.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from gridextremes.llm.hmm import Batch, batched

            model, sums = shared.value, None
            for _, sequences in batched(batches):
                more = Batch(sequences).expected(model)
                sums = [a + b for a, b in zip(sums, more, strict=True)] if sums else list(more)
            if sums:
                start, moves, emissions = sums
                parts = [(-1, np.concatenate([start, moves.ravel()]))]
                parts += [(a, emissions[:, a : a + BLOCK].ravel()) for a in range(0, size, BLOCK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in parts], pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())],
                    ["block", "counts"])

        found = summed_arrays(rows.mapInArrow(expect, "block int, counts binary"), "f8")
        shared.unpersist()
        if not found:
            break
        head = found.pop(-1)
        emissions = np.concatenate([found[a].reshape(states, -1) for a in sorted(found)], axis=1)
        start, move = head[:states] + 0.1, head[states:].reshape(states, states) + 0.1
        emit = emissions.T + share[:, None] * 10
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES,
                rounds: int = ROUNDS, own: int = OWN, buckets: int = BUCKETS, known: int = KNOWN) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    A hidden Markov model over whole texts: the ``own`` most frequent tokens are
    symbols; all others share ``buckets`` symbols by checksum, and within a shared
    symbol each token has its add-one share, an unseen one the rest. So every
    text has a probability; ``score`` is its log10 by the scaled forward
    recursion. Texts are learned where ``held_out`` is not true. ``base_score``
    is the unigram score with add-one counts.

    Counts of tokens outside the list of the ``known`` most frequent are found by
    a join with the counts of all tokens; the list, the model and the symbol
    counts are of fixed size, and nothing else is sent to tasks or the driver.

    A null or empty text is the end token alone; long texts are scored in full;
    repeated rows are scored and learned each; with an empty table, or nothing to
    learn from, all tokens are unseen; a null id stays null; other columns are
    not read. Rows without a truth value in ``held_out`` are learned.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"),
                       (~F.coalesce(held_out, F.lit(False))).alias("train"))
    counts = materialise(token_counts(rows.where("train").select("text")), "counts")
    words = vocabulary(counts, own, buckets, known)
    table = encoded(rows, words)
    model = trained(table, words, states, rounds)
    emit = model.emit.copy()
    emit[words.own :] /= words.shared[:, None]
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.start, model.move, emit))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridextremes.llm.hmm import Batch, batched

        for uids, sequences in batched(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids, pa.int64()), pa.array(Batch(sequences).forward(shared.value)[0])], ["uid", "chain"])

    chain = table.select("uid", "symbols").mapInArrow(score, "uid long, chain double")
    rare = table.select("uid", F.explode("rare").alias("r")).select("uid", "r.token", "r.n").join(counts, "token").groupBy("uid").agg(
        F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_logs"))
    base = np.log10(words.total + words.distinct + 1.0)
    more = F.coalesce("more_logs", F.lit(0.0))
    return table.select("uid", "id", "train", "n", "known", "logs", "shared_logs").join(chain, "uid").join(rare, "uid", "left").select(
        "id", (~F.col("train")).alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n") * F.lit(float(base))).alias("base_score"),
        (F.col("chain") + F.col("shared_logs") + more).alias("score"),
    )
