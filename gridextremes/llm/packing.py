"""Packing by concatenating token ids and cutting fixed windows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

WINDOW = 2048
MEMO = 600_000  # chunks whose ids a worker keeps
TOGETHER = 2_000  # new chunks encoded as one text
LONG = 64  # longer chunks are not kept
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
RUN = re.compile(r"\S{400}|\s{400}")  # long runs are slow to merge there
# Fixed value: how byte-level tokenizers of this kind split a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[tuple[str, int], Encoder] = {}


class Encoder:
    """Ids of whole texts as packed bytes, with a memory of chunks seen.

    The tokenizer splits before a space that stands between two characters that
    are not a space, so a text is the sequence of its chunks, each with the space
    before it; further spaces belong to the chunk before them. New chunks are
    encoded many at a time, as one text, and parted by the bytes that their ids
    stand for; afterwards they are looked up.

    Texts of plain signs go a faster way to the same ids: see ``plain_coder``. A text
    that holds the string of an added token is encoded whole, so it gets the ids
    that the tokenizer itself gives it.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(added)) if added else None
        # The other two ways only see texts without such strings.
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = id_type(self.tokenizer.get_vocab_size(), end_id)
        self.end = np.array([end_id], self.dtype).tobytes()
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # a sign of the vocabulary is a byte
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self.memo: dict[str, bytes] = {}
        self.plain = plain_coder(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def chunks(text: str) -> list[str]:
        head, *rest = text.split(" ")
        if "" not in rest:
            return [head, *[" " + r for r in rest]] if head else [" " + r for r in rest]
        out = [head]
        for r in rest:
            if r:
                out.append(" " + r)
            else:
                out[-1] += " "
        return out if out[0] else out[1:]

    def encode(self, texts: list[str]) -> list[bytes]:
        marked = {t for t in texts if self.added is not None and self.added.search(t)}
        if not marked:
            return self._encode(texts)
        others = iter(self._encode([t for t in texts if t not in marked]))
        ids = {t: np.array(self.whole.encode(t, add_special_tokens=False).ids, self.dtype).tobytes() + self.end for t in marked}
        return [ids[t] if t in marked else next(others) for t in texts]

    def _encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.plain is not None and bool(PLAIN.fullmatch(t)) and not RUN.search(t) for t in texts]
        others = iter(self._by_chunks([t for t, easy in zip(texts, plain, strict=True) if not easy]))
        return [
            self.plain.encode_to_numpy(t, disallowed_special=()).astype(self.dtype).tobytes() + self.end if easy else next(others)
            for t, easy in zip(texts, plain, strict=True)
        ]

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        split = [self.chunks(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new = sorted(set().union(*split).difference(memo))
        joined = [c for c in new if len(c) <= LONG and c[0] == " " and c.strip(" ")]
        for k in range(0, len(joined), TOGETHER):
            some = joined[k : k + TOGETHER]
            memo.update(zip(some, self._together(some), strict=True))
        alone = [c for c in new if c not in memo]
        long = dict(zip(alone, self._each(alone), strict=True))
        if not long:
            return [b"".join(map(memo.__getitem__, chunks)) + self.end for chunks in split]
        return [b"".join([memo[c] if c in memo else long[c] for c in chunks]) + self.end for chunks in split]

    def _each(self, chunks: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]

    def _together(self, chunks: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.cumsum([len(c.encode()) for c in chunks])
        reach = np.cumsum(self.width[ids])
        stop = np.searchsorted(reach, ends) + 1
        if stop[-1] != len(ids) or (reach[stop - 1] != ends).any():  # another kind of tokenizer
            return self._each(chunks)
        whole, size = ids.tobytes(), self.dtype.itemsize
        bounds = [0, *(stop * size).tolist()]
        return [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def plain_coder(given: dict):
    """A faster coder with the same vocabulary, where it must give the same ids; else None.

    That holds for byte-level merges without further rules whose ids follow the
    order of the merges, and texts of ``PLAIN`` signs, whose classes (letter,
    digit, space) are the same for every library and version.
    """
    model, split = given["model"], given.get("pre_tokenizer") or {}
    rules = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")]
    if model.get("type") != "BPE" or any(rules) or given.get("normalizer") or split.get("type") != "ByteLevel":
        return None
    if split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    signs, vocabulary = byte_signs(), model["vocab"]
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    if any(vocabulary.get(c, 256) >= 256 for c in signs) or any(vocabulary[m.replace(" ", "")] != 256 + i for i, m in enumerate(merges)):
        return None
    import tiktoken

    ranks = {bytes(signs[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def id_type(vocabulary: int, end_id: int) -> np.dtype:
    return np.dtype("<u2") if max(vocabulary - 1, end_id) < 1 << 16 else np.dtype("<u4")


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def tokenised(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass: ``part``, ``at`` (ids before the text in its partition), ``id``, ``n``, ``ids``, ``width`` per row.

    Written once, so that the partitions and the order in them stay what they
    were when an executor is lost. ``ids`` are packed little-endian integers of
    ``width`` bytes, ending in ``end_id``. A null text is empty.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridextremes.llm.packing import encoder

        own = encoder(path, end_id)
        part, at, width = TaskContext.get().partitionId(), 0, own.dtype.itemsize
        for batch in batches:
            for k in range(0, len(batch), 512):
                some = batch.slice(k, 512)
                ids = own.encode(some.column("text").to_pylist())
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // width
                ends = at + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), some.column("id"), pa.array(n),
                     pa.array(ids, pa.binary()), pa.array(np.full(len(n), width, np.int32))],
                    ["part", "at", "id", "n", "ids", "width"],
                )
                at = int(ends[-1])

    schema = f"part int, at long, id {kind}, n long, ids binary, width int"
    return materialise(source.mapInArrow(encode, schema), "ids")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Pieces of all texts, ``window`` ids to a sequence; only the last sequence needs padding.

    One row per piece: ``id``, ``start`` (ids of its text before it), ``length``,
    ``ids`` (packed unsigned 32-bit little-endian), ``doc_tokens``,
    ``sequence_id``, ``offset``. A text that crosses the border of a window is
    cut there into further rows.

    The totals of the partitions (one row each; that table alone is broadcast and
    summed up in one window) give each text its place in the concatenation, so
    ids are never shuffled or sorted. A null or empty text is its end id alone;
    a null id stays null; rows that repeat are packed each; an empty table gives
    an empty result; other columns are not read.
    """
    table = tokenised(docs, path, end_id, id_col, text_col)
    totals = table.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    placed = table.join(F.broadcast(totals.select("part", before.alias("before"))), "part").select(
        "id", (F.col("before") + F.col("at")).alias("first"), "n", "ids", "width"
    )
    kind = table.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column("first").to_numpy()
            n = batch.column("n").to_numpy()
            opens = first // window
            pieces = (first + n - 1) // window - opens + 1
            of = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = opens[of] + nth
            start = np.maximum(sequence * window - first[of], 0)
            stop = np.minimum((sequence + 1) * window - first[of], n[of])
            column, widths = batch.column("ids"), batch.column("width").to_numpy()
            found, last, ids = [], -1, None
            for k, a, b in zip(of.tolist(), start.tolist(), stop.tolist(), strict=True):
                if k != last:
                    ids, last = np.frombuffer(column[k].as_buffer(), f"<u{widths[k]}"), k
                found.append(ids[a:b].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(of)), pa.array(start), pa.array(stop - start), pa.array(found, pa.binary()),
                 pa.array(n[of]), pa.array(sequence), pa.array(first[of] + start - sequence * window)],
                ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.mapInArrow(cut, schema)
