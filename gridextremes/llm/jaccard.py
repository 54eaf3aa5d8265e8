"""Documents whose word shingles are similar, by token-combination prefixes.

Every document is a set of hashed shingles. In one global order, rare shingles
first, two similar sets share a shingle among the first few of both, so only this
prefix is indexed. Rare shingles are indexed one by one. Where a prefix reaches
shingles that very many documents share, it is extended and combinations of two
of them are indexed instead. Every candidate is verified on the whole sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import hot_join
from ..session import materialise
from .common import packed, summed_arrays

WORDS = 5
PERCENT = 80
CELLS = 1 << 22  # counters of the frequency sketch
BLOCK = 1 << 14
MARKS = 1 << 24  # places of the bitmap that picks texts
FREQUENT = 0.01  # a shingle in more than this share of the documents is frequent
LEADERS = 3  # sets of a key that are compared with the others in a round
KEY_SHARE = 1000  # a key with more than about 1 / KEY_SHARE of the index entries is salted
SAMPLE = 64  # one entry in so many is looked at to find such keys
_ODD = np.uint64(0x9E3779B97F4A7C15)
ONE = np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of all word shingles of a text, ascending.

    A-Z count as a-z, words are parted by ASCII white space. With fewer words than
    a shingle has, the whole sequence is the one shingle; without words there is none.
    """
    parts = text.lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), seed=len(parts))], np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    count = len(parts) - words + 1
    total = own[:count].copy()
    for j in range(1, words):
        total *= _ODD
        total += own[j : j + count]
    return np.unique(_mixed(total))


def index_keys(hashes: np.ndarray, counts: np.ndarray, frequent: float, percent: int = PERCENT) -> np.ndarray:
    """Keys under which a set is indexed; similar sets have one in common.

    ``counts`` are the frequencies of the shingles, the same for every set. With
    overlap at least t = percent of the size, similar sets share their first
    common shingle inside the first ``size - t + 1`` of both. If it is rare, its
    own key meets. If it is frequent, all they share is frequent: among the first
    ``size - t + k`` they share k, so of k - 1 groups of shingles one holds two,
    and the combination of the two meets. The number of groups follows from the
    size of the larger set, so a set near a power of two takes both numbers.
    The keys of single rare shingles are even, all others odd.
    """
    n = len(hashes)
    if n * 100 < percent * (n + 1):  # too small to be similar to any other set
        return np.empty(0, np.uint64)
    need = -(-percent * n // 100)
    order = np.lexsort((hashes, counts))
    ranked, often = hashes[order], counts[order] > frequent
    first = n - need + 1
    keys = [ranked[:first][~often[:first]] & ~ONE]
    if often[:first].any():
        level = n.bit_length() - 1
        levels = [level] + [level + 1] * (n * 100 >= percent << (level + 1))
        for g in levels:
            if percent << g < 200:  # such small sets may share a single shingle
                keys.append(ranked[:first][often[:first]] | ONE)
                continue
            groups = max(1, (1 << g) // 8)
            some = ranked[: min(n, n - need + groups + 1)][often[: min(n, n - need + groups + 1)]]
            keys.append(_pairs(np.sort(some), groups, g))
    return np.unique(np.concatenate(keys))


def rare_first(counts: np.ndarray, frequent: float, percent: int = PERCENT) -> int:
    """How many shingles of the prefix are rare."""
    if not len(counts):
        return 0
    first = len(counts) + 1 + percent * -len(counts) // 100
    return int((np.partition(counts, first - 1)[:first] <= frequent).sum())


def _pairs(some: np.ndarray, groups: int, level: int) -> np.ndarray:
    """A key for every two of ``some`` that fall into the same of ``groups``."""
    group = (some >> np.uint64(24)) % np.uint64(groups)
    order = np.argsort(group, kind="stable")
    some, group = some[order], group[order]
    found = []
    for gap in range(1, len(some)):
        same = group[gap:] == group[:-gap]
        if not same.any():
            break
        low, high = some[:-gap][same], some[gap:][same]
        found.append(_mixed(low * _ODD + high + np.uint64(level)) | ONE)
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _small(counts: np.ndarray) -> bytes:
    """Counts packed with as few bytes each as the largest needs, and compressed."""
    kind = np.min_scalar_type(counts.max())
    return kind.char.encode() + zlib.compress(counts.astype(kind).tobytes(), 1)


def _large(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), packed[:1].decode()).astype(np.uint32)


def _bits(counts: np.ndarray) -> bytes:
    """Which counts are not 0, a bit each, compressed."""
    return zlib.compress(np.packbits(counts > 0).tobytes(), 1)


def frequencies(texts: DataFrame, words: int = WORDS, cells: int = CELLS) -> np.ndarray:
    """Counters of all shingles of column ``text`` (binary), hashed into ``cells``.

    Counted per task, where equal sets count once, and added up block by block.
    The result has a fixed size whatever the data; it only orders shingles, so
    shared counters cost time, never a link.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridextremes.llm.jaccard import shingle_set

        own, seen = np.zeros(cells, np.uint32), set()
        for batch in batches:
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py(), words)
                digest = xxhash.xxh3_128_digest(hashes)
                if digest not in seen:
                    seen.add(digest)
                    np.add.at(own, (hashes & np.uint64(cells - 1)).astype(np.int64), np.uint32(1))
        blocks = [k for k in range(0, cells, BLOCK) if own[k : k + BLOCK].any()]
        if blocks:
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int32()), pa.array([_small(own[k : k + BLOCK]) for k in blocks], pa.binary())],
                ["block", "counts"],
            )

    total = np.zeros(cells, np.uint32)
    for block, part in summed_arrays(texts.mapInArrow(count, "block int, counts binary"), "u4", _large, _small).items():
        counts = _large(part)
        total[block : block + len(counts)] = counts
    return total


def indexed(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, cells: int,
            frequent: float) -> DataFrame:
    """Index keys of every row, the percentage being 50 at least, else the combinations would not suffice.

    Per row: ``number`` (unique, as written), ``id``, ``n`` (size of its set), ``digest`` of the set, ``text_hash``,
    ``rare`` (see ``rare_first``), ``keys``.
    """
    if percent < 50:
        raise ValueError(f"percent is 50 or more: {percent}")
    text = F.col(f"`{text_col}`")
    source = docs.select(
        F.monotonically_increasing_id().alias("number"), F.col(f"`{id_col}`").alias("id"), text.cast("binary").alias("text"),
        text_hash(text).alias("text_hash"))
    counts = frequencies(source.select("text"), words, cells)
    limit = float(counts.mean()) + frequent * docs.count() + 1
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridextremes.llm.jaccard import index_keys, rare_first, shingle_set

        every = shared.value
        for batch in batches:
            for k in range(0, len(batch), 256):
                some = batch.slice(k, 256)
                sizes, digests, keys, rare = [], [], [], []
                for one in some.column("text"):
                    hashes = shingle_set(one.as_py(), words)
                    often = every[(hashes & np.uint64(cells - 1)).astype(np.int64)]
                    sizes.append(len(hashes))
                    digests.append(xxhash.xxh3_128_digest(hashes))
                    keys.append(index_keys(hashes, often, limit, percent).view(np.int64))
                    rare.append(rare_first(often, limit, percent))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [some.column("number"), some.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), some.column("text_hash"),
                     pa.array(rare, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))],
                    ["number", "id", "n", "digest", "text_hash", "rare", "keys"],
                )

    schema = "number long, id long, n long, digest binary, text_hash long, rare long, keys array<long>"
    written = materialise(source.withColumn("id", F.col("id").cast("long")).mapInArrow(index, schema), "prefixes")
    shared.destroy()
    return written


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct set that can have links; its number ``node`` is that of one of its rows."""
    return materialise(
        rows.where("n > 0").groupBy("digest").agg(
            F.min("number").alias("node"), F.min("id").alias("id"), F.first("n").alias("n"),
            F.first("text_hash").alias("text_hash"), F.first("rare").alias("rare"), F.first("keys").alias("keys"),
        ), "classes")


def _salted(entries: DataFrame) -> DataFrame:
    """``entries`` with ``salt``, ``salts`` and ``members`` (rows of the key).

    Keys that many sets share are found on a part of the entries that follows from
    their values, and their rows dealt over several salts; there are fewer than
    ``KEY_SHARE`` of them. Which keys that are changes no result. Rows are counted
    where they are sorted by (key, salt), those of salted keys map-side.
    """
    part = entries.where(F.pmod(F.xxhash64("node", "key"), F.lit(SAMPLE)) == 0)
    fair = max(4.0, part.count() / KEY_SHARE)
    hot = materialise(
        part.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > fair)
        .select("key", F.ceil(F.col("c") / fair).cast("int").alias("salts")), "hot_keys")
    all_of = entries.join(F.broadcast(hot), "key").groupBy("key", "salts").agg(F.count(F.lit(1)).alias("all_of"))
    dealt = entries.join(F.broadcast(materialise(all_of, "hot_keys")), "key", "left").withColumn(
        "salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int"))
    here = F.count(F.lit(1)).over(W.partitionBy("key", "salt"))
    return dealt.withColumn("members", F.coalesce("all_of", here)).drop("all_of")


def _for_salts(per_key: DataFrame) -> DataFrame:
    """Rows of ``per_key`` (``key``, ``salts``, ...) once per salt, to be joined on ``key, salt``."""
    return per_key.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _shared_keys(classes: DataFrame, percent: int) -> DataFrame:
    """Index entries ``node, key, weight`` whose key another set has as well, with what bounds the links of the set.

    ``behind``: shingles that may be common beside the rare ones of the prefix;
    ``plain``: the prefix has rare ones only; ``shared``: how many of these another
    set has, ``bits`` their places on 64 bits. ``weight`` is high for sets whose keys have many members.
    """
    entries = classes.select("node", "n", "rare", F.explode("keys").alias("key"))
    entries = materialise(_salted(entries).where("members > 1"), "entries")
    facts = entries.groupBy("node").agg(F.sum("members").alias("weight"), F.count_if(F.col("key") % 2 == 0).alias("shared"),
        F.coalesce(F.bit_or(F.when(F.col("key") % 2 == 0, F.expr("shiftleft(1L, cast(pmod(shiftright(key, 8), 64) AS INT))"))), F.lit(0)).alias("bits"))
    first = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    return materialise(entries.join(facts, "node").select(
        "node", "n", "key", "salt", "salts", "weight", "shared", "bits", (F.col("n") - F.col("rare")).alias("behind"),
        (F.col("rare") == first).alias("plain")), "bounded")


BOUNDS = ["n", "shared", "bits", "behind", "plain"]


def _possible(percent: int, common=None):
    """Whether sets a and b may share enough, ``common`` of the rare shingles of their prefixes being common.

    Where the prefix of a set reaches frequent shingles, it holds all rare ones
    of the set. So beside the common rare ones only frequent shingles can be
    common if both prefixes do, or else what lies behind the prefix of the plain one.
    """
    if common is None:  # on each place that only one set has lies at least one that is not common
        common = F.expr("least(a_shared - bit_count(a_bits & ~b_bits), b_shared - bit_count(b_bits & ~a_bits))")
    beside = (
        F.when(F.col("a_plain") & F.col("b_plain"), F.greatest("a_behind", "b_behind"))
        .when(F.col("a_plain"), F.col("a_behind")).when(F.col("b_plain"), F.col("b_behind")).otherwise(F.least("a_behind", "b_behind"))
    )
    size = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
    return size & ((common + beside) * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent)


def _side(side: str, *more: str, of: str = "") -> list[Column]:
    """The columns of a set as those of side ``side`` of a pair."""
    return [F.col(f"{of}node").alias(side), *[F.col(f"{of}{c}").alias(f"{side}_{c}") for c in (*BOUNDS, *more)]]


def _marks(hashes: DataFrame, cells: int) -> np.ndarray:
    """Which of ``cells`` places the hashes fall on, as packed bits; as such they also come to the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridextremes.llm.jaccard import _small

        own = np.zeros(cells, np.uint8)
        for batch in batches:
            own[batch.column(0).to_numpy() & (cells - 1)] = 1
        blocks = [k for k in range(0, cells, BLOCK) if own[k : k + BLOCK].any()]
        if blocks:
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int32()), pa.array([_small(own[k : k + BLOCK]) for k in blocks], pa.binary())],
                ["block", "counts"],
            )

    total = np.zeros(-(-cells // 8), np.uint8)
    for block, part in summed_arrays(hashes.mapInArrow(mark, "block int, counts binary"), "u4", _large, _bits).items():
        bits = np.frombuffer(zlib.decompress(part), np.uint8)
        total[block // 8 : block // 8 + len(bits)] = bits
    return total


def _sets(docs: DataFrame, text_col: str, wanted: DataFrame, words: int) -> DataFrame:
    """``node, hashes`` of the classes ``wanted``, made again from one of their texts.

    Texts that cannot be wanted are left out by a bitmap of fixed size, so texts
    are not shuffled; the join by digest then is exact.
    """
    text = F.col(f"`{text_col}`")
    shared = docs.sparkSession.sparkContext.broadcast(_marks(wanted.select("text_hash"), MARKS))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridextremes.llm.jaccard import shingle_set

        marks, seen = np.unpackbits(shared.value), set()
        for batch in batches:
            hits = marks[batch.column("text_hash").to_numpy() & (MARKS - 1)].astype(bool)
            texts = batch.column("text").filter(pa.array(hits))
            for k in range(0, len(texts), 256):
                sets = {}
                for t in texts.slice(k, 256):
                    hashes = shingle_set(t.as_py(), words)
                    digest = xxhash.xxh3_128_digest(hashes)
                    if digest not in seen:
                        seen.add(digest)
                        sets[digest] = hashes.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(sets), pa.binary()), pa.array(list(sets.values()), pa.binary())], ["digest", "hashes"])

    source = docs.select(text.cast("binary").alias("text"), text_hash(text).alias("text_hash"))
    made = source.mapInArrow(make, "digest binary, hashes binary")
    once = made.groupBy("digest").agg(F.first("hashes").alias("hashes"))
    written = materialise(wanted.join(once, "digest").select("node", "hashes"), "sets")
    shared.destroy()
    return written


class _Verifier:
    """Verifies candidate pairs on the whole sets, which are made when first needed."""

    def __init__(self, docs: DataFrame, text_col: str, classes: DataFrame, entries: DataFrame, words: int, percent: int):
        self.docs, self.text_col, self.words, self.percent = docs, text_col, words, percent
        self.classes = classes.select("node", "digest", "text_hash")
        rare = F.collect_list(F.when(F.col("key") % 2 == 0, F.col("key")))  # no more than a set has shingles
        self.nodes = materialise(entries.groupBy("node").agg(
            rare.alias("keys"), *[F.first(c).alias(c) for c in BOUNDS]), "nodes")
        self.sets: DataFrame | None = None

    def _promising(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose common rare shingles leave room for enough common shingles."""
        for x in ("a", "b"):
            pairs = pairs.join(self.nodes.select(*[F.col(c).alias(f"{x}_{c}") for c in self.nodes.columns]), F.col(x) == F.col(f"{x}_node"))
        return pairs.where(_possible(self.percent, F.size(F.array_intersect("a_keys", "b_keys")))).select("a", "b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` that are similar."""
        near = materialise(self._promising(pairs), "pairs")
        wanted = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("node"), "node", "left_anti")
        wanted = materialise(self.classes.join(wanted, "node", "left_semi"), "wanted")
        if not wanted.isEmpty():
            more = _sets(self.docs, self.text_col, wanted, self.words)
            self.sets = more if self.sets is None else self.sets.unionByName(more)
        if self.sets is None:
            return near
        return _verified(near, self.sets, self.percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b")), "b"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridextremes.llm.jaccard import similar

        for batch in batches:
            of = zip(batch.column("of_a"), batch.column("of_b"), strict=True)
            good = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in of]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(check, "a long, b long")


def _all_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Candidates: sets of two components with a common key that may share enough."""
    both = entries.select("key", "salt", *_side("a", "part")).join(
        _for_salts(entries.select("key", "salts", *_side("b", "part"))), ["key", "salt"])
    return both.where((F.col("a") < F.col("b")) & (F.col("a_part") != F.col("b_part")) & _possible(percent)).select("a", "b").distinct()


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                  percent: int = PERCENT, cells: int = CELLS, frequent: float = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """All links ``a, b`` between distinct sets, and the class ``node`` of each row (``number, id, n, node``)."""
    rows = indexed(docs, id_col, text_col, words, percent, cells, frequent)
    classes = _classes(rows)
    entries = _shared_keys(classes, percent)
    links = _Verifier(docs, text_col, classes, entries, words, percent).links(_all_pairs(entries.withColumn("part", F.col("node")), percent))
    return links, rows.join(classes.select("digest", "node"), "digest", "left").select("number", "id", "n", "node")


def _labels(entries: DataFrame, verifier: _Verifier, percent: int) -> DataFrame:
    """``node, part`` for the sets in ``entries``: the smallest node reachable by links.

    The groups of a key are not expanded into pairs. In each round, the most
    central ``LEADERS`` sets of a key that have not led yet are compared with the
    key's sets of other components; links join components, and keys left with
    one component are done. A set that has led was compared with all it could link
    to there. Central are sets whose keys have many members: an original rather
    than its edits. Once the pairs left are no more than a quarter of the index
    entries, or a round finds no link or hardly lessens them, they are all compared.
    """
    nodes = entries.select("node").distinct()
    live = entries.withColumn("part", F.col("node"))
    size = live.count()
    labels = materialise(nodes.withColumn("part", F.col("node")), "labels")
    before, fruitless = None, False
    while True:
        of_parts = live.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(
            F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("within"))
        left = of_parts.agg(F.sum(F.col("all") * F.col("all") - F.col("within"))).first()[0]
        left = (left or 0) / 2
        if not left:
            return labels
        last = left <= size / 4 or fruitless or (before is not None and left > 0.95 * before)
        before = left
        if last:
            pairs = _all_pairs(live, percent)
        else:
            led = materialise(_led(live), "led")
            ahead = (F.col("a_weight") > F.col("b_weight")) | ((F.col("a_weight") == F.col("b_weight")) & (F.col("a") < F.col("b")))
            pairs = led.select(*_side("b", "part", "weight"), F.explode("leaders").alias("l")).select(
                "*", *_side("a", "part", "weight", of="l.")).where(
                ahead & (F.col("a_part") != F.col("b_part")) & _possible(percent)).select(
                F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            live = led.where(~F.array_contains(F.col("leaders.node"), F.col("node"))).drop("leaders")
        links = verifier.links(pairs)
        known = labels.select(F.col("node").alias("a"), F.col("part").alias("pa"))
        joined = links.join(known, "a").join(known.withColumnsRenamed({"a": "b", "pa": "pb"}), "b")
        edges = materialise(joined.select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a != b").distinct(), "links")
        fruitless = edges.isEmpty()
        parts = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        merged = materialise(connected_components(edges, parts), "merged").withColumnsRenamed({"node": "part", "component": "to"})
        labels = materialise(labels.join(merged, "part", "left").select("node", F.coalesce("to", "part").alias("part")), "labels")
        if last:
            return labels
        mixed = live.drop("part").join(labels, "node")
        open_keys = mixed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.first("salts").alias("salts"))
        open_keys = _for_salts(open_keys.where("low != high").select("key", "salts"))
        live = materialise(mixed.join(open_keys, ["key", "salt"], "left_semi"), "live")


def _led(live: DataFrame) -> DataFrame:
    """``live`` with ``leaders``, the ``LEADERS`` most central sets of the row's key: first of every salt, then of these."""
    def first_of(rows: DataFrame, *keys: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("weight"), "node"))
        return rows.withColumn("place", place).where(F.col("place") <= LEADERS).drop("place")

    top = first_of(first_of(live, "key", "salt"), "key").groupBy("key").agg(
        F.collect_list(F.struct("node", "part", "weight", *BOUNDS)).alias("leaders"), F.first("salts").alias("salts"))
    return live.join(_for_salts(top), ["key", "salt"])


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, cells: int, frequent: float) -> DataFrame:
    """``id, n, text_hash, part`` of every row; ``part`` is the number of its component, null for empty sets."""
    rows = indexed(docs, id_col, text_col, words, percent, cells, frequent)
    classes = _classes(rows)
    entries = _shared_keys(classes, percent)
    labels = _labels(entries, _Verifier(docs, text_col, classes, entries, words, percent), percent)
    of_set = classes.select("digest", "node").join(labels, "node", "left").select(
        "digest", F.coalesce("part", "node").alias("part"))
    return rows.select("id", "n", "digest", "text_hash").join(of_set, "digest", "left").drop("digest")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                   percent: int = PERCENT, cells: int = CELLS, frequent: float = FREQUENT) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` of every row: the smallest id reachable by links.

    Two documents link when ``100 * intersection >= percent * union`` of their
    sets of ``words``-word shingles. Equal sets are one class, combined map-side,
    so copies never meet in pairs.

    A null or empty text has an empty set and is linked with nothing: its
    component is its own id. Very long texts take part in full. Sets are numbered by
    one of their rows, not by ids: rows that share an id are documents of their own,
    in one component only if their texts are, and rows that repeat belong to one
    component. A row without id takes part; a component without any id has the
    component null. An empty table gives an empty result; other columns are not
    read. Shingles are told apart by 64-bit hashes.
    """
    rows = materialise(_grouped(docs, id_col, text_col, words, percent, cells, frequent), "grouped")
    least = rows.where("part IS NOT NULL").groupBy("part").agg(F.min("id").alias("least"))
    # A component may hold many rows, so these are dealt over salts; the broadcast keys are KEY_SHARE at most.
    return hot_join(rows, least, ["part"], "left", max(SAMPLE, rows.count() // KEY_SHARE)).select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least")).alias("component_id"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                  percent: int = PERCENT, cells: int = CELLS, frequent: float = FREQUENT) -> DataFrame:
    """The row with the smallest id of each component of similar documents, all its columns as they are.

    Rows are decided, not ids: of rows with the smallest id in a component the one
    whose text has the smallest hash stays, of rows that repeat it entirely one. Null
    ids come last, so a component without ids keeps one row too. Every row whose
    text has no words stays, also when it repeats: it is similar to nothing.
    """
    rows = materialise(_grouped(docs, id_col, text_col, words, percent, cells, frequent), "grouped")
    copies = rows.where("n > 0").groupBy("part", "id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "copies"))
    stays = materialise(copies.groupBy("part").agg(best.alias("b")).select("b.id", "b.text_hash", "b.copies").unionByName(
        rows.where("n = 0").select("id", "text_hash", F.lit(1).alias("copies")).distinct()), "stays")
    given = docs.select(packed(docs)).withColumns({"id": F.col(f"row.`{id_col}`").cast("long"), "text_hash": text_hash(F.col(f"row.`{text_col}`"))})

    def among(some: DataFrame) -> DataFrame:
        same = given["id"].eqNullSafe(some["id"]) & (given["text_hash"] == some["text_hash"])
        return given.join(some, same, "left_semi")

    single = among(stays.where("copies = 1")).select("row")
    repeated = among(stays.where("copies > 1")).groupBy("id", "text_hash").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(repeated).select("row.*")
