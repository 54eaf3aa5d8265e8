"""Nearest neighbours by inner product with a vantage-point tree per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

LEAF = 128
SHARD_ROWS = 8192  # rows a shard has about
QUERY_BLOCK = 1024  # queries that walk a tree together
NEAREST = 20
SLACK = 1e-6  # of distances of scaled vectors, for rounding


class Tree:
    """Vantage-point tree over the distinct vectors of a shard.

    The largest inner product becomes the smallest distance by one more component
    that brings all vectors to the same length ``radius``; a query has 0 there.
    Each inner node keeps its vantage point and the range of distances from it to
    either child. Ids of one vector are kept together, the smallest ``keep`` of
    them: no more can be among the nearest ``keep - 1`` and the query itself.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        kinds, inverse = np.unique(vectors, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        by = np.argsort(inverse, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(kinds)))])
        self.members = [ids[by[a:b][:keep]] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.count = np.array([len(m) for m in self.members])
        self.scale = max(float(np.abs(kinds).max()), np.finfo(float).tiny)
        self.vectors = kinds
        scaled = kinds / self.scale
        norms = np.einsum("ij,ij->i", scaled, scaled)
        self.radius2 = float(norms.max())
        self.points = np.column_stack([scaled, np.sqrt(np.maximum(self.radius2 - norms, 0))])
        self.order = np.arange(len(kinds))
        self.nodes: list[tuple] = []  # (start, stop) or (vantage, (low, high, child), (low, high, child))
        self.leaf = leaf
        self._build(0, len(kinds))

    def _build(self, start: int, stop: int) -> int:
        at = len(self.nodes)
        self.nodes.append((start, stop))
        if stop - start <= self.leaf:
            return at
        own = self.order[start:stop]
        far = np.linalg.norm(self.points[own] - self.points[own].mean(axis=0), axis=1)
        vantage = int(own[far.argmax()])
        distance = np.linalg.norm(self.points[own] - self.points[vantage], axis=1)
        by = np.argsort(distance, kind="stable")
        self.order[start:stop], distance = own[by], distance[by]
        half = (stop - start) // 2
        inner = self._build(start, start + half)
        outer = self._build(start + half, stop)
        self.nodes[at] = (vantage, (distance[0], distance[half - 1], inner), (distance[half], distance[-1], outer))
        return at

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per query its best ids and exact scores: (query index, ids, scores), ``k`` each.

        ``own`` are the ids to leave out. A child is skipped when the triangle
        inequality puts all of it ``1 / factor`` times as far as the k-th nearest
        so far, or farther: at factor 1 nothing nearer can be in it.
        """
        q = np.column_stack([queries / self.scale, np.zeros(len(queries))])
        lengths = np.einsum("ij,ij->i", q, q)
        state = _Best(len(queries), k, self.count)
        self._leaf_first(q, lengths, state)
        stack = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while stack:
            node, who, bound = stack.pop()
            alive = bound * factor <= state.reach[who] + SLACK
            who = who[alive]
            if not len(who):
                continue
            found = self.nodes[node]
            if len(found) == 2:
                self._scan(node, who, q, lengths, state)
                continue
            vantage, *children = found
            distance = np.sqrt(np.maximum(lengths[who] + self.radius2 - 2 * (q[who] @ self.points[vantage]), 0))
            for low, high, child in children:
                stack.append((child, who, np.maximum(np.maximum(low - distance, distance - high), 0)))
        for i in range(len(queries)):
            yield (i, *self._ranked(queries[i], own[i], state.kinds(i), k))

    def _leaf_first(self, q: np.ndarray, lengths: np.ndarray, state: _Best) -> None:
        """Take every query to the leaf that its vantage points send it to, for a first reach."""
        stack = [(0, np.arange(len(q)))]
        while stack:
            node, who = stack.pop()
            if not len(who):
                continue
            found = self.nodes[node]
            if len(found) == 2:
                self._scan(node, who, q, lengths, state)
                continue
            vantage, (_, high, inner), (low, _, outer) = found
            distance = np.sqrt(np.maximum(lengths[who] + self.radius2 - 2 * (q[who] @ self.points[vantage]), 0))
            near = distance <= (low + high) / 2
            stack += [(inner, who[near]), (outer, who[~near])]

    def _scan(self, node: int, who: np.ndarray, q: np.ndarray, lengths: np.ndarray, state: _Best) -> None:
        start, stop = self.nodes[node]
        todo = who[state.first_leaf[who] != node]
        if len(todo):
            kinds = self.order[start:stop]
            square = lengths[todo][:, None] + self.radius2 - 2 * (q[todo] @ self.points[kinds].T)
            state.add(todo, kinds, np.sqrt(np.maximum(square, 0)))
            fresh = todo[state.first_leaf[todo] < 0]
            state.first_leaf[fresh] = node

    def _ranked(self, query: np.ndarray, own: int, kinds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = inner_product(self.vectors[kinds], query)
        ids = np.concatenate([self.members[j] for j in kinds]) if len(kinds) else np.empty(0, np.int64)
        each = np.repeat(scores, self.count[kinds])
        ids, each = ids[ids != own], each[ids != own]
        best = np.lexsort((ids, -each))[:k]
        return ids[best], each[best]


class _Best:
    """The nearest distinct vectors of each query so far, with room for ties and rounding."""

    def __init__(self, queries: int, k: int, count: np.ndarray):
        self.k = k + 1  # one may be the query itself
        self.reach = np.full(queries, np.inf)
        self.first_leaf = np.full(queries, -1)
        self.count = count
        self.found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(queries)]
        self.near = np.full((queries, self.k), np.inf)

    def add(self, who: np.ndarray, kinds: np.ndarray, distance: np.ndarray) -> None:
        merged = np.concatenate([self.near[who], distance], axis=1)
        self.near[who] = np.partition(merged, self.k - 1, axis=1)[:, : self.k]
        self.reach[who] = self.near[who].max(axis=1)
        close = distance <= (self.reach[who] + SLACK)[:, None]
        for row in np.flatnonzero(close.any(axis=1)).tolist():
            self.found[who[row]].append((distance[row][close[row]], kinds[close[row]]))

    def kinds(self, i: int) -> np.ndarray:
        if not self.found[i]:
            return np.empty(0, np.int64)
        distance = np.concatenate([d for d, _ in self.found[i]])
        return np.concatenate([j for _, j in self.found[i]])[distance <= self.reach[i] + SLACK]


def inner_product(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed component by component, so that equal vectors get equal bits."""
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        total += vectors[:, j] * query[j]
    return total


def usable(vector: Column) -> Column:
    """Whether a vector has finite components only, of which one is not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, k: int = NEAREST, factor: float = 1.0, id_col: str = "vec_id",
            vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors of largest inner product for each query.

    ``queries`` says which rows are queries; every row but the query's own is a
    candidate. Vectors are dealt into shards of about ``shard_rows`` by a hash of
    their id, so a vector that very many rows share is spread evenly. The rows of
    a shard reach one task sorted, vectors before queries: it builds the tree,
    then takes the queries block by block, holding one shard and one block. Each
    shard gives its best ``k`` per query, and their best ``k`` win.
    ``factor`` above 1 skips more and may miss some, the more the more the lengths
    of the vectors differ; 1 is exact.

    Null or zero vectors and those with a null or non-finite component take no
    part. Vectors meet those of their own length only. Ties go to the smaller id;
    of rows
    that repeat an id the first vector counts; a null id takes no part. With fewer
    candidates than ``k`` all are given. An empty table gives an empty result.
    """
    if factor < 1:
        raise ValueError(f"factor is 1 or more: {factor}")
    vector = F.col(f"`{vector_col}`")
    good = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), vector.cast("array<double>").alias("v"),
        F.coalesce(queries, F.lit(False)).alias("query"),
    ).where(F.col("id").isNotNull() & usable(F.col("v")))
    good = materialise(good.withColumn("dim", F.size("v")), "vectors")
    shards = max(1, -(-good.count() // shard_rows))
    candidates = good.select(
        F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "dim", F.lit(0).alias("kind"), "id", "v")
    # The query set goes to every shard: queries x shards rows, not queries x candidates.
    asked = good.where("query").select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", F.lit(1).alias("kind"), "id", "v")
    sorted_rows = candidates.unionByName(asked).repartition(2 * shards, "shard", "dim").sortWithinPartitions(
        "shard", "dim", "kind", "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridextremes.llm.vantage import Tree, runs

        tree, shard, kept = None, None, []
        for (of, kind), ids, every in runs(batches, block):
            if kind == 0:
                kept = kept if of == shard else []
                kept.append((ids, every))
                tree, shard = None, of
            elif of == shard:
                if tree is None:
                    tree = Tree(np.concatenate([i for i, _ in kept]), np.concatenate([v for _, v in kept]), k + 1)
                    kept = []
                for i, found, scores in tree.search(every, ids, k, factor):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), ids[i])), pa.array(found), pa.array(scores)], ["query_id", "vec_id", "score"])

    found = sorted_rows.mapInArrow(search, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Stretches of at most ``most`` sorted rows of one shard, length and kind; of a repeated id the first row only."""
    last = None
    for batch in batches:
        keys = np.column_stack([batch.column(c).to_numpy() for c in ("shard", "dim", "kind")])
        ids = batch.column("id").to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
            if a == b:
                continue
            key = ((int(keys[a, 0]), int(keys[a, 1])), int(keys[a, 2]))
            new = np.concatenate([[last != (key, ids[a])], ids[a + 1 : b] != ids[a : b - 1]])
            last = (key, ids[b - 1])
            flat = batch.column("v").slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            every = flat.reshape(b - a, -1)[new]
            own = ids[a:b][new]
            for k in range(0, len(own), most):
                yield key, own[k : k + most], every[k : k + most]
