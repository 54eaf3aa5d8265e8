"""Mixing sources to target weights by fitting budgets with whole documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise
from .common import packed, word_count

MAX_REPEATS = 3
BUCKETS = 256
EXACT = 1 << 15  # words of a budget that the dynamic programme fits


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], budget: float,
            most: float = MAX_REPEATS) -> dict[str | None, float]:
    """Each source's share of ``budget`` by weight, at most ``most`` times its size.

    What a source cannot take is shared again by weight among the others until
    none is above; if all are full, the rest of the budget stays unused.
    """
    out: dict[str | None, float] = {}
    open_ = list(sizes)
    left = float(budget)
    while open_:
        total = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / total for s in open_}
        full = [s for s in open_ if share[s] > most * sizes[s]]
        if not full:
            out.update(share)
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def fit_budget(sizes: list[int], counts: list[int], budget: float, exact: int = EXACT) -> list[int]:
    """How many documents of each size to take so that their sizes sum near ``budget``.

    The bulk, all but ``exact`` words of the budget, is spread evenly over the
    sizes, carrying what a size cannot use to the next smaller one. A bounded
    knapsack over the documents left (reachable sums as bits of one integer,
    counts split in powers of two) then meets the rest as closely as any choice
    among them can. Sizes of 0 are not taken.
    """
    want = max(0, round(budget))
    order = sorted((s, c, i) for i, (s, c) in enumerate(zip(sizes, counts, strict=True)) if s > 0 and c > 0)[::-1]
    taken = [0] * len(sizes)
    total = sum(s * c for s, c, _ in order)
    if want >= total:
        for _, c, i in order:
            taken[i] = c
        return taken
    bulk = max(0, want - exact)
    carry = 0.0
    for s, c, i in order:
        carry += s * c * bulk / total
        taken[i] = min(c, int(carry // s))
        carry -= taken[i] * s
    rest = want - sum(s * taken[i] for s, _, i in order)
    for s, c, i in order:  # sizes that ran out leave more than the programme's part
        more = min(c - taken[i], max(0, rest - exact) // s)
        taken[i] += more
        rest -= more * s
    left = [(s, c - taken[i], i) for s, c, i in order if c > taken[i]]
    if rest <= 0 or not left:
        return taken
    limit = 2 * rest  # a sum beyond is farther off than taking nothing
    mask = (1 << (limit + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int, int]] = []
    for s, c, i in left:
        c = min(c, limit // s)
        part = 1
        while c > 0:
            n = min(part, c)
            grown = (reach | (reach << (n * s))) & mask
            if grown != reach:
                steps.append((n, s, i, reach))
                reach = grown
            c -= n
            part *= 2
        if reach >> rest & 1:
            break
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    best = below
    if above:
        over = rest + 1 + ((above & -above).bit_length() - 1)
        best = over if over - rest < rest - below else below
    for n, s, i, before in reversed(steps):
        if not before >> best & 1:
            taken[i] += n
            best -= n * s
    return taken


def _key(source: Column) -> list[Column]:
    """A source as two columns without null, so that grouping, windows and joins share one shuffle."""
    return [source.isNull().alias("nameless"), F.coalesce(source, F.lit("")).alias("named")]


KEY = ["nameless", "named"]


def shared_targets(sizes: DataFrame, budget: float, most: float = MAX_REPEATS) -> DataFrame:
    """``targets`` over a table: ``target`` beside ``source_size`` and ``weight`` of every source.

    Every round is one aggregate over the table, until it finds no further source
    above its limit; only sums go to the driver.
    """
    size, weight = F.col("source_size") * F.lit(most), F.col("weight")
    shares: list[Column] = [F.lit(float("-inf")), F.lit(float("-inf"))]
    filled = -1
    while True:
        full = F.greatest(*shares) > size
        r = sizes.agg(F.sum(F.when(~full, weight)).alias("total"), F.coalesce(F.sum(F.when(full, size)), F.lit(0)).alias("spent"),
                      F.count_if(full).alias("full"), F.count_if(weight.isNull()).alias("unweighed")).first()
        if r["unweighed"]:
            raise ValueError(f"{r['unweighed']} sources without a weight")
        if r["full"] == filled or r["total"] is None:
            return sizes.withColumn("target", F.when(full, size.cast("double")).otherwise(shares[-1]))
        filled = r["full"]
        shares.append(F.lit(float(budget) - float(r["spent"])) * weight / F.lit(float(r["total"])))


def mix_sources(docs: DataFrame, weights: DataFrame | dict[str | None, float], source_col: str = "source",
                id_col: str = "doc_id", size: Column | None = None, text_col: str = "text", share: float = 1.0,
                seed: int = 7, most: int = MAX_REPEATS) -> DataFrame:
    """``row``, ``size``, ``source_size``, ``target`` and ``copies`` of every row.

    The budget is ``share`` of all sizes. A source takes each document as often
    as its target goes into its size; what remains is fitted with whole documents
    by their exact sizes. Documents of one size are equivalent to the fit, so
    those first by a seeded hash are taken: reruns agree. No document is taken
    more than ``most`` times.

    Sizes are counted per source, size and hash bucket, combined map-side; the
    fit sees one row per size of its source. The rank of a document is the count
    of the buckets before plus its rank inside its bucket, so a size or source
    with a third of all rows is still spread over ``BUCKETS`` tasks. ``weights``
    is a table ``source, weight`` with one row per source, of any number: sources
    stay in tables. For few sources it may be a dict, which is worked on in the
    driver. A source without a weight raises.

    Null text has size 0, a document of size 0 gets the whole repeats only, a
    null source is a source of its own, rows that repeat count each on their own,
    an empty table gives an empty result, extra columns stay in ``row``.
    """
    spark = docs.sparkSession
    size = word_count(F.col(f"row.`{text_col}`")) if size is None else size
    rows = docs.select(packed(docs)).withColumn("size", size)
    rows = rows.select("row", "size", *_key(F.col(f"row.`{source_col}`")))
    rows = rows.withColumn("hash", F.xxhash64(F.lit(seed), F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")))
    rows = rows.withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)).cast("int"))
    lengths = materialise(rows.groupBy(*KEY, "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sizes = lengths.groupBy(*KEY).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    if isinstance(weights, dict):
        found = {None if r["nameless"] else r["named"]: r["source_size"] for r in sizes.collect()}
        target = targets(found, {s: weights[s] for s in found}, share * sum(found.values()), most)
        plan = spark.createDataFrame([(s is None, s or "", found[s], target[s]) for s in found],
                                     "nameless boolean, named string, source_size long, target double")
    else:
        weighed = materialise(sizes.join(weights.select(*_key(F.col("source")), "weight"), KEY, "left"), "sources")
        plan = shared_targets(weighed, share * (weighed.agg(F.sum("source_size")).first()[0] or 0), most).drop("weight")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        from gridextremes.llm.mixing import fit_budget

        first = pdf.iloc[0]
        whole, target = int(first["source_size"]), float(first["target"])
        pdf["repeats"] = repeats = int(target // whole) if whole else 0
        pdf["take"] = fit_budget(pdf["size"].tolist(), pdf["n"].tolist(), target - repeats * whole)
        return pdf[["nameless", "named", "size", "source_size", "target", "repeats", "take"]]

    takes = lengths.groupBy(*KEY, "size").agg(F.sum("n").alias("n")).join(plan, KEY).groupBy(*KEY).applyInPandas(
        fit, "nameless boolean, named string, size long, source_size long, target double, repeats int, take long")
    before = F.sum("n").over(W.partitionBy(*KEY, "size").orderBy("bucket").rowsBetween(
        W.unboundedPreceding, W.currentRow)) - F.col("n")
    quota = lengths.withColumn("before", before).drop("n").join(takes, [*KEY, "size"])
    rank = F.row_number().over(W.partitionBy(*KEY, "size", "bucket").orderBy("hash", f"row.`{id_col}`"))
    return (
        rows.withColumn("rank", rank).join(quota, [*KEY, "size", "bucket"])
        .withColumn("copies", F.col("repeats") + (F.col("before") + F.col("rank") <= F.col("take")).cast("int"))
        .select("row", "size", "source_size", "target", "copies")
    )


def weight_table(docs: DataFrame, source_col: str = "source", cycle: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """``source, weight``: sources by code point, null last, weighed by ``cycle`` in turn.

    Sources are dealt out by range and numbered within their partition; the
    driver gets one count per partition.
    """
    order = F.col("source").asc_nulls_last()
    found = docs.select(F.col(f"`{source_col}`").alias("source")).distinct().repartitionByRange(order).sortWithinPartitions(order)
    placed = materialise(found.withColumn("place", F.monotonically_increasing_id()), "placed")
    part, row = F.shiftrightunsigned("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    starts, start = [], 0
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):
        starts.append((r["part"], start))
        start += r["count"]
    table = docs.sparkSession.createDataFrame(starts, "part long, start long")
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), ((F.col("start") + row) % len(cycle) + 1).cast("int"))
    return placed.withColumn("part", part).join(F.broadcast(table), "part").select("source", weight.alias("weight"))


def cycled_weights(docs: DataFrame, source_col: str = "source", cycle: tuple[float, ...] = (1, 2, 3)) -> dict:
    """``weight_table`` as a dict, for few sources: all of them go to the driver."""
    return {r["source"]: r["weight"] for r in weight_table(docs, source_col, cycle).collect()}
