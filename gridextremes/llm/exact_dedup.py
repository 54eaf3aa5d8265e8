"""Exact duplicates by sorting contents.

Sampled splitters range-partition the normalised texts, each partition is sorted
(externally, by Spark's sort), so equal texts become neighbours, and a window over
full texts decides who stays. Only Spark's own column functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import packed, without_white

HEAD = 32  # code points of the normalised text that lead the sort key
HOT_SHARE = 200  # a text with more than 1 / HOT_SHARE of all rows is hot


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                hot_share: int = HOT_SHARE) -> DataFrame:
    """One row per row of ``docs``: ``row`` (all its columns), ``keep_id``, ``group_size``, ``kept``, ``normalised``.

    Texts are equal when they are identical without ASCII white space. Of equal
    texts the row with the most code points stays, then the one with the smallest
    id; exactly one row per group has ``kept``, also when whole rows repeat.

    The range key is the head of the normalised text and its 64-bit hash: the
    hash parts texts that begin alike, so a shared opening is no hot range. The
    window compares whole texts. Splitters are sampled from that short key only.
    Texts held by more than ``1 / hot_share`` of the rows would still fill one
    range; there are fewer than ``hot_share`` of them. They are found by a count
    combined map-side and decided by an aggregate combined map-side instead, again
    on whole texts; their few leaders are broadcast: fewer than ``hot_share``
    texts, which together are at most ``hot_share`` times the mean text.

    Null text counts as empty, empty texts equal each other, a null id comes last
    among equals, an empty table gives an empty result, repeated rows are members
    of their group, and extra columns of any name stay inside ``row``.
    """
    text = F.col(f"row.`{text_col}`")
    rows = docs.select(packed(docs)).withColumn("hash", F.xxhash64(without_white(text)))
    fair = max(1.0, docs.count() / hot_share)
    hot = [r["hash"] for r in rows.groupBy("hash").count().where(F.col("count") > fair).collect()]
    rest = _by_sorting(rows.where(~F.col("hash").isin(hot)) if hot else rows, text, id_col)
    if not hot:
        return rest
    return rest.unionByName(_by_leader(rows.where(F.col("hash").isin(hot)), text, id_col))


def _by_sorting(rows: DataFrame, text, id_col: str) -> DataFrame:
    head = F.substring(without_white(text), 1, HEAD)
    ranged = rows.withColumn("head", head).repartitionByRange("head", "hash")
    equal = W.partitionBy("head", "hash", "normalised").orderBy(
        F.col("chars").desc(), F.col("id").asc_nulls_last()
    )
    group = equal.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        ranged.withColumn("normalised", without_white(text))
        .withColumn("chars", F.coalesce(F.length(text), F.lit(0)))
        .withColumn("id", F.col(f"row.`{id_col}`"))
        .select(
            "row", F.first("id").over(group).alias("keep_id"),
            F.count(F.lit(1)).over(group).alias("group_size"),
            (F.row_number().over(equal) == 1).alias("kept"), "normalised",
        )
    )


def _by_leader(rows: DataFrame, text, id_col: str) -> DataFrame:
    rows = rows.select(
        "row", "hash", without_white(text).alias("normalised"),
        F.coalesce(F.length(text), F.lit(0)).alias("chars"), F.col(f"row.`{id_col}`").alias("id"),
    )
    longest = rows.groupBy("hash", "normalised").agg(
        F.count(F.lit(1)).alias("group_size"), F.max("chars").alias("most")
    )
    leaders = (
        rows.join(F.broadcast(longest), ["hash", "normalised"]).where(F.col("chars") == F.col("most"))
        .groupBy("hash", "normalised", "group_size", "most").agg(F.min("id").alias("keep_id"))
    )
    judged = rows.join(F.broadcast(leaders), ["hash", "normalised"]).withColumn(
        "first", (F.col("chars") == F.col("most")) & F.col("id").eqNullSafe(F.col("keep_id"))
    )
    out = ("row", "keep_id", "group_size", "kept", "normalised")
    # Rows that repeat the leader's id and length: one of them stays.
    ties = judged.where("first").withColumn("kept", F.row_number().over(
        W.partitionBy("hash", "normalised").orderBy("id")) == 1)
    return judged.where("not first").withColumn("kept", F.lit(False)).select(*out).unionByName(ties.select(*out))
