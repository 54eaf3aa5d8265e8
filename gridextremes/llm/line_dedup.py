"""Repeated lines dropped by sorting their hashes; the result is a keep bitmap per document.

Hashes of the line keys are range-partitioned and sorted by document and position,
each partition streams the first document of every key, and what is dropped comes
back as run lengths of kept lines, so no text takes part in the sort. Only Spark's
own column functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise
from .common import WHITE, packed

MIN_CHARS = 10  # code points of the shortest key that can be dropped
HOT_SHARE = 200  # a key with more than about 1 / HOT_SHARE of the lines is salted
SAMPLE = 64  # one line in so many is looked at to find such keys
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit("".join(WHITE)))
    plain = F.length(bare) == F.octet_length(bare)  # ASCII only: the faster way to the same key
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def lines_of(text: Column) -> Column:
    """The lines of a text; a null text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``id``, ``body`` (hash of the whole text), ``pos`` and ``high``, ``low`` (128 bits of the key) of every long line."""
    text = docs[f"`{text_col}`"]
    lines = docs.select(
        docs[f"`{id_col}`"].alias("id"), text_hash(text).alias("body"),
        F.posexplode(F.transform(lines_of(text), line_key)).alias("pos", "key"),
    ).where(F.length("key") >= min_chars)
    # Two seeds: the hash of a constant goes before the key.
    return lines.select("id", "body", "pos", F.xxhash64("key").alias("high"), F.xxhash64(F.lit(1), "key").alias("low"))


def salted_keys(lines: DataFrame, hot_share: int, sample: int) -> DataFrame:
    """Keys that hold a large share of the lines, with their number of salts; fewer than ``hot_share`` rows.

    They are found on a part of the lines that follows from id and position. A key
    that is wrongly in or out only fills its range more or less: no answer depends on it.
    """
    part = lines.where(F.pmod(F.xxhash64("id", "body", "pos"), F.lit(sample)) == 0)
    fair = max(1.0, part.count() / hot_share)
    return (
        part.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fair)
        .select("high", "low", F.ceil(F.col("n") / fair).cast("int").alias("salts"))
    )


def dropped_lines(lines: DataFrame, hot_share: int = HOT_SHARE, sample: int = SAMPLE) -> DataFrame:
    """``id``, ``body``, ``pos`` of the lines whose key occurs in a document of smaller id.

    The sort key is (hash, salt, id, position). Nearly all keys have salt 0; the
    rows of a hot key are dealt over its salts by id, so they fill several ranges.
    What one range says about the first document of a salted key is put right by
    the smallest id over all its salts, combined map-side. The two broadcast
    tables have fewer than ``hot_share`` rows each.
    """
    hot = materialise(salted_keys(lines, hot_share, sample), "hot_lines")
    salted = lines.join(F.broadcast(hot), ["high", "low"], "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0)).cast("int")
    ).drop("salts")
    carried = lines.join(F.broadcast(hot), ["high", "low"]).groupBy("high", "low").agg(F.min("id").alias("carry"))
    in_order = W.partitionBy("high", "low", "salt").orderBy(F.col("id").asc_nulls_last(), "pos")
    first = F.first("id").over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow))
    seen = (
        salted.repartitionByRange("high", "low", "salt").withColumn("first", first)
        .join(F.broadcast(carried), ["high", "low"], "left")
    )
    return seen.where(~F.col("id").eqNullSafe(F.least("first", "carry"))).select("id", "body", "pos")


def kept_runs(positions: Column, n_lines: Column) -> Column:
    """Run lengths of kept lines, as (start, length), from the sorted positions of dropped ones."""
    start = F.concat(F.array(F.lit(0)), F.transform(positions, lambda p: p + 1))
    stop = F.concat(positions, F.array(n_lines))
    runs = F.zip_with(start, stop, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                 hot_share: int = HOT_SHARE, sample: int = SAMPLE) -> DataFrame:
    """One row per (id, text) that loses lines: ``id``, ``body``, ``n_dropped``, ``dropped`` (sorted positions).

    A key is a line without ASCII white space at both ends and with A-Z lower-cased.
    A key of at least ``min_chars`` code points that occurs in two or more documents
    loses all its lines except those in the document of the smallest id.

    The positions of a document are as many as its lines at most, and only numbers.
    Keys are compared by 128 bits of two hashes.

    A document is its id: rows that share an id are one document, so a line found
    only in them stays in all of them. A null id is one document too and comes last.
    Null and empty texts have one empty line, which is never dropped; an empty table
    gives an empty result; extra columns are not read. A text of any length is split
    in its own task and travels as hashes.
    """
    lines = materialise(line_table(docs, id_col, text_col, min_chars), "lines")
    return (
        dropped_lines(lines, hot_share, sample).groupBy("id", "body")
        .agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
        .select("id", "body", F.size("dropped").alias("n_dropped"), "dropped")
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                           hot_share: int = HOT_SHARE, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: ``row`` (all its columns), ``n_lines``, ``n_dropped``, ``keep`` and ``kept_text``.

    ``keep`` is the bitmap of kept lines in runs (start, length), ``kept_text`` the
    kept lines joined by a line feed. Rules and odd inputs as in ``keep_bitmaps``;
    repeated rows all lose the same lines, extra columns of any name stay inside ``row``.
    """
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars, hot_share, sample)
    text = F.col(f"row.`{text_col}`")
    rows = docs.select(packed(docs)).withColumns({"id": F.col(f"row.`{id_col}`"), "body": text_hash(text)})
    same = rows["id"].eqNullSafe(bitmaps["id"]) & (rows["body"] == bitmaps["body"])
    joined = rows.join(bitmaps, same, "left").select("row", "n_dropped", "dropped")
    lines = lines_of(text)
    none = F.array().cast("array<int>")
    parts = joined.withColumn("n_lines", F.size(lines)).withColumn(
        "keep", kept_runs(F.coalesce("dropped", none), F.col("n_lines"))
    )
    return parts.select(
        "row", F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep",
        F.when(F.col("dropped").isNull(), F.coalesce(text, F.lit(""))).otherwise(
            F.array_join(F.flatten(F.transform("keep", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
        ).alias("kept_text"),
    )
