"""Global numbering without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .skew import keyed_join


def number_by_key(df: DataFrame, key: str, out: str, block: int = 1_000_000) -> DataFrame:
    """Rank rows 1, 2, … by a unique non-negative integer key.

    Keys fall into blocks of ``block`` values. Ranks come from the row number
    inside the block plus the rows of all blocks before; only the block counts,
    one row per block, are ordered together.
    """
    blocked = df.withColumn("_block", F.floor(F.col(key) / block))
    counts = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(
        "_block",
        (F.sum("_n").over(W.orderBy("_block")) - F.col("_n")).alias("_before"),
    )
    within = F.row_number().over(W.partitionBy("_block").orderBy(key))
    return (
        blocked.join(before, "_block")
        .withColumn(out, (F.col("_before") + within).cast("long"))
        .drop("_block", "_before")
    )


def number_by_cell(df: DataFrame, ilat: str, ilon: str, within: str, out: str) -> DataFrame:
    """Number rows in (ilat, ilon, within) order, ``within`` being 1..n per cell.

    Counts per cell, then per row of cells, are summed up separately: no window
    holds more than one axis of the grid.
    """
    per_cell = df.groupBy(ilat, ilon).agg(F.count(F.lit(1)).alias("_n"))
    in_row = per_cell.withColumn(
        "_in_row", F.sum("_n").over(W.partitionBy(ilat).orderBy(ilon)) - F.col("_n")
    )
    per_row = per_cell.groupBy(ilat).agg(F.sum("_n").alias("_m"))
    rows_before = per_row.select(
        ilat, (F.sum("_m").over(W.orderBy(ilat)) - F.col("_m")).alias("_rows")
    )
    offset = in_row.join(rows_before, ilat).select(
        ilat, ilon, (F.col("_rows") + F.col("_in_row")).alias("_before")
    )
    return (
        keyed_join(df, offset, [ilat, ilon])
        .withColumn(out, (F.col("_before") + F.col(within)).cast("long"))
        .drop("_before")
    )
