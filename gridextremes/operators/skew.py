"""Joins and percentiles that do not gather a hot key or a whole column in one task, or a table in the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
ACCURACY = 10_000
TASK_ROWS = 1_000_000


def tasks_for(spark: SparkSession, rows: int | None) -> int:
    """Number of tasks that hold about ``TASK_ROWS`` rows each, one per core at least.

    Left to itself, Spark merges shuffled rows into a task per core by their
    compressed size, so rows that sort or unpack large fill a task with the data.
    """
    return max(spark.sparkContext.defaultParallelism, math.ceil((rows or 0) / TASK_ROWS))


def keyed_join(a: DataFrame, b: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """Join of two tables that grow with the data: both are dealt by key, neither is broadcast.

    Spark takes a table for as large as its compressed file and does not count
    exploded rows, so by itself it sends tables through the driver that unpack to
    hundreds of times the broadcast threshold.
    """
    return a.join(b.hint("merge"), keys, how)


def hot_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join where one key may hold a large share of ``big``.

    Keys with more than ``hot_rows`` rows in ``big`` are counted first (combined
    map-side); their rows are spread over several salts and the matching rows of
    ``small`` repeated once per salt. All other keys have the single salt 0. The
    table of hot keys is broadcast: it has at most rows / ``hot_rows`` rows.
    ``how`` is inner, left, left_semi or left_anti.
    """
    hot = (
        big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    )
    # The salt follows from the row itself, so a repeated task gives the same one.
    spread = big.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNull(), 0)
        .otherwise(F.pmod(F.xxhash64(*big.columns), F.col("_salts")).cast("int")),
    ).drop("_salts")
    repeated = small.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_salts")
    return keyed_join(spread, repeated, [*keys, "_salt"], how).drop("_salt")


def exact_percentile(df: DataFrame, column: str, p: float, out: str) -> DataFrame:
    """One row with the linearly interpolated percentile over a whole table.

    An approximate pass with a bounded rank error gives a narrow bracket around
    the wanted ranks. Only the distinct values inside it, about ``n / 2500`` at
    most, are ordered together; equal values are counted map-side.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    slack = 2.0 / ACCURACY
    # Below this number of rows the bracket could be narrower than one rank.
    few = F.col("n") <= 4 / slack
    head = values.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("v").alias("least"), F.max("v").alias("most"),
        F.percentile_approx("v", F.lit(max(0.0, p - slack)), ACCURACY).alias("lo"),
        F.percentile_approx("v", F.lit(min(1.0, p + slack)), ACCURACY).alias("hi"),
    ).select(
        "n",
        F.when(F.lit(p <= slack) | few, F.col("least")).otherwise(F.col("lo")).alias("lo"),
        F.when(F.lit(p >= 1 - slack) | few, F.col("most")).otherwise(F.col("hi")).alias("hi"),
    )
    lo, hi, n = (head.select(c).scalar() for c in ("lo", "hi", "n"))
    kept = (
        values.select(F.when(F.col("v") < lo, F.lit(None)).otherwise(F.col("v")).alias("v"))
        .where(F.col("v").isNull() | (F.col("v") <= hi))
        .groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    )
    ranked = kept.select(
        "v", "c",
        F.sum("c").over(W.orderBy(F.col("v").asc_nulls_first()).rowsBetween(
            W.unboundedPreceding, W.currentRow)).alias("upto"),
    ).select("v", (F.col("upto") - F.col("c")).alias("first"), (F.col("upto") - 1).alias("last"))
    position = (n - 1) * F.lit(p)
    below = F.floor(position)

    def at(rank):
        return F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("v")))

    low = at(below)
    high = F.coalesce(at(below + 1), low)
    return ranked.agg((low + (high - low) * (F.max(position) - F.max(below))).alias(out))
