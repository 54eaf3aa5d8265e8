"""Merging slabs into a cube, and what a cube lacks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


KEYS = ["dt", "lat", "lon"]


def one_per_day(slab: DataFrame) -> DataFrame:
    """One row per day and cell: of repeated ones a known value, then the smallest.

    Combined map-side, so a day that lands very often is no larger than the grid.
    """
    rest = [c for c in slab.columns if c not in KEYS]
    values = [c for c in ("sst", *rest) if c in rest]
    best = F.min(F.struct(F.col(values[0]).isNull().alias("_unknown"), *dict.fromkeys(values)))
    return slab.groupBy(*KEYS).agg(best.alias("_best")).select(
        *[F.col(c) if c in KEYS else F.col("_best")[c].alias(c) for c in slab.columns]
    )


def new_days(cube: DataFrame, slab: DataFrame) -> DataFrame:
    """Rows of a slab for days the cube does not have at all, one per day and cell.

    A day present in the cube wins as a whole, for every cell.
    """
    have = cube.select("dt").distinct()
    return one_per_day(slab.join(have, "dt", "left_anti").select(*slab.columns))


def merge_slab(cube: DataFrame, slab: DataFrame) -> DataFrame:
    return cube.unionByName(new_days(cube, slab))


def extent(cube: DataFrame) -> DataFrame:
    """First and last day, number of days, cells' box."""
    per_day = cube.groupBy("dt").agg(
        F.min("lon").alias("x0"), F.min("lat").alias("y0"),
        F.max("lon").alias("x1"), F.max("lat").alias("y1"),
    )
    return per_day.agg(
        F.min("dt").alias("first_day"), F.max("dt").alias("last_day"),
        F.count(F.lit(1)).alias("n_days"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def missing_ranges(cube: DataFrame, start: date, end: date) -> DataFrame:
    """Parts of a range before and after the cube; holes inside do not count."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    first, last = F.col("first_day"), F.col("last_day")
    ranges = F.when(
        first.isNull(), F.array(F.struct(lo.alias("start"), hi.alias("end")))
    ).otherwise(F.array(
        F.struct(lo.alias("start"), F.least(hi, F.date_sub(first, 1)).alias("end")),
        F.struct(F.greatest(lo, F.date_add(last, 1)).alias("start"), hi.alias("end")),
    ))
    span = cube.agg(F.min("dt").alias("first_day"), F.max("dt").alias("last_day"))
    return span.select(F.explode(ranges).alias("r")).select("r.*").where(F.col("start") <= F.col("end"))


def missing_days(cube: DataFrame, start: date, end: date) -> DataFrame:
    """Days of a range without any row, holes included."""
    spark = cube.sparkSession
    wanted = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("dt")
    )
    return wanted.join(cube.select("dt").distinct(), "dt", "left_anti")


def years(cube: DataFrame) -> DataFrame:
    return cube.select(F.year("dt").alias("year")).distinct()


def covers_window(cube: DataFrame, today: date, days: int = 90, slack: int = 2) -> DataFrame:
    """One row: does the cube reach from ``days`` ago to at most ``slack`` days ago?"""
    now = F.lit(today).cast("date")
    return cube.agg(F.coalesce(
        (F.min("dt") <= F.date_sub(now, days)) & (F.max("dt") >= F.date_sub(now, slack)), F.lit(False)
    ).alias("covered"))
