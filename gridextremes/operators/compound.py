"""Days on which one variable is high and another one low."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import cell_key
from .skew import tasks_for

# --- fixed values: classes of compound days per cell --------------------------
DAY_CLASSES = [(1, 5), (6, 10), (11, 20), (21, 40)]
# ----------------------------------------------------------------------------


def compound_days(a: DataFrame, b: DataFrame, hot: float = 0.9, low: float = 0.1,
                  a_value: str = "sst", b_value: str = "sal") -> DataFrame:
    """Flags per cell and day: ``a`` above its own percentile, ``b`` below its own.

    Both variables are stacked and brought together by the grouping, so one
    shuffle by cell serves the match of days and the percentiles; a cell is no
    longer than the calendar. Only days with both variables count.
    """
    stacked = a.select("dt", "lat", "lon", F.col(a_value).alias("a"), F.lit(None).cast("double").alias("b")).unionByName(
        b.select("dt", "lat", "lon", F.lit(None).cast("double").alias("a"), F.col(b_value).alias("b"))
    )
    tasks = tasks_for(a.sparkSession, a.count() + b.count())
    paired = (
        stacked.select(cell_key(), "lat", "lon", "dt", "a", "b").repartition(tasks, "cell")
        .groupBy("cell", "lat", "lon", "dt").agg(F.max("a").alias("a"), F.max("b").alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
    )
    cell = W.partitionBy("cell")
    marked = paired.select(
        "cell", "lat", "lon", "dt", "a", "b",
        F.percentile("a", F.lit(hot)).over(cell).alias("high"),
        F.percentile("b", F.lit(low)).over(cell).alias("low"),
    )
    is_hot, is_low = F.col("a") > F.col("high"), F.col("b") < F.col("low")
    return marked.select(
        "cell", "dt", "lat", "lon", is_hot.alias("hot"), is_low.alias("fresh"),
        (is_hot & is_low).alias("compound"),
    )


def days_per_cell(flags: DataFrame) -> DataFrame:
    return flags.groupBy("cell", "lat", "lon").agg(
        F.count_if("hot").alias("hot_days"), F.count_if("fresh").alias("fresh_days"),
        F.count_if("compound").alias("compound_days"),
    ).drop("cell")


def compound_totals(per_cell: DataFrame) -> DataFrame:
    """Totals over the grid. ``longest`` is the largest number of compound days of
    a cell, not the length of a run."""
    hot, both = F.sum("hot_days"), F.sum("compound_days")
    return per_cell.agg(
        hot.alias("hot_pixel_days"), F.sum("fresh_days").alias("fresh_pixel_days"),
        both.alias("compound_pixel_days"),
        F.coalesce(F.round(100 * both / F.nullif(hot, F.lit(0)), 2), F.lit(0.0)).alias("compound_share_of_heat"),
        F.count_if(F.col("compound_days") > 0).alias("compound_affected_pixels"),
        F.max("compound_days").alias("longest_run_days"),
    )


def day_classes(per_cell: DataFrame) -> DataFrame:
    """Cells per class of compound days, zeros included."""
    rows = F.array(*[
        F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
                 F.count_if(F.col("compound_days").between(lo, hi)).alias("count"))
        for lo, hi in DAY_CLASSES
    ])
    return per_cell.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
