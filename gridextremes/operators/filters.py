"""Filters, windows, ids and pages over events and features."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BBox = tuple[float, float, float, float]
MAX_PAGE = 1000
DEEP = 10_000  # offsets from here on are sought by range counts


def filter_events(
    events: DataFrame, start: date | None = None, end: date | None = None,
    bbox: BBox | None = None, min_category: int = 1,
) -> DataFrame:
    """Events that touch a date range, with their centre in a closed box."""
    if start is not None:
        events = events.where(F.col("date_end") >= F.lit(start).cast("date"))
    if end is not None:
        events = events.where(F.col("date_start") <= F.lit(end).cast("date"))
    if bbox is not None:
        x0, y0, x1, y1 = bbox
        events = events.where(
            F.col("centroid_lon").between(x0, x1) & F.col("centroid_lat").between(y0, y1)
        )
    if min_category > 1:
        events = events.where(F.col("category") >= min_category)
    return events


def cells_in_bbox(cube: DataFrame, bbox: BBox) -> DataFrame:
    """The same box test on cells, so that a cube is cut before detection."""
    x0, y0, x1, y1 = bbox
    return cube.where(
        F.round("lon", 4).between(x0, x1) & F.round("lat", 4).between(y0, y1)
    )


def features_in_bbox(features: DataFrame, bbox: BBox) -> DataFrame:
    """Overlay features whose own box meets the given one."""
    x0, y0, x1, y1 = bbox
    points = F.flatten(F.flatten("parts"))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return features.where(
        (F.array_max(xs) >= x0) & (F.array_min(xs) <= x1)
        & (F.array_max(ys) >= y0) & (F.array_min(ys) <= y1)
    )


def by_id(df: DataFrame, value: str, column: str = "event_id") -> DataFrame:
    return df.where(F.col(column) == value)


def default_window(cube: DataFrame, start: date | None = None, end: date | None = None,
                   days: int = 30) -> tuple[date, date]:
    """The window asked for, or the last ``days`` days of the cube."""
    if (start is None) != (end is None):
        raise ValueError("give both start and end, or neither")
    if start is not None:
        return start, end
    row = cube.agg(
        F.greatest(F.min("dt"), F.date_sub(F.max("dt"), days)).alias("start"),
        F.max("dt").alias("end"),
    ).first()
    if row["end"] is None:
        raise ValueError("the cube is empty")
    return row["start"], row["end"]


def on_day(cube: DataFrame, day: date) -> DataFrame:
    return cube.where(F.col("dt") == F.lit(day).cast("date"))


def nearest_day(cube: DataFrame, day: date) -> DataFrame:
    """Rows of the day in the cube nearest to ``day``; the later of two equally near."""
    gap = F.abs(F.datediff("dt", F.lit(day).cast("date")))
    best = cube.agg(F.min_by("dt", F.struct(gap, -F.unix_date("dt"))).alias("d")).scalar()
    return cube.where(F.col("dt") == best)


def page(df: DataFrame, order: list[Column | str], limit: int = 100, offset: int = 0, most: int = MAX_PAGE):
    """One page in a given order, and a one-row frame with the number of all rows.

    Larger pages than ``most`` are an error, never cut. Near the front the first
    rows of all partitions are merged; from ``DEEP`` rows on see ``deep_page``.
    """
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit is 1..{most} and offset not negative")
    rows = df.orderBy(*order).offset(offset).limit(limit) if offset < DEEP else deep_page(df, order, limit, offset)
    return rows, df.agg(F.count(F.lit(1)).alias("numberMatched"))


def deep_page(df: DataFrame, order: list[Column | str], limit: int, offset: int) -> DataFrame:
    """The page by seeking: rows are dealt to ranges of the order, and the counts of the
    ranges tell which of them hold the page; only these are sorted.

    What is gathered is bounded by the ranges' size, whatever the offset. The ranges
    are written once, so both looks at them see the same; their counts, one row per
    range, go to the driver. As with any paging, the order has to be a full one.
    """
    spark = df.sparkSession
    n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a given number of ranges is not merged into fewer
    ranged = materialise(df.repartitionByRange(n_ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()
    before, start, wanted = 0, None, []
    for r in sorted(counts):
        if before < offset + limit and before + r["n"] > offset:
            start = before if start is None else start
            wanted.append(r["_range"])
        before += r["n"]
    held = ranged.where(F.col("_range").isin(wanted)).drop("_range")
    return held.orderBy(*order).offset(offset - (start or 0)).limit(limit)


def page_links(matched: Column, limit: int, offset: int) -> Column:
    """Offsets of the neighbouring pages, NULL where there is none."""
    return F.struct(
        F.when(F.lit(offset + limit) < matched, F.lit(offset + limit)).alias("next"),
        F.when(F.lit(offset) > 0, F.lit(max(0, offset - limit))).alias("prev"),
    )


def top_by_intensity(events: DataFrame, k: int) -> DataFrame:
    return events.orderBy(F.desc("intensity_max"), "event_seq").limit(k)


def by_intensity(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("intensity_max"), "event_seq")


def severe_count(events: DataFrame, from_category: int = 3) -> DataFrame:
    return events.agg(F.count_if(F.col("category") >= from_category).alias("n_severe"))
