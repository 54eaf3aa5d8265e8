"""What a cube holds, year by year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def year_coverage(cube: DataFrame) -> DataFrame:
    """First and last day of every calendar year."""
    return cube.groupBy(F.year("dt").alias("year")).agg(
        F.min("dt").alias("first_day"), F.max("dt").alias("last_day"),
    )


def year_items(cube: DataFrame, collection: str, period: str = "1991-2020") -> DataFrame:
    """One catalogue item per calendar year, with its box and links."""
    per_year = cube.groupBy(F.year("dt").alias("year")).agg(
        F.min("dt").alias("d0"), F.max("dt").alias("d1"),
        F.min("lon").alias("x0"), F.min("lat").alias("y0"),
        F.max("lon").alias("x1"), F.max("lat").alias("y1"),
    )
    union = items_bbox(per_year)
    box = {c: union.select(c).scalar() for c in ("x0", "y0", "x1", "y1")}
    d0, d1 = F.date_format("d0", "yyyy-MM-dd"), F.date_format("d1", "yyyy-MM-dd")
    return per_year.select(
        F.concat(F.lit(f"{collection}-"), F.col("year").cast("string")).alias("id"),
        F.lit(collection).alias("collection"), "year",
        F.concat(d0, F.lit("T00:00:00Z")).alias("start_datetime"),
        F.concat(d1, F.lit("T23:59:59Z")).alias("end_datetime"),
        F.lit(period).alias("climatology"),
        *[v.alias(k) for k, v in box.items()],
        F.concat(F.lit("events?start="), d0, F.lit("&end="), d1).alias("events_href"),
        F.concat(F.lit("anomaly?date="), d0).alias("anomaly_href"),
    )


def items_bbox(items: DataFrame) -> DataFrame:
    """Box around the boxes of all items."""
    return items.agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
