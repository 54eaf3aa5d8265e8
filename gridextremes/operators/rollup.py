"""Buckets and histograms over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import category_name, country_of
from .grid import Grid
from .impact import EMPTY_IMPACT
from .skew import keyed_join

AXES = ("year", "category", "country", "mpa")


def _impact(field: str):
    return F.coalesce(F.col("impact")[field], F.lit(EMPTY_IMPACT[field]))


def aggregate_events(events: DataFrame, by: str) -> DataFrame:
    """One bucket per start year, category, country of the centre, or by whether
    any protected area is touched.

    ``intensity_mean`` is the mean of the peak intensities and ``intensity_max``
    is never below 0.
    """
    if by not in AXES:
        raise ValueError(f"by is one of {', '.join(AXES)}")
    if "impact" not in events.columns:
        events = events.withColumn("impact", F.struct(*[F.lit(v).alias(k) for k, v in EMPTY_IMPACT.items()]))
    key = {
        "year": F.coalesce(F.year("date_start").cast("string"), F.lit("unknown")),
        "category": F.col("category").cast("string"),
        "country": country_of(F.col("centroid_lon"), F.col("centroid_lat")),
        "mpa": F.when(_impact("mpa_area_km2") > 0, "events_touching_mpa")
                .otherwise("events_not_touching_mpa"),
    }[by]
    buckets = events.groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.greatest(F.lit(0.0), F.max("intensity_max")), 3).alias("intensity_max"),
        F.round(F.coalesce(F.avg("intensity_max"), F.lit(0.0)), 3).alias("intensity_mean"),
        F.sum(F.coalesce("n_pixels", F.lit(0))).alias("n_pixels_total"),
        F.sum(_impact("n_aquaculture_sites")).alias("aquaculture_sites"),
        F.round(F.sum(_impact("mpa_area_km2")), 2).alias("mpa_area_km2"),
        F.round(F.sum(_impact("seagrass_area_km2")), 2).alias("seagrass_area_km2"),
    )
    if by == "category":
        buckets = buckets.withColumn("category_name", category_name(F.col("key").cast("int")))
    order = ["key"] if by == "year" else [F.desc("count"), "key"]
    return buckets.orderBy(*order)


def category_histogram(events: DataFrame) -> DataFrame:
    """Number of events per category 1..5, zeros included."""
    counts = events.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    every = events.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("category"))
    return every.join(counts, "category", "left").select(
        "category", category_name(F.col("category")).alias("category_name"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def event_density(events: DataFrame, grid: Grid) -> DataFrame:
    """Events per grid cell, each event counted at the cell nearest to its centre."""
    def clamp(index, n):
        return F.least(F.lit(n - 1), F.greatest(F.lit(0), index))

    return events.groupBy(
        clamp(grid.ilat(F.col("centroid_lat")), grid.n_lat).alias("ilat"),
        clamp(grid.ilon(F.col("centroid_lon")), grid.n_lon).alias("ilon"),
    ).agg(F.count(F.lit(1)).alias("n_events")).select(
        grid.lat(F.col("ilat")).alias("lat"), grid.lon(F.col("ilon")).alias("lon"), "n_events"
    )


def intensity_histogram(events: DataFrame, bins: int = 19) -> DataFrame:
    """Peak intensities per category in equal bins from 0 to the maximum + 0.5."""
    top = events.agg((F.max("intensity_max") + 0.5).alias("top")).scalar()
    number = F.least(F.lit(bins), F.width_bucket("intensity_max", F.lit(0.0), top, F.lit(bins)))
    return (
        events.where(F.col("intensity_max") >= 0)
        .groupBy("category", number.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("category", "bin", ((F.col("bin") - 1) * top / bins).alias("bin_from"), "n")
    )


def bubbles(events: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """A point per event to draw a bubble at: its centroid, else the vertex mean
    of its outer ring with the most vertices, of equally long ones the first one's
    (x, then y of its first vertex).

    ``rings`` has ``event_id, ring`` (array of x, y), one row per outer ring.
    """
    own = events.select(
        "event_id", F.col("centroid_lon").alias("x"), F.col("centroid_lat").alias("y")
    )
    if rings is None:
        return own.select("event_id", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    size = F.size("ring")

    def mean(axis):
        return F.aggregate("ring", F.lit(0.0), lambda acc, p: acc + p[axis]) / size

    centre = F.struct(mean("x").alias("x"), mean("y").alias("y"))
    largest = rings.groupBy("event_id").agg(F.max_by(centre, F.struct(size, -F.col("ring")[0]["x"], -F.col("ring")[0]["y"])).alias("c"))
    return keyed_join(own, largest, "event_id", "left").select(
        "event_id", F.coalesce("x", "c.x", F.lit(0.0)).alias("x"), F.coalesce("y", "c.y", F.lit(0.0)).alias("y")
    )
