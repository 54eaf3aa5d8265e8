"""Events against overlays: hits, covered area, summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import degrees2_to_km2, impact_sentence, site_code
from ..session import materialise
from .coverage import FEATURE, point_cover, point_groups, polygon_cover
from .grid import Grid
from .skew import hot_join, keyed_join, tasks_for

EMPTY_IMPACT = {"n_aquaculture_sites": 0, "mpa_area_km2": 0.0, "seagrass_area_km2": 0.0}


@dataclass(frozen=True)
class OverlayIndex:
    """Where the features of an overlay lie on a grid, for any number of event sets.

    ``polygons`` and ``points`` hold the touched cells per feature, ``groups``
    the points that touch the same cells as one row.
    """

    overlay: DataFrame
    polygons: DataFrame
    points: DataFrame
    groups: DataFrame


def index_overlay(overlay: DataFrame, grid: Grid) -> OverlayIndex:
    """Lay an overlay on the grid once, as written tables."""
    return OverlayIndex(
        overlay,
        materialise(polygon_cover(overlay, grid), "polygon-cover"),
        materialise(point_cover(overlay, grid), "point-cover"),
        materialise(point_groups(overlay, grid), "point-groups"),
    )


def _meets(is_point, holds_centre):
    return ~is_point | holds_centre


def event_hits(footprint: DataFrame, cover: DataFrame) -> DataFrame:
    """Every (event, feature) that meet, with the common area in square degrees.

    A cluster of one cell is a point: it meets a polygon that holds the cell
    centre and a site exactly on it, and has no area.
    """
    cell = ["ilat", "ilon"]
    # What meets is counted first, cell by cell, and dealt to as many tasks as it needs before it is summed.
    covered, held = (df.groupBy(*cell).agg(F.count(F.lit(1)).alias(n)) for df, n in ((cover, "a"), (footprint, "b")))
    rows = keyed_join(covered, held, cell).agg(F.sum(F.col("a") * F.col("b"))).first()[0]
    joined = hot_join(cover, footprint, cell).where(_meets(F.col("is_point"), F.col("holds_centre")))
    return joined.repartition(tasks_for(cover.sparkSession, rows), "event_id", *FEATURE).groupBy(
        "event_id", *FEATURE
    ).agg(
        F.sum(F.when(F.col("is_point"), 0.0).otherwise(F.col("area"))).alias("area"),
        F.sum(F.when(F.col("is_point"), 0.0).otherwise(F.col("moment"))).alias("moment"),
    )


def overlap_area(footprint: DataFrame, index: OverlayIndex) -> DataFrame:
    """Common area per (event, polygon) in km², at the latitude of that area."""
    return event_hits(footprint, index.polygons).select(
        "event_id", *FEATURE, degrees2_to_km2(F.col("area"), F.col("moment")).alias("km2")
    )


def point_hits(footprint: DataFrame, index: OverlayIndex) -> DataFrame:
    """Number of point features met, per event and kind."""
    groups = index.groups.select("*", F.explode("cells").alias("c")).select(
        "kind", "cells", "centres", "n",
        F.col("c.ilat").alias("ilat"), F.col("c.ilon").alias("ilon"),
        F.array_contains("centres", F.col("c")).alias("holds_centre"),
    )
    joined = keyed_join(groups, footprint, ["ilat", "ilon"])
    met = joined.where(_meets(F.col("is_point"), F.col("holds_centre")))
    # A group that lies on a border meets an event through several cells.
    once = met.select("event_id", "kind", "cells", "centres", "n").distinct()
    return once.groupBy("event_id", "kind").agg(F.sum("n").alias("n"))


def cell_impact(index: OverlayIndex) -> DataFrame:
    """``ilat, ilon`` and what an event of that cell only meets: ``sites``, those ``at_centre``, ``mpa`` and ``seagrass`` in km²."""
    km2 = degrees2_to_km2(F.col("area"), F.col("moment"))
    areas = index.polygons.select("ilat", "ilon", *[F.when(F.col("kind") == k, km2).alias(k) for k in ("mpa", "seagrass")])
    spots = index.groups.where(F.col("kind") == "aquaculture").select("n", "centres", F.explode("cells").alias("c")).select(
        "c.ilat", "c.ilon", F.col("n").alias("sites"), F.when(F.array_contains("centres", F.col("c")), F.col("n")).alias("at_centre"))
    return areas.unionByName(spots, allowMissingColumns=True).groupBy("ilat", "ilon").agg(
        *[F.sum(c).alias(c) for c in ("sites", "at_centre", "mpa", "seagrass")])


def _met(footprint: DataFrame, index: OverlayIndex) -> DataFrame:
    """``event_id, sites, mpa, seagrass``: number of sites met and km² covered; none or null if there are none.

    Events of one cell take the sums of their cell, which are made once per cell; they are never joined to single
    features, of which a cell may have any number. Only events of several cells need the features they have in common.
    """
    rows = footprint.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("ilat", "ilon", "is_point")])
    alone = (F.col("n") == 1) & F.col("is_point").isNotNull()
    spread = materialise(rows.where(~alone).select("event_id"), "spread-events")
    of_box = {c: F.when(~F.col("is_point"), F.col(c)) for c in ("mpa", "seagrass")}
    sites = F.when(F.col("is_point"), F.col("at_centre")).otherwise(F.col("sites"))
    met = keyed_join(rows.where(alone), cell_impact(index), ["ilat", "ilon"]).select(
        "event_id", sites.cast("int").alias("sites"), *[of_box[c].alias(c) for c in of_box])
    if spread.isEmpty():
        return met
    footprint = keyed_join(footprint, spread, "event_id", "left_semi")
    sites = point_hits(footprint, index).where(F.col("kind") == "aquaculture").select(
        "event_id", F.col("n").cast("int").alias("sites")
    )
    areas = overlap_area(footprint, index).groupBy("event_id").agg(
        F.sum(F.when(F.col("kind") == "mpa", F.col("km2"))).alias("mpa"),
        F.sum(F.when(F.col("kind") == "seagrass", F.col("km2"))).alias("seagrass"),
    )
    return met.unionByName(keyed_join(sites, areas, "event_id", "full"))


def attach_impact(events: DataFrame, footprint: DataFrame, index: OverlayIndex) -> DataFrame:
    """Add the ``impact`` struct: sites met, protected and habitat area, a sentence."""
    n = F.coalesce("sites", F.lit(0))
    mpa = F.round(F.coalesce("mpa", F.lit(0.0)), 2)
    seagrass = F.round(F.coalesce("seagrass", F.lit(0.0)), 2)
    return (
        keyed_join(events, _met(footprint, index), "event_id", "left")
        .withColumn("impact", F.struct(
            n.alias("n_aquaculture_sites"), mpa.alias("mpa_area_km2"),
            seagrass.alias("seagrass_area_km2"),
            impact_sentence(n, mpa, seagrass).alias("summary"),
        ))
        .drop("sites", "mpa", "seagrass")
    )


def affected_counts(
    events: DataFrame, footprint: DataFrame, index: OverlayIndex, kinds: list[str],
) -> DataFrame:
    """Features met per event, one column per kind, zeros included."""
    areas = event_hits(footprint, index.polygons).groupBy("event_id", "kind").agg(
        F.count(F.lit(1)).alias("n")
    )
    per_kind = point_hits(footprint, index).unionByName(areas)
    wide = per_kind.groupBy("event_id").pivot("kind", kinds).agg(F.sum("n"))
    rows = events.select("event_id", "category", "category_name", "date_start", "date_end")
    return keyed_join(rows, wide, "event_id", "left").fillna(0, kinds)


def impact_summary(
    events: DataFrame, footprint: DataFrame, index: OverlayIndex, kinds: list[str],
) -> tuple[DataFrame, DataFrame]:
    """Totals over all events, and the same per category."""
    counts = affected_counts(events, footprint, index, kinds)
    sums = [F.sum(k).cast("long").alias(k) for k in kinds]
    totals = counts.agg(F.count(F.lit(1)).alias("n_events"), *sums)
    return totals, counts.groupBy("category_name").agg(F.count(F.lit(1)).alias("n_events"), *sums)


def hit_details(footprint: DataFrame, index: OverlayIndex) -> DataFrame:
    """Every met feature with its properties, one row per (event, feature)."""
    hits = event_hits(footprint, index.polygons.unionByName(index.points))
    return hot_join(hits.select("event_id", *FEATURE), index.overlay.select(*FEATURE, "props"), FEATURE)


def details_by_kind(events: DataFrame, footprint: DataFrame, index: OverlayIndex, kinds: list[str]) -> DataFrame:
    """Per event one row for every kind, also those not met: ``kind, affected, details`` (properties of the features)."""
    rows = hit_details(footprint, index).groupBy("event_id", "kind").agg(F.sort_array(F.collect_list(
        F.struct("feature_id", F.map_entries("props").alias("props")))).alias("found"))
    wanted = events.select("event_id", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    details = F.transform("found", lambda f: F.map_from_entries(f["props"]))
    return keyed_join(wanted, rows, ["event_id", "kind"], "left").select(
        "event_id", "kind", F.coalesce(F.size("found"), F.lit(0)).alias("affected"),
        F.coalesce(details, F.array().cast("array<map<string,string>>")).alias("details"))


def find_site(overlay: DataFrame, code: str) -> DataFrame:
    """The protected area with a site code, whatever its case; error if unknown."""
    wanted = overlay.where(
        (F.col("kind") == "mpa")
        & (site_code(F.col("props")["SITECODE"]) == F.lit(code.strip().upper()))
    )
    if wanted.isEmpty():
        raise LookupError(f"no protected area has the site code {code!r}")
    return wanted
