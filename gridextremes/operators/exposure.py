"""Which events reach a farm, and which reach a protected area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Clusters, cluster_events
from .coverage import cells_around, cover_cells
from .filters import filter_events
from .grid import Grid
from .impact import find_site
from .skew import hot_join, keyed_join

# --- fixed values -----------------------------------------------------------
POINT_EVENT_RADIUS_DEG = 0.07
SITE_PADDING_DEG = 0.5
# ----------------------------------------------------------------------------

EXPOSED_COLUMNS = [
    "event_id", "date_start", "date_end", "date_peak", "duration_days", "category",
    "category_name", "intensity_max", "intensity_mean", "intensity_cumulative",
]


def events_by_cell(events: DataFrame, footprint: DataFrame) -> DataFrame:
    """All events of a cell as one array; the calendar bounds its length."""
    row = F.struct(
        F.col("date_start").alias("order_date"), F.col("event_id").alias("order_id"),
        F.struct(*EXPOSED_COLUMNS).alias("event"), "is_point",
    )
    return hot_join(footprint, events, ["event_id"]).groupBy("ilat", "ilon").agg(
        F.collect_list(row).alias("found")
    )


def farm_exposure(events: DataFrame, footprint: DataFrame, farms: DataFrame, grid: Grid) -> DataFrame:
    """Each farm with the events whose footprint holds it, earliest first.

    A farm on a cell border lies in both cells. A cluster of one cell reaches
    the farms nearer than 0.07 degrees to its centre. Farms without an event
    stay, with an empty list.
    """
    if "ilat" in events.columns:
        events = events.drop("ilat", "ilon")
    reach = max(0.0, POINT_EVENT_RADIUS_DEG - min(grid.lat_step, grid.lon_step) / 2)
    around = cells_around(F.col("lon"), F.col("lat"), grid, reach)
    # Equal rows are looked up once and written out again at the end.
    given = farms.groupBy("id", "lon", "lat").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    near = given.select("*", F.explode_outer(around).alias("c")).select(
        "id", "lon", "lat", "copies", F.col("c.ilat").alias("ilat"), F.col("c.ilon").alias("ilon")
    )
    placed = hot_join(near, events_by_cell(events, footprint), ["ilat", "ilon"], "left")
    half_x, half_y = grid.lon_step / 2, grid.lat_step / 2
    dx, dy = F.col("lon") - grid.lon(F.col("ilon")), F.col("lat") - grid.lat(F.col("ilat"))
    in_box = (
        F.col("lon").between(grid.west(F.col("ilon")), grid.west(F.col("ilon") + 1))
        & F.col("lat").between(grid.south(F.col("ilat")), grid.south(F.col("ilat") + 1))
    )
    in_disc = F.sqrt(dx * dx + dy * dy) < POINT_EVENT_RADIUS_DEG
    flagged = placed.select(
        "id", "lon", "lat", "copies", "found", in_box.alias("in_box"), in_disc.alias("in_disc")
    )
    mine = F.filter(
        "found", lambda e: F.when(e["is_point"], F.col("in_disc")).otherwise(F.col("in_box"))
    )
    # One row per cell around the farm: a handful.
    gathered = flagged.select("id", "lon", "lat", "copies", mine.alias("mine")).groupBy(
        "id", "lon", "lat", "copies"
    ).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("mine")))).alias("mine"))
    return gathered.select("*", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "id", "lon", "lat", F.size("mine").alias("n_events"), F.col("mine.event").alias("events")
    )


def padded_site_box(site: DataFrame, pad: float = SITE_PADDING_DEG) -> tuple[float, float, float, float]:
    box = site.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    return box[0] - pad, box[1] - pad, box[2] + pad, box[3] + pad


def events_at_site(clusters: Clusters, site: DataFrame, grid: Grid) -> DataFrame:
    """Clusters whose footprint meets the site."""
    cover = cover_cells(site, grid).select("ilat", "ilon", "holds_centre")
    met = keyed_join(clusters.footprint, cover, ["ilat", "ilon"]).where(~F.col("is_point") | F.col("holds_centre"))
    return keyed_join(clusters.events, met.select("event_id"), "event_id", "left_semi")


def site_events(
    raw_events: DataFrame, overlay: DataFrame, code: str, grid: Grid, start=None, end=None,
) -> DataFrame:
    """Clusters that meet a protected area, built from the events around it only."""
    site = find_site(overlay, code)
    around = filter_events(raw_events, start, end, padded_site_box(site))
    return events_at_site(cluster_events(around), site, grid)
