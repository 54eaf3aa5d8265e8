"""The event questions end to end."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.climatology import attach_by_day, days_of_window
from ..operators.cluster import by_severity, cluster_events
from ..operators.detect import detect_events, footprint_of_cells
from ..operators.exposure import events_at_site, farm_exposure, padded_site_box
from ..operators.filters import by_id, cells_in_bbox, default_window, features_in_bbox, filter_events, page, page_links
from ..operators.grid import Grid, align_to_grid, grid_of, nearest_on_axis
from ..operators.impact import OverlayIndex, attach_impact, find_site, impact_summary
from ..operators.rollup import aggregate_events
from ..sources.overlays import site_attributes


def _between(cube: DataFrame, start: date, end: date) -> DataFrame:
    return cube.where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def _baseline(clim: DataFrame, grid: Grid, start: date, end: date) -> DataFrame:
    """The climatology on the cube's grid, for the days of the window."""
    return align_to_grid(days_of_window(clim, start, end), grid)


def _around(baseline: DataFrame, bbox, grid: Grid) -> DataFrame:
    """The baseline of a box and of one cell beside it, so that rounding never drops a cell."""
    x0, y0, x1, y1 = bbox
    return cells_in_bbox(baseline, (x0 - grid.lon_step, y0 - grid.lat_step, x1 + grid.lon_step, y1 + grid.lat_step))


def find_events(
    cube: DataFrame, clim: DataFrame, start: date | None = None, end: date | None = None,
    bbox=None, min_category: int = 1, raw: bool = False, index: OverlayIndex | None = None,
    grid: Grid | None = None, max_cells: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Events of a window and their footprint; clusters unless ``raw``.

    Only days of the window are seen, so an event is cut at its ends. A
    climatology on another grid is taken from the nearest coordinates. For
    clusters the box cuts the cube before detection, which changes nothing: a
    cell's centre is the event's centre, and the order of the remaining events
    stays. Raw ids count all cells, so there the box comes after.
    """
    grid = grid or grid_of(cube)
    start, end = default_window(cube, start, end)
    days, baseline = _between(cube, start, end), _baseline(clim, grid, start, end)
    if bbox is not None and not raw and max_cells is None:
        days, baseline = cells_in_bbox(days, bbox), _around(baseline, bbox, grid)
    found = detect_events(days, baseline, grid=grid, max_cells=max_cells)
    found = filter_events(found, start, end, bbox, min_category)
    if raw:
        events, footprint = found.drop("ilat", "ilon"), footprint_of_cells(found)
    else:
        clusters = cluster_events(found)
        events, footprint = clusters.events, clusters.footprint
    if index is not None:
        events = attach_impact(events, footprint, index)
    return events if raw else by_severity(events), footprint


def detect_report(cube: DataFrame, clim: DataFrame, index: OverlayIndex, kinds: list[str],
                  start: date, end: date, bbox=None, min_category: int = 1,
                  grid: Grid | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unclustered events with the impact totals and the totals per category."""
    grid = grid or grid_of(cube)
    events, footprint = find_events(cube, clim, start, end, bbox, min_category, raw=True, grid=grid)
    return (events, *impact_summary(events, footprint, index, kinds))


def aggregate(cube: DataFrame, clim: DataFrame, index: OverlayIndex, by: str, start: date | None = None,
              end: date | None = None, min_category: int = 1, grid: Grid | None = None) -> DataFrame:
    events, _ = find_events(cube, clim, start, end, None, min_category, index=index, grid=grid)
    return aggregate_events(events, by)


def expose_farms(cube: DataFrame, clim: DataFrame, farms: DataFrame, start: date | None = None,
                 end: date | None = None, grid: Grid | None = None) -> DataFrame:
    grid = grid or grid_of(cube)
    events, footprint = find_events(cube, clim, start, end, grid=grid)
    return farm_exposure(events, footprint, farms, grid)


def site_report(cube: DataFrame, clim: DataFrame, overlay: DataFrame, code: str,
                start: date | None = None, end: date | None = None, grid: Grid | None = None) -> tuple[DataFrame, DataFrame]:
    """Clusters at a protected area, and one row about it; only the cells around it are looked at.

    The row has the area's attributes, the window and the number of clusters.
    """
    grid = grid or grid_of(cube)
    site = find_site(overlay, code)
    start, end = default_window(cube, start, end)
    box = padded_site_box(site)
    days, baseline = cells_in_bbox(_between(cube, start, end), box), _around(_baseline(clim, grid, start, end), box, grid)
    clusters = cluster_events(detect_events(days, baseline, grid=grid))
    found = events_at_site(clusters, site, grid)
    facts = site_attributes(site.limit(1)).select("site_code", "site_name", "member_state", "site_type", "area_ha").withColumns({
        "window_start": F.lit(start).cast("date"), "window_end": F.lit(end).cast("date"),
        "n_events": found.agg(F.count(F.lit(1)).alias("n")).scalar()})
    return by_severity(found), facts


def collection_items(items: DataFrame, order: list, bbox=None, limit: int = 100, offset: int = 0):
    """A page of overlay features or events, and the number of all that match."""
    if bbox is not None:
        items = features_in_bbox(items, bbox) if "parts" in items.columns else filter_events(items, bbox=bbox)
    return page(items, order, limit, offset)


def event_collection(
    cube: DataFrame, clim: DataFrame, start: date | None = None, end: date | None = None, bbox=None,
    min_category: int = 1, limit: int = 100, offset: int = 0, grid: Grid | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Clusters of a date range and box as a page, and one row ``numberMatched, next, prev``.

    The page is in the order of the clusters' numbers; ``next`` and ``prev`` are
    the offsets of the pages beside it, NULL where there is none.
    """
    events, _ = find_events(cube, clim, start, end, bbox, min_category, grid=grid)
    rows, matched = page(events, ["event_seq"], limit, offset)
    return rows, matched.select("numberMatched", page_links(F.col("numberMatched"), limit, offset).alias("links")).select(
        "numberMatched", "links.*")


def point_series(cube: DataFrame, clim: DataFrame, lon: float, lat: float, start: date, end: date,
                 pad_days: int = 0) -> DataFrame:
    """Value, mean and threshold per day at the cell nearest to a point."""
    at = cube.sparkSession.range(1).select(F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon"))
    near_lat = nearest_on_axis(at, cube, "lat").select("near_lat").scalar()
    near_lon = nearest_on_axis(at, cube, "lon").select("near_lon").scalar()
    first, last = F.date_sub(F.lit(start).cast("date"), pad_days), F.date_add(F.lit(end).cast("date"), pad_days)
    cell = cube.where(
        (F.col("lat") == near_lat) & (F.col("lon") == near_lon) & F.col("dt").between(first, last)
    )
    here = clim.where((F.col("lat") == near_lat) & (F.col("lon") == near_lon))
    rows = attach_by_day(cell.select("dt", "lat", "lon", "sst"), here)
    return rows.select(
        F.col("dt"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"),
        *[F.round(c, 3).alias(c) for c in ("sst", "seas", "thresh")],
    ).orderBy("dt")


def event_series(cube: DataFrame, clim: DataFrame, events: DataFrame, event_id: str, lon: float, lat: float,
                 pad_days: int = 30) -> DataFrame:
    """The series around one event, ``pad_days`` to both sides."""
    row = by_id(events, event_id).select("date_start", "date_end").first()
    if row is None:
        raise LookupError(f"no event {event_id!r}")
    return point_series(cube, clim, lon, lat, row["date_start"], row["date_end"], pad_days)
