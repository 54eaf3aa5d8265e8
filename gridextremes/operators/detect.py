"""Events of one cell: runs above the threshold, joined over short gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import category_index, category_name, event_id_text, exceeds
from ..session import materialise
from .climatology import CELL, attach_baseline, pooled_climatology
from .grid import Grid, decimate, grid_of
from .numbering import number_by_cell


def mark_events(
    series: DataFrame, min_duration: int = 5, max_gap: int = 2, join_gaps: bool = True,
) -> DataFrame:
    """Rows of ``series`` that belong to an event, with ``event_no`` 1..n per cell.

    ``series`` has ``cell, lat, lon, dt, sst, seas, thresh``. Runs are contiguous by
    row; runs shorter than ``min_duration`` rows are dropped before the rest is
    joined over gaps of at most ``max_gap`` days, whose rows then belong to the
    event too. All windows are per cell in date order, so one shuffle by cell
    and one sort serve them; apart from the running count their frames are a
    few rows long. Rows with no hot row within ``max_gap + 1`` rows leave after
    the first window: they are in no run and no gap, and as all rows that near a
    hot one stay, no two runs move together.
    """
    by_day = W.partitionBy("cell").orderBy("dt")
    reach = max(0, max_gap) + 1
    # A row is in a long enough run if it is among min_duration hot rows in a row.
    full = F.count_if("hot").over(by_day.rowsBetween(1 - min_duration, 0)) == min_duration
    marked = (
        series.withColumn("hot", exceeds(F.col("sst"), F.col("thresh")))
        .withColumn("near_hot", F.max("hot").over(by_day.rowsBetween(-reach, reach)))
        .where("near_hot")
        .withColumn("ends", full)
        .withColumn("kept", F.max("ends").over(by_day.rowsBetween(0, min_duration - 1)))
    )
    kept_day = F.when(F.col("kept"), F.col("dt"))
    if join_gaps:
        # A kept day near enough lies within max_gap + 1 rows.
        before = F.max(kept_day).over(by_day.rowsBetween(-(max_gap + 1), -1))
        after = F.min(kept_day).over(by_day.rowsBetween(1, max_gap + 1))
    else:
        before = after = F.lit(None).cast("date")
    near = marked.select(
        "*", before.alias("before"), after.alias("after"),
        F.coalesce(F.lag("kept").over(by_day), F.lit(False)).alias("kept_before"),
    )
    joins_on = F.col("kept_before") | F.coalesce(
        F.datediff("dt", "before") - 1 <= max_gap, F.lit(False)
    )
    bridged = F.coalesce(F.datediff("after", "before") - 1 <= max_gap, F.lit(False))
    starts = F.when(F.col("kept") & ~joins_on, 1).otherwise(0)
    numbered = near.withColumn(
        "event_no", F.sum(starts).over(by_day.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    return numbered.where(F.col("kept") | bridged).select(
        *series.columns, F.col("event_no").cast("int").alias("event_no")
    )


def event_metrics(rows: DataFrame) -> DataFrame:
    """One row per event: dates, length, intensities over ``sst - seas``, category.

    An event without any day of known ``sst`` and ``seas`` has no peak and is left out.
    """
    rel = F.col("sst") - F.col("seas")
    # The first day wins among equal peaks; NULL days never win.
    rank = F.when(rel.isNotNull(), F.struct(rel, -F.unix_date("dt")))
    peak = F.max_by(F.struct("dt", "seas", "thresh"), rank)
    grouped = rows.groupBy(*CELL, "event_no").agg(
        F.min("dt").alias("date_start"),
        F.max("dt").alias("date_end"),
        peak.alias("peak"),
        F.count(F.lit(1)).cast("int").alias("duration_days"),
        F.max(rel).alias("i_max"),
        F.avg(rel).alias("i_mean"),
        F.sum(rel).alias("i_cum"),
    )
    seas, thresh = F.col("peak.seas"), F.col("peak.thresh")
    return grouped.where(F.col("i_max").isNotNull()).select(
        "lat", "lon", "event_no", "date_start", "date_end",
        F.col("peak.dt").alias("date_peak"),
        "duration_days",
        F.round("i_max", 3).alias("intensity_max"),
        F.round("i_mean", 3).alias("intensity_mean"),
        F.round("i_cum", 3).alias("intensity_cumulative"),
        category_index(seas + F.col("i_max"), seas, thresh).alias("category"),
    )


def cell_events(
    cube: DataFrame, clim: DataFrame, min_duration: int = 5, max_gap: int = 2,
    join_gaps: bool = True,
) -> DataFrame:
    """Unnumbered events per cell (lazy, one shuffle by cell)."""
    series = attach_baseline(cube.select("lat", "lon", "dt", "sst"), clim)
    return event_metrics(mark_events(series, min_duration, max_gap, join_gaps))


def detect_events(
    cube: DataFrame, clim: DataFrame, min_duration: int = 5, max_gap: int = 2,
    join_gaps: bool = True, max_cells: int | None = None, grid: Grid | None = None,
) -> DataFrame:
    """Numbered events of all cells, in the EVENT layout plus ``ilat, ilon``.

    Only the rows given are seen: an event is cut at the ends of the cube.
    ``max_cells`` thins the grid first; by default every cell is used.
    """
    grid = grid or grid_of(cube)
    cube = decimate(cube, grid, max_cells)
    found = cell_events(cube, clim, min_duration, max_gap, join_gaps)
    step = grid.stride(max_cells)
    placed = found.select(
        "*", grid.ilat(F.col("lat")).alias("ilat"), grid.ilon(F.col("lon")).alias("ilon")
    )
    # Numbering reads the events twice; without the copy detection would run twice.
    placed = materialise(placed, "cell-events")
    numbered = number_by_cell(placed, "ilat", "ilon", "event_no", "event_seq")
    half_x, half_y = grid.lon_step * step / 2, grid.lat_step * step / 2
    return numbered.select(
        event_id_text(F.col("event_seq")).alias("event_id"), "event_seq",
        "date_start", "date_end", "date_peak", "duration_days",
        "intensity_max", "intensity_mean", "intensity_cumulative",
        "category", category_name(F.col("category")).alias("category_name"),
        F.round("lon", 4).alias("centroid_lon"), F.round("lat", 4).alias("centroid_lat"),
        F.struct(
            (F.col("lon") - half_x).alias("x0"), (F.col("lat") - half_y).alias("y0"),
            (F.col("lon") + half_x).alias("x1"), (F.col("lat") + half_y).alias("y1"),
        ).alias("bbox"),
        F.lit(1).alias("n_pixels"), F.lit("Polygon").alias("geom_type"),
        "ilat", "ilon",
    )


def detect_self_baseline(cube: DataFrame, first_year: int, last_year: int, **options) -> DataFrame:
    """Detection whose climatology comes from the same series, over the years it has."""
    span = cube.agg(F.year(F.min("dt")).alias("lo"), F.year(F.max("dt")).alias("hi")).first()
    lo, hi = max(first_year, span["lo"]), min(last_year, span["hi"])
    if lo > hi:
        lo, hi = span["lo"], span["hi"]
    return detect_events(cube, pooled_climatology(cube, lo, hi), **options)


def footprint_of_cells(events: DataFrame) -> DataFrame:
    """FOOTPRINT rows of unclustered events: their own cell."""
    return events.select("event_id", "ilat", "ilon", (F.col("geom_type") == "Point").alias("is_point"))
