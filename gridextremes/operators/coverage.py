"""How overlay features lie on the grid: cells touched, area covered, centres held.

A feature meets the grid once, here; events then only look up their cells. The
work is done edge by edge: an edge is cut at the cell borders, and each piece
adds to the signed area below it in its own cell and, with its full width, to
all cells below in its column. Summed over the edges of a polygon this is the
exact covered area of every cell, with holes taken out. Rows are edges and
pieces, never whole polygons times cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import Grid
from .skew import tasks_for

POINT_TYPES = ["Point", "MultiPoint"]
FEATURE = ["kind", "feature_id"]
BLOCK_COLUMNS = 16  # columns of the grid that one feature brings to a task together
COLUMN = [*FEATURE, "block", "ilon"]


def polygon_edges(overlay: DataFrame) -> DataFrame:
    """One row per edge, ``w`` being +1 or -1 so that areas below edges add up."""
    rings = (
        overlay.where(~F.col("geom_type").isin(POINT_TYPES))
        .select(*FEATURE, F.explode("parts").alias("rings"))
        .select(*FEATURE, F.posexplode("rings").alias("ring_no", "ring"))
    )
    closed = F.when(
        F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")
    ).otherwise(F.concat("ring", F.slice("ring", 1, 1)))
    paired = rings.select(*FEATURE, "ring_no", closed.alias("ring")).select(
        *FEATURE, "ring_no",
        F.arrays_zip(
            F.slice("ring", F.lit(1), F.size("ring") - 1).alias("p"),
            F.slice("ring", F.lit(2), F.size("ring") - 1).alias("q"),
        ).alias("edges"),
    )
    turn = F.aggregate(
        "edges", F.lit(0.0),
        lambda acc, e: acc + (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]),
    )
    outer = F.when(F.col("ring_no") == 0, 1).otherwise(-1)
    return paired.select(
        *FEATURE, (-F.signum(turn) * outer).alias("turn"), F.explode("edges").alias("e")
    ).select(
        *FEATURE,
        F.when(F.col("e.p.x") <= F.col("e.q.x"), F.col("turn")).otherwise(-F.col("turn")).alias("w"),
        # From left to right.
        F.least("e.p.x", "e.q.x").alias("xl"), F.greatest("e.p.x", "e.q.x").alias("xr"),
        F.when(F.col("e.p.x") <= F.col("e.q.x"), F.col("e.p.y")).otherwise(F.col("e.q.y")).alias("yl"),
        F.when(F.col("e.p.x") <= F.col("e.q.x"), F.col("e.q.y")).otherwise(F.col("e.p.y")).alias("yr"),
    )


def _columns(grid: Grid) -> tuple[Column, Column]:
    """First and last column of the grid that an edge touches."""
    west0, dx = grid.lon0 - grid.lon_step / 2, grid.lon_step
    return (F.greatest(F.lit(0), (F.ceil((F.col("xl") - west0) / dx) - 1).cast("int")),
            F.least(F.lit(grid.n_lon - 1), F.floor((F.col("xr") - west0) / dx).cast("int")))


def _dealt_edges(edges: DataFrame, grid: Grid) -> DataFrame:
    """Edges dealt by feature and block of columns, to as many tasks as their pieces need, however few files they come from.

    An edge is repeated for each block that it reaches. All that is summed lies in one column, so pieces stay where they are cut.
    """
    pieces = (F.col("xr") - F.col("xl")) / grid.lon_step + F.abs(F.col("yr") - F.col("yl")) / grid.lat_step + 2
    rows = edges.agg(F.sum(pieces)).first()[0]
    c0, c1 = _columns(grid)
    blocks = F.sequence(F.floor(c0 / BLOCK_COLUMNS).cast("int"), F.floor(c1 / BLOCK_COLUMNS).cast("int"))
    return edges.where(c0 <= c1).select("*", F.explode(blocks).alias("block")).repartition(
        tasks_for(edges.sparkSession, rows), *FEATURE, "block")


def _edge_pieces(edges: DataFrame, grid: Grid) -> DataFrame:
    """Edges cut at the cell borders; a piece on a border shows up on both sides."""
    south0, dy = grid.lat0 - grid.lat_step / 2, grid.lat_step
    c0, c1 = _columns(grid)
    in_block = F.col("block") * BLOCK_COLUMNS
    slope = (F.col("yr") - F.col("yl")) / F.nullif(F.col("xr") - F.col("xl"), F.lit(0.0))

    def y_at(x):
        return (
            F.when(x == F.col("xr"), F.col("yr"))
            .otherwise(F.col("yl") + (x - F.col("xl")) * F.coalesce(slope, F.lit(0.0)))
        )

    upright = F.col("xl") == F.col("xr")
    in_column = (
        edges.select("*", F.explode(F.sequence(
            F.greatest(c0, in_block), F.least(c1, in_block + (BLOCK_COLUMNS - 1)))).alias("ilon"))
        .select(
            "*", grid.west(F.col("ilon")).alias("cx0"), grid.west(F.col("ilon") + 1).alias("cx1")
        )
        .select(
            "*", F.greatest("xl", "cx0").alias("xs"), F.least("xr", "cx1").alias("xe")
        )
        .where(F.col("xs") <= F.col("xe"))
        .select(
            *COLUMN, "w", "cx0", "cx1", "xs", "xe",
            F.when(upright, F.col("yl")).otherwise(y_at(F.col("xs"))).alias("ys"),
            F.when(upright, F.col("yr")).otherwise(y_at(F.col("xe"))).alias("ye"),
        )
    )
    r0 = F.greatest(F.lit(0), (F.ceil((F.least("ys", "ye") - south0) / dy) - 1).cast("int"))
    r1 = F.floor((F.greatest("ys", "ye") - south0) / dy).cast("int")
    level = F.col("ys") == F.col("ye")
    run = (F.col("xe") - F.col("xs")) / F.nullif(F.col("ye") - F.col("ys"), F.lit(0.0))

    def x_at(y):
        return F.when(y == F.col("ye"), F.col("xe")).otherwise(
            F.col("xs") + (y - F.col("ys")) * F.coalesce(run, F.lit(0.0))
        )

    def within(y):
        return F.greatest(F.col("cy0"), F.least(F.col("cy1"), y))

    return (
        in_column.where(r0 <= r1)
        .select("*", F.explode(F.sequence(r0, r1)).alias("ilat"))
        .select(
            "*", grid.south(F.col("ilat")).alias("cy0"), grid.south(F.col("ilat") + 1).alias("cy1")
        )
        .where((F.least("ys", "ye") <= F.col("cy1")) & (F.greatest("ys", "ye") >= F.col("cy0")))
        .select("*", within(F.col("ys")).alias("y0"), within(F.col("ye")).alias("y1"))
        .select(
            *COLUMN, "w", "ilat", "cx0", "cx1", "cy0", "cy1", "y0", "y1",
            F.when(level, F.col("xs")).otherwise(x_at(F.col("y0"))).alias("x0"),
            F.when(level, F.col("xe")).otherwise(x_at(F.col("y1"))).alias("x1"),
            # A level piece on a border belongs to the cell above it.
            (~level | ((F.col("ys") >= F.col("cy0")) & (F.col("ys") < F.col("cy1")))).alias("own"),
        )
    )


def polygon_cover(overlay: DataFrame, grid: Grid) -> DataFrame:
    """Cells each polygon touches: covered area, its y moment, and whether the
    cell centre lies in the polygon (border included)."""
    p = _edge_pieces(_dealt_edges(polygon_edges(overlay), grid), grid)
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    width = F.when(F.col("own"), (x1 - x0) * F.col("w")).otherwise(0.0)
    px = (F.col("cx0") + F.col("cx1")) / 2
    py = (F.col("cy0") + F.col("cy1")) / 2
    y_px = F.when(x1 > x0, y0 + (px - x0) * (y1 - y0) / F.nullif(x1 - x0, F.lit(0.0)))
    crosses = F.col("own") & (x0 <= px) & (px < x1)
    on_border = F.when(
        x1 > x0, (x0 <= px) & (px <= x1) & (y_px == py)
    ).otherwise((x0 == px) & py.between(F.least(y0, y1), F.greatest(y0, y1)))
    per_cell = p.groupBy(*COLUMN, "ilat").agg(
        F.sum(width * ((y0 + y1) / 2 - F.col("cy0"))).alias("area"),
        F.sum(width * ((y0 * y0 + y0 * y1 + y1 * y1) / 3 - F.col("cy0") * F.col("cy0")) / 2).alias("moment"),
        F.sum(width).alias("width"),
        F.sum(F.when(crosses & (y_px > py), F.col("w")).otherwise(0.0)).alias("above"),
        F.sum(F.when(crosses, F.col("w")).otherwise(0.0)).alias("cross"),
        F.max(on_border).alias("on_border"),
    )
    # Down each column: one row per grid row at most.
    down = W.partitionBy(*COLUMN).orderBy(F.desc("ilat"))
    earlier = down.rowsBetween(W.unboundedPreceding, -1)
    summed = per_cell.select(
        *FEATURE, "ilon", F.col("ilat").alias("row"), "area", "moment", "above", "on_border",
        F.coalesce(F.sum("width").over(earlier), F.lit(0.0)).alias("from_above"),
        F.coalesce(F.sum("cross").over(earlier), F.lit(0.0)).alias("cross_above"),
        "width", "cross",
        F.coalesce(F.lead("ilat").over(down) + 1, F.lit(0)).alias("next_row"),
    )
    # Rows without an edge are filled where the polygon goes on below.
    goes_on = F.col("from_above") + F.col("width") > grid.lon_step / 2
    down_to = F.when(goes_on, F.least("row", "next_row")).otherwise(F.col("row"))
    cells = summed.select("*", F.explode(F.sequence(F.col("row"), down_to, F.lit(-1))).alias("ilat"))
    edge = F.col("ilat") == F.col("row")
    cy0, cy1 = grid.south(F.col("ilat")), grid.south(F.col("ilat") + 1)
    full = F.when(edge, F.col("from_above")).otherwise(F.col("from_above") + F.col("width"))
    height, half_squares = cy1 - cy0, (cy1 * cy1 - cy0 * cy0) / 2
    tiny = grid.lon_step * grid.lat_step * 1e-12
    area = full * height + F.when(edge, F.col("area")).otherwise(0.0)
    moment = full * half_squares + F.when(edge, F.col("moment")).otherwise(0.0)
    holds = F.when(
        edge, F.col("on_border") | (F.abs(F.col("cross_above") + F.col("above")) > 0.5)
    ).otherwise(F.abs(F.col("cross_above") + F.col("cross")) > 0.5)
    return cells.where(F.col("ilat") < grid.n_lat).select(
        *FEATURE, "ilat", "ilon",
        F.when(area > tiny, area).otherwise(0.0).alias("area"),
        F.when(area > tiny, moment).otherwise(0.0).alias("moment"),
        holds.alias("holds_centre"),
    )


def overlay_points(overlay: DataFrame) -> DataFrame:
    """One row per point of the point features."""
    return (
        overlay.where(F.col("geom_type").isin(POINT_TYPES))
        .select(*FEATURE, F.explode(F.flatten(F.flatten("parts"))).alias("p"))
        .select(*FEATURE, F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    )


def cells_around(x, y, grid: Grid, reach: float = 0.0):
    """Array of ``(ilat, ilon)`` whose closed box, widened by ``reach``, holds the point."""
    def span(v, first, step, n, spare):
        lo = F.greatest(F.lit(0), (F.ceil((v - spare - first) / step) - 1).cast("int"))
        hi = F.least(F.lit(n - 1), F.floor((v + spare - first) / step).cast("int"))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    rows = span(y, grid.lat0 - grid.lat_step / 2, grid.lat_step, grid.n_lat, reach)
    columns = span(x, grid.lon0 - grid.lon_step / 2, grid.lon_step, grid.n_lon, reach)
    return F.flatten(F.transform(rows, lambda r: F.transform(
        columns, lambda c: F.struct(r.alias("ilat"), c.alias("ilon"))
    )))


def point_groups(overlay: DataFrame, grid: Grid) -> DataFrame:
    """Point features grouped by the cells they touch: ``kind, cells, at_centre, n``.

    Points that touch the same cells meet the same events, so a place with very
    many of them is one row.
    """
    around = cells_around(F.col("x"), F.col("y"), grid)
    first = F.get("cells", F.lit(0))
    at_centre = (F.size("cells") == 1) & (grid.lon(first["ilon"]) == F.col("x")) & (
        grid.lat(first["ilat"]) == F.col("y")
    )
    per_feature = (
        overlay_points(overlay).select(*FEATURE, "x", "y", around.alias("cells"))
        .where(F.size("cells") > 0)
        .groupBy(*FEATURE).agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("cells")))).alias("cells"),
            F.array_distinct(F.flatten(F.collect_list(
                F.when(at_centre, F.col("cells")).otherwise(F.array().cast("array<struct<ilat:int,ilon:int>>"))
            ))).alias("centres"),
        )
    )
    return per_feature.groupBy("kind", "cells", "centres").agg(F.count(F.lit(1)).alias("n"))


def point_cover(overlay: DataFrame, grid: Grid) -> DataFrame:
    """Cells each point feature touches, in the layout of :func:`polygon_cover`."""
    around = F.explode(cells_around(F.col("x"), F.col("y"), grid)).alias("c")
    touched = overlay_points(overlay).select(*FEATURE, "x", "y", around).select(
        *FEATURE, F.col("c.ilat").alias("ilat"), F.col("c.ilon").alias("ilon"),
        ((grid.lon(F.col("c.ilon")) == F.col("x")) & (grid.lat(F.col("c.ilat")) == F.col("y"))).alias("at"),
    )
    return touched.groupBy(*FEATURE, "ilat", "ilon").agg(F.max("at").alias("holds_centre")).select(
        *FEATURE, "ilat", "ilon", F.lit(0.0).alias("area"), F.lit(0.0).alias("moment"), "holds_centre"
    )


def cover_cells(overlay: DataFrame, grid: Grid) -> DataFrame:
    """Touched cells of all features, points and polygons alike."""
    return polygon_cover(overlay, grid).unionByName(point_cover(overlay, grid))
