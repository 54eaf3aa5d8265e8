"""The regular grid: its axes, cell indices and cell boxes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_STEP = 0.25
OFF_LATTICE = 0.01  # steps that a coordinate may lie beside the lattice


def cell_key() -> Column:
    """The cell of a row as one integer, exact to a millionth of a degree."""
    # Half up as F.round, which would go through a decimal for every row.
    lat = F.floor((F.col("lat") + 90) * 1_000_000 + 0.5)
    lon = F.floor((F.col("lon") + 180) * 1_000_000 + 0.5)
    return (F.shiftleft(lat, 30) + lon).alias("cell")


@dataclass(frozen=True)
class Grid:
    """Origin, step and length of the two axes of a regular grid."""

    lat0: float
    lat_step: float
    n_lat: int
    lon0: float
    lon_step: float
    n_lon: int

    def ilat(self, lat: Column) -> Column:
        return F.round((lat - self.lat0) / self.lat_step).cast("int")

    def ilon(self, lon: Column) -> Column:
        return F.round((lon - self.lon0) / self.lon_step).cast("int")

    def lat(self, ilat: Column) -> Column:
        return F.lit(self.lat0) + ilat * self.lat_step

    def lon(self, ilon: Column) -> Column:
        return F.lit(self.lon0) + ilon * self.lon_step

    def south(self, ilat: Column) -> Column:
        return F.lit(self.lat0 - self.lat_step / 2) + ilat * self.lat_step

    def west(self, ilon: Column) -> Column:
        return F.lit(self.lon0 - self.lon_step / 2) + ilon * self.lon_step

    def box(self, ilat: Column, ilon: Column) -> Column:
        return F.struct(
            self.west(ilon).alias("x0"), self.south(ilat).alias("y0"),
            self.west(ilon + 1).alias("x1"), self.south(ilat + 1).alias("y1"),
        )

    def stride(self, max_cells: int | None) -> int:
        """Step of a decimation that leaves about ``max_cells`` cells."""
        if not max_cells:
            return 1
        return max(1, math.ceil(math.sqrt(self.n_lat * self.n_lon / max_cells)))


def grid_of(df: DataFrame) -> Grid:
    """Axes of the grid a cube or climatology lies on; rows or columns may be missing.

    The step is the smallest distance; a coordinate off the lattice is an error.
    Distinct coordinates are combined map-side; what comes back is one row.
    """
    axes = (
        df.select(F.explode(F.array(
            F.struct(F.lit("lat").alias("axis"), F.col("lat").alias("v")),
            F.struct(F.lit("lon").alias("axis"), F.col("lon").alias("v")),
        )).alias("a"))
        .select("a.*").distinct()
    )
    # One row per distinct coordinate of an axis: as many as the axis is long.
    along = W.partitionBy("axis")
    gaps = axes.withColumn("gap", F.col("v") - F.lag("v").over(along.orderBy("v")))
    first, last = F.min("v").over(along), F.max("v").over(along)
    spaced = gaps.select("axis", "v", first.alias("first"), last.alias("last"), F.min("gap").over(along).alias("gap"))
    # The smallest gap may carry rounding; the whole axis over its number of steps does not.
    steps = F.coalesce(F.round((F.col("last") - F.col("first")) / F.col("gap")), F.lit(0)).cast("int")
    step = F.when(steps > 0, (F.col("last") - F.col("first")) / steps).otherwise(F.lit(DEFAULT_STEP))
    at = (F.col("v") - F.col("first")) / F.col("step")
    rows = spaced.withColumn("steps", steps).withColumn("step", step).groupBy("axis").agg(
        F.min("first").alias("first"), F.min("step").alias("step"), F.min("steps").alias("steps"),
        F.max(F.abs(at - F.round(at))).alias("off"),
    ).collect()
    if not rows:
        raise ValueError("no cells: the grid cannot be inferred")
    for r in rows:
        if r["off"] > OFF_LATTICE:
            raise ValueError(f"{r['axis']} is no regular axis: a coordinate lies {r['off']:.3f} steps beside it")
    found = {r["axis"]: (r["first"], r["step"], r["steps"] + 1) for r in rows}
    return Grid(*found["lat"], *found["lon"])


def decimate(df: DataFrame, grid: Grid, max_cells: int | None) -> DataFrame:
    """Keep every n-th row and column so that about ``max_cells`` cells remain."""
    step = grid.stride(max_cells)
    if step == 1:
        return df
    return df.where(
        (grid.ilat(F.col("lat")) % step == 0) & (grid.ilon(F.col("lon")) % step == 0)
    )


def nearest_on_axis(targets: DataFrame, sources: DataFrame, axis: str) -> DataFrame:
    """For each distinct target coordinate the nearest source coordinate.

    Two ordered scans over the merged axis; ties go to the larger coordinate.
    The window has no partition key, and holds one row per distinct coordinate
    of one axis, never a row per cell or day.
    """
    t = targets.select(F.col(axis).alias("x")).distinct().withColumn("s", F.lit(None).cast("double"))
    s = sources.select(F.col(axis).alias("x")).distinct().withColumn("s", F.col("x"))
    merged = s.unionByName(t)
    upto = W.rangeBetween(W.unboundedPreceding, W.currentRow)
    below = merged.withColumn(
        "below", F.max("s").over(upto.orderBy("x"))
    ).withColumn(
        "above", F.min("s").over(upto.orderBy(F.col("x").desc()))
    ).where(F.col("s").isNull())
    gap_below = F.col("x") - F.col("below")
    gap_above = F.col("above") - F.col("x")
    nearest = (
        F.when(F.col("below").isNull() | (gap_above <= gap_below), F.col("above"))
        .otherwise(F.col("below"))
    )
    return below.select(F.col("x").alias(axis), nearest.alias(f"near_{axis}"))


def align_nearest(clim: DataFrame, cells: DataFrame) -> DataFrame:
    """Move a climatology to the cells of another grid, nearest per axis."""
    cells = cells.select("lat", "lon").distinct()
    lat_map = nearest_on_axis(cells, clim, "lat")
    lon_map = nearest_on_axis(cells, clim, "lon")
    # One row per coordinate of an axis: bounded by the grid, so broadcast.
    mapped = cells.join(F.broadcast(lat_map), "lat").join(F.broadcast(lon_map), "lon")
    source = clim.withColumnsRenamed({"lat": "near_lat", "lon": "near_lon"})
    return mapped.join(source, ["near_lat", "near_lon"]).drop("near_lat", "near_lon")


def align_to_grid(clim: DataFrame, grid: Grid) -> DataFrame:
    """The same onto all cells of a grid, without a shuffle of the climatology.

    Grid coordinates are matched per axis; the two matches are as long as the
    axes and are broadcast. On the climatology's own grid nothing moves.
    """
    spark = clim.sparkSession
    i = F.col("id")
    lats = spark.range(grid.n_lat).select(grid.lat(i).alias("lat"))
    lons = spark.range(grid.n_lon).select(grid.lon(i).alias("lon"))
    source = clim.withColumnsRenamed({"lat": "near_lat", "lon": "near_lon"})
    return (
        source.join(F.broadcast(nearest_on_axis(lats, clim, "lat")), "near_lat")
        .join(F.broadcast(nearest_on_axis(lons, clim, "lon")), "near_lon")
        .select(*clim.columns)
    )
