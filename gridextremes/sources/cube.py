"""Reading cubes, climatologies, landed slabs and exported events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import to_celsius
from ..operators.filters import cells_in_bbox
from ..schemas import CLIM, CUBE

# --- fixed values: names found in landed files, in order of preference ---------
VALUE_NAMES = ["analysed_sst", "sst", "thetao"]
LAT_NAMES = ["lat", "latitude", "nav_lat"]
LON_NAMES = ["lon", "longitude", "nav_lon"]
DEPTH_NAMES = ["depth", "deptht", "nav_dep", "lev"]
SURFACE_DEPTH_M = 1.02
# ----------------------------------------------------------------------------


def without_nan(df: DataFrame, *columns: str) -> DataFrame:
    """NaN becomes NULL: Spark sorts NaN above every number."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns})


def read_cube(spark: SparkSession, path: str, start: date | None = None, end: date | None = None,
              bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Cube stored by year, cut to an inclusive date range and a box.

    The range is stated for the ``year`` folders too, since Spark does not
    derive a partition filter from ``dt``.
    """
    cube = spark.read.parquet(path)
    has_year = "year" in cube.columns
    if start is not None:
        cube = cube.where(F.col("dt") >= F.lit(start).cast("date"))
        if has_year:
            cube = cube.where(F.col("year") >= start.year)
    if end is not None:
        cube = cube.where(F.col("dt") <= F.lit(end).cast("date"))
        if has_year:
            cube = cube.where(F.col("year") <= end.year)
    if bbox is not None:
        cube = cells_in_bbox(cube, bbox)
    return without_nan(cube.select(*CUBE.fieldNames()), "sst")


def read_climatology(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Climatology rows and the attributes stored beside them."""
    attrs = spark.read.json(f"{path}/attrs").first()
    clim = spark.read.schema(CLIM).parquet(f"{path}/clim")
    return without_nan(clim, "seas", "thresh"), attrs.asDict() if attrs else {}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Exported events; date columns stored as text become dates, bad ones NULL."""
    df = spark.read.parquet(path)
    dates = [c for c in ("date_start", "date_end", "date_peak") if c in df.columns]
    return df.withColumns({c: F.try_to_date(F.col(c).cast("string")) for c in dates})


def pick_column(df: DataFrame, names: list[str], what: str) -> str:
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"no {what} column: looked for {', '.join(names)}")


def surface_level(slab: DataFrame) -> DataFrame:
    """Rows of the depth level nearest to the surface depth, without the depth.

    The level is chosen once for the slab; of two equally near the deeper one.
    """
    names = [c for c in DEPTH_NAMES if c in slab.columns]
    if not names:
        return slab
    depth = F.col(names[0])
    gap = F.struct(F.abs(depth - SURFACE_DEPTH_M), -depth)
    level = slab.where(depth.isNotNull()).agg(F.min_by(depth, gap).alias("level")).scalar()
    return slab.where(depth.isNull() | (depth == level)).drop(names[0])


def harmonise(slab: DataFrame, product: str = "nrt", target: DataFrame | None = None,
              method: str = "nearest") -> DataFrame:
    """A landed slab in the CUBE layout: names, surface level, °C, NULLs.

    ``target`` (``lat, lon``) moves it onto other cells, by the nearest value
    or, with ``method='bilinear'``, by interpolation.
    """
    value = pick_column(slab, VALUE_NAMES, "value")
    lat, lon = pick_column(slab, LAT_NAMES, "latitude"), pick_column(slab, LON_NAMES, "longitude")
    day = pick_column(slab, ["time", "dt"], "time")
    level = surface_level(slab)
    units = F.col("units") if "units" in slab.columns else F.lit("degC")
    cube = level.select(
        F.to_date(day).alias("dt"), F.col(lat).cast("double").alias("lat"),
        F.col(lon).cast("double").alias("lon"),
        to_celsius(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")), units).alias("sst"),
    )
    if target is not None:
        cube = _onto(cube, target, method)
    return cube.select(*[F.col(c) for c in ("dt", "lat", "lon", "sst")], F.lit(product).alias("product"))


def _onto(cube: DataFrame, target: DataFrame, method: str) -> DataFrame:
    from ..operators.grid import nearest_on_axis
    from ..operators.raster import regrid_bilinear

    if method == "bilinear":
        return regrid_bilinear(cube, target)
    cells = target.select("lat", "lon").distinct()
    by_cell = cells.join(F.broadcast(nearest_on_axis(cells, cube, "lat")), "lat").join(
        F.broadcast(nearest_on_axis(cells, cube, "lon")), "lon"
    )
    return cube.withColumnsRenamed({"lat": "near_lat", "lon": "near_lon"}).join(
        by_cell, ["near_lat", "near_lon"]
    ).select("dt", "lat", "lon", "sst")
