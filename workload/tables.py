"""Cube, overlays, farms, coast and class cells, derived from the given tables.

Every supplier is one grid cell, so the cube grows with the data: one row per
supplier and day. The grid is as square as it can be; its step is 0.75 degrees,
halved until the region is at most 36 degrees wide, so it is exact in binary.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridextremes.operators.climatology import pooled_climatology
from gridextremes.operators.cluster import Clusters, cluster_events
from gridextremes.operators.detect import detect_events
from gridextremes.operators.grid import Grid, grid_of
from gridextremes.operators.impact import OverlayIndex, index_overlay
from gridextremes.operators.skew import tasks_for
from gridextremes.session import materialise

LAT0, LON0, STEP, MAX_SPAN = 34.0, 4.0, 0.75, 36.0

_landed: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build):
    """Build a table once per Spark application; later queries read the copy."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _landed:
        _landed[key] = build()
    return _landed[key]


def forget() -> None:
    """Make the next query build everything anew."""
    _landed.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession, sf_dir: str) -> int:
    """Cells per side of the grid, from the largest supplier key."""
    def build() -> int:
        n = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0] + 1
        return math.ceil(math.sqrt(n))

    return _once(spark, sf_dir, "width", build)


def step_of(w: int) -> float:
    """Step of a grid of ``w`` cells per side."""
    return STEP / 2 ** max(0, math.ceil(math.log2(w * STEP / MAX_SPAN)))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, r, c, lat, lon`` of every supplier."""
    w = width(spark, sf_dir)
    step = step_of(w)
    placed = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"),
        F.floor(F.col("s_suppkey") / w).cast("long").alias("r"), (F.col("s_suppkey") % w).alias("c"),
    )
    return placed.select(
        "k", "r", "c",
        (F.lit(LAT0) + F.lit(step) * F.col("r")).alias("lat"),
        (F.lit(LON0) + F.lit(step) * F.col("c")).alias("lon"),
    )


def _present(spark: SparkSession, sf_dir: str, column: str) -> tuple[DataFrame, date | None]:
    """Sum of ``column`` and count per supplier and day with lines, and the last day of all.

    Lines are summed per (supplier, day) first, so a supplier with most of the
    lines is no larger than the calendar. Every supplier has a row on the first
    day, of zeros if it has no line there.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("dt"), F.col(column).alias("v")
    )
    lo, hi = lines.agg(F.min("dt"), F.max("dt")).first()
    n_cells = table(spark, sf_dir, "supplier").count()
    tasks = tasks_for(spark, n_cells * ((hi - lo).days + 1) if lo else 0)
    seeds = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), F.lit(lo).cast("date").alias("dt"),
        F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"),
    )
    summed = lines.groupBy("k", "dt").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    return (
        summed.unionByName(seeds).repartition(tasks, "k")
        .groupBy("k", "dt").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    ), hi


DAY_SUMS = pa.schema([("k", pa.int64()), ("dt", pa.date32()), ("sw", pa.float64()), ("nw", pa.int64()),
                      ("lat", pa.float64()), ("lon", pa.float64())])


def _sums_of_days(last: int, span: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For one supplier's ``k, dt, s, n`` rows and its cells: sums over ``span`` days, on every day up to ``last``."""

    def sums(rows: pa.Table, at: pa.Table) -> pa.Table:
        rows = rows.filter(rows["dt"].is_valid())
        day = rows["dt"].cast(pa.int32()).to_numpy()
        first = int(day.min()) if len(day) and at["k"].null_count == 0 else last + 1
        n_days = last + 1 - first
        s, n, known = np.zeros(n_days), np.zeros(n_days, np.int64), np.ones(n_days, bool)
        if n_days:
            s[day - first] = rows["s"].fill_null(0.0).to_numpy()
            n[day - first] = rows["n"].to_numpy()
            known[day - first] = rows["s"].is_valid().to_numpy()
        sw, nw, any_known = np.zeros(n_days), np.zeros(n_days, np.int64), np.zeros(n_days, bool)
        for back in range(min(span, n_days) - 1, -1, -1):  # from the earliest day on
            sw[back:] += s[:n_days - back]
            nw[back:] += n[:n_days - back]
            any_known[back:] |= known[:n_days - back]
        days = {
            "dt": pa.array(np.arange(first, last + 1, dtype=np.int32)).cast(pa.date32()),
            "sw": pa.array(sw, mask=~any_known), "nw": nw,
        }
        # One cell per supplier; a repeated supplier gives its days as often.
        return pa.concat_tables([pa.table({"k": np.full(n_days, cell["k"], np.int64), **days,
                                           "lat": np.full(n_days, cell["lat"], float), "lon": np.full(n_days, cell["lon"], float)})
                                 for cell in at.to_pylist()] or [DAY_SUMS.empty_table()])

    return sums


def _summed_days(spark: SparkSession, sf_dir: str, column: str, span: int) -> DataFrame:
    """``DAY_SUMS`` of every supplier and day: sum and count over the last ``span`` days.

    Only days with lines are moved; the days between are written where a
    supplier's rows and its cell come together.
    """
    present, last = _present(spark, sf_dir, column)
    until = (last - date(1970, 1, 1)).days if last else -1
    here = cells(spark, sf_dir).select(F.col("k").cast("long").alias("k"), "lat", "lon")
    return present.groupBy("k").cogroup(here.groupBy("k")).applyInArrow(
        _sums_of_days(until, span), "k long, dt date, sw double, nw long, lat double, lon double")


def daily(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """Sum of ``column`` and count per supplier and day, zero on empty days."""
    return _summed_days(spark, sf_dir, column, 1).select("k", "dt", F.col("sw").alias("s"), F.col("nw").alias("n"))


def _trailing(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """The sums over a day and the 14 before it, with the cell."""
    return _summed_days(spark, sf_dir, column, 15)


def build_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _trailing(spark, sf_dir, "l_quantity")
    doy = F.dayofyear("dt")
    season = F.lit(15.0) + F.lit(10.0) * (F.lit(1.0) - F.abs(doy - 213) / F.lit(213.0))
    sst = season + F.lit(0.1) * (F.col("sw") / F.col("nw") - F.lit(25.5))
    missing = (F.col("nw") == 0) | (
        (F.datediff("dt", F.lit("1995-01-01").cast("date")) + F.col("k")) % 97 == 0
    )
    return rows.select(
        "dt", "lat", "lon", F.when(~missing, sst).alias("sst"), F.lit("nrt").alias("product")
    )


def build_salinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second variable of the cube, from the discounts; no value where no line is near."""
    rows = _trailing(spark, sf_dir, "l_discount")
    value = F.lit(38.0) - F.lit(10.0) * (F.round(F.col("sw"), 2) / F.col("nw") - F.lit(0.05))
    return rows.select("dt", "lat", "lon", F.when(F.col("nw") > 0, value).alias("sal"))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "cube", lambda: materialise(build_cube(spark, sf_dir), "cube"))


def grid(spark: SparkSession, sf_dir: str) -> Grid:
    return _once(spark, sf_dir, "grid", lambda: grid_of(cells(spark, sf_dir)))


def climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark, sf_dir, "clim",
        lambda: materialise(pooled_climatology(cube(spark, sf_dir)), "clim"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark, sf_dir, "events",
        lambda: materialise(
            detect_events(cube(spark, sf_dir), climatology(spark, sf_dir), grid=grid(spark, sf_dir)),
            "events",
        ),
    )


def clusters(spark: SparkSession, sf_dir: str) -> Clusters:
    return _once(spark, sf_dir, "clusters", lambda: cluster_events(events(spark, sf_dir)))


# Places are laid out on fractions of a degree that doubles hold exactly, inside
# the region of the grid; many lie on borders and centres of cells.

def _region(spark: SparkSession, sf_dir: str) -> float:
    """Side of the grid in standard steps, exact in binary: places lie where cells are, at any size."""
    w = width(spark, sf_dir)
    return w * step_of(w) / STEP


def _x(key, factor: int, per_cell: int, m: float):
    return F.lit(LON0 - STEP / 2) + (key * factor) % math.floor(m * per_cell) * F.lit(STEP / per_cell)


def _y(key, factor: int, shift: int, per_cell: int, m: float):
    return F.lit(LAT0 - STEP / 2) + (key * factor + shift) % math.floor(m * per_cell) * F.lit(STEP / per_cell)


def _point(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def _rectangles(df: DataFrame, kind: str, width: float, height: float, props) -> DataFrame:
    x0, y0 = F.col("x0"), F.col("y0")
    x1, y1 = x0 + width, y0 + height
    ring = F.array(_point(x0, y0), _point(x1, y0), _point(x1, y1), _point(x0, y1), _point(x0, y0))
    return df.select(
        F.lit(kind).alias("kind"), "feature_id", props.alias("props"), F.lit("Polygon").alias("geom_type"),
        F.array(F.array(ring)).alias("parts"),
        x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point sites: one per supplier."""
    m, k = _region(spark, sf_dir), F.col("s_suppkey")
    x, y = _x(k, 37, 4, m), _y(k, 53, 1, 4, m)
    return table(spark, sf_dir, "supplier").select(
        F.lit("aquaculture").alias("kind"), F.concat(F.lit("site-"), k.cast("string")).alias("feature_id"),
        F.create_map(F.lit("name"), F.col("s_name")).alias("props"), F.lit("Point").alias("geom_type"),
        F.array(F.array(F.array(_point(x, y)))).alias("parts"),
        x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"),
    )


def protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected rectangles: one per nation."""
    m, k = _region(spark, sf_dir), F.col("n_nationkey").cast("long")
    rows = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("mpa-"), k.cast("string")).alias("feature_id"), "n_name", "n_regionkey",
        _x(k, 7, 4, m).alias("x0"), _y(k, 11, 3, 4, m).alias("y0"),
    )
    props = F.create_map(
        F.lit("SITECODE"), F.upper("n_name"), F.lit("SITENAME"), F.col("n_name"),
        F.lit("MS"), F.col("n_regionkey").cast("string"), F.lit("SITETYPE"), F.lit("B"),
        F.lit("Area_ha"), F.lit("1250.5"),
    )
    return _rectangles(rows, "mpa", 0.65625, 0.46875, props)


def habitats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Habitat rectangles: one per part."""
    m, k = _region(spark, sf_dir), F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("bed-"), k.cast("string")).alias("feature_id"), "p_name",
        _x(k, 29, 12, m).alias("x0"), _y(k, 31, 5, 12, m).alias("y0"),
    )
    return _rectangles(rows, "seagrass", 0.25, 0.1875, F.create_map(F.lit("name"), F.col("p_name")))


KINDS = ["aquaculture", "mpa", "seagrass"]


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).unionByName(protected(spark, sf_dir)).unionByName(habitats(spark, sf_dir))


def index(spark: SparkSession, sf_dir: str) -> OverlayIndex:
    return _once(
        spark, sf_dir, "index", lambda: index_overlay(overlay(spark, sf_dir), grid(spark, sf_dir))
    )


def farms(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = _region(spark, sf_dir), F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("farm-"), k.cast("string")).alias("id"),
        _x(k, 31, 48, m).alias("lon"), _y(k, 47, 7, 48, m).alias("lat"),
    )


SEABED = ["rock", "sand", "mud", "biogenic"]


def class_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = _region(spark, sf_dir), F.col("p_partkey")
    seabed = F.element_at(F.array(*[F.lit(c) for c in SEABED]), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        _x(k, 13, 8, m).alias("lon"), _y(k, 17, 2, 8, m).alias("lat"),
        seabed.alias("class"), (F.col("p_retailprice") / 1000).alias("rate"),
    )


def coast(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = _region(spark, sf_dir), F.col("o_orderkey")
    state = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "eroding")
        .when(F.col("o_orderpriority") == "2-HIGH", "accreting").otherwise("stable")
    )
    return table(spark, sf_dir, "orders").select(
        k.alias("seg_id"), _x(k, 19, 48, m).alias("lon"), _y(k, 23, 5, 48, m).alias("lat"),
        state.alias("class"), (F.col("o_totalprice") / 100000).alias("length_km"),
    )


def slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed slab as a provider would send it: other names, depth levels, kelvin."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k")
    return lines.join(cells(spark, sf_dir), "k").select(
        F.col("l_shipdate").alias("time"), (F.col("l_linenumber") * 0.5).alias("depth"),
        F.col("lat").alias("nav_lat"), F.col("lon").alias("nav_lon"),
        (F.col("l_quantity") + 273.15).alias("thetao"), F.lit(" Kelvin ").alias("units"),
    )
