"""Fields on the grid: anomalies, the derived cube, regridding, masks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import grid_category, grid_flag
from .climatology import CELL, attach_by_day, day_of_year
from .filters import on_day
from .grid import cell_key
from .skew import tasks_for

UPSAMPLING = 4


def anomaly(cube: DataFrame, clim: DataFrame, day: date) -> DataFrame:
    """``sst`` minus the seasonal mean, per cell of one day."""
    that_day = clim.where(F.col("doy") == F.dayofyear(F.lit(day).cast("date")))
    rows = attach_by_day(on_day(cube, day).select("dt", "lat", "lon", "sst"), that_day)
    return rows.select("dt", "lat", "lon", (F.col("sst") - F.col("seas")).alias("anomaly"))


def derived_cube(cube: DataFrame, pctile: float = 0.9, decimals: int = 6) -> DataFrame:
    """Six variables per cell and day: value, plain day-of-year mean and
    percentile, anomaly, flag and category.

    Mean and percentile are taken over a window per (cell, day of year), as long
    as there are years: one shuffle, nothing to join back. Both are rounded, so
    that the order of summation never moves a value across a category border. Cells
    are dealt in ranges, to tasks by rows, so the result can be stored as it lies.
    """
    peers = W.partitionBy(*CELL, "doy")
    rows = cube.select(
        "dt", cell_key(), "lat", "lon", day_of_year(F.col("dt")).alias("doy"), "sst"
    ).repartitionByRange(tasks_for(cube.sparkSession, cube.count()), "cell").select(
        "dt", "lat", "lon", "sst", F.round(F.avg("sst").over(peers), decimals).alias("mean"),
        F.round(F.percentile("sst", F.lit(pctile)).over(peers), decimals).alias("high"),
    )
    sst, mean, high = F.col("sst"), F.col("mean"), F.col("high")
    return rows.select(
        "dt", "lat", "lon", sst.cast("float").alias("sst"),
        mean.cast("float").alias("climatology"), high.cast("float").alias("threshold_90p"),
        (sst - mean).cast("float").alias("anomaly"),
        grid_flag(sst, high).alias("mhw_flag"), grid_category(sst, mean, high).alias("mhw_category"),
    )


def axis_brackets(source: DataFrame, target: DataFrame, axis: str) -> DataFrame:
    """Weights of the two source coordinates around each target coordinate.

    ``axis`` is the source coordinate, ``to`` the target, ``w`` the weight. A
    target outside the source hangs on the first source coordinate alone, so it
    is known but never has both corners. One row per coordinate of one axis goes
    through the unpartitioned windows.
    """
    least = source.agg(F.min(axis).alias("x")).scalar()
    s = source.select(F.col(axis).alias("x")).distinct()
    s = s.select("x", F.lag("x").over(W.orderBy("x")).alias("before"), F.lead("x").over(W.orderBy("x")).alias("after"))
    t = target.select(F.col(axis).alias("to")).distinct()
    merged = s.select("x", "before", "after", F.lit(None).cast("double").alias("to")).unionByName(
        t.select(F.col("to").alias("x"), F.lit(None).cast("double").alias("before"),
                 F.lit(None).cast("double").alias("after"), "to")
    )
    # The first source at or after the target, with its predecessor; the first
    # source of all brackets with its successor.
    scan = W.orderBy(F.col("x").desc(), F.col("to").isNull().desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    here = F.when(F.col("to").isNull(), F.struct("x", "before", "after"))
    found = merged.select("x", "to", F.last(here, ignorenulls=True).over(scan).alias("s")).where(
        F.col("to").isNotNull()
    )
    lo = F.when(F.col("s.before").isNotNull(), F.col("s.before")).when(F.col("to") == F.col("s.x"), F.col("s.x"))
    hi = F.when(F.col("s.before").isNotNull(), F.col("s.x")).otherwise(F.col("s.after"))
    placed = found.select("to", lo.alias("lo"), hi.alias("hi"))
    w = (F.col("to") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    pair = F.array(
        F.struct(F.col("lo").alias("x"), (1 - w).alias("w")), F.struct(F.col("hi").alias("x"), w.alias("w"))
    )
    outside = F.array(F.struct(least.alias("x"), F.lit(0.0).alias("w")))
    inside = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    return placed.select("to", F.explode(F.when(inside, pair).otherwise(outside)).alias("p")).select(F.col("p.x").alias(axis), "to", F.col("p.w").alias("w"))


def regrid_bilinear(slab: DataFrame, target: DataFrame, value: str = "sst", label: str | None = None) -> DataFrame:
    """Bilinear interpolation onto the cells of ``target`` (``lat, lon``).

    Every source value is sent, with its weight, to the few targets it serves;
    a target with a missing corner, or outside the source, is NULL. A day needs
    a row for every source cell, with NULL where there is no value. ``label`` is a
    column of which each cell and day takes the smallest among the corners that count.
    """
    cells = target.select("lat", "lon").distinct()
    by_lat = axis_brackets(slab, cells, "lat").withColumnsRenamed({"to": "to_lat", "w": "w_lat"})
    by_lon = axis_brackets(slab, cells, "lon").withColumnsRenamed({"to": "to_lon", "w": "w_lon"})
    # The brackets have two rows per coordinate of an axis, so they are broadcast.
    # The wanted cells come in by the integer key, which also serves the grouping.
    sent = (
        slab.select("dt", "lat", "lon", F.col(value).alias("v"), (F.col(label) if label else F.lit(None)).alias("label"))
        .join(F.broadcast(by_lat), "lat").join(F.broadcast(by_lon), "lon")
        .select("dt", F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon"), "v", "label", "w_lat", "w_lon")
        .withColumn("cell", cell_key())
        .join(cells.select(cell_key()), "cell", "left_semi")
    )
    # A value serves four cells at most. They are dealt before they are summed: the corners of
    # a cell lie in different tasks, where sums would only be held and save no row.
    dealt = sent.repartition(tasks_for(slab.sparkSession, 4 * slab.count()), "cell")
    summed = dealt.groupBy("cell", "lat", "lon", "dt").agg(
        F.sum(F.col("v") * F.col("w_lat") * F.col("w_lon")).alias("total"), F.count("v").alias("corners"),
        *([F.min(F.when(F.col("w_lat") * F.col("w_lon") > 0, F.col("label"))).alias(label)] if label else []),
    )
    return summed.select(
        "dt", "lat", "lon", F.when(F.col("corners") == 4, F.col("total")).alias(value), *([label] if label else []))


def upsample_bilinear(field: DataFrame, n_lat: int, n_lon: int, value: str = "anomaly",
                      factor: int = UPSAMPLING) -> DataFrame:
    """``factor`` times finer field by index: ``row, col, value, missing``.

    ``field`` has ``ilat, ilon`` and a value; missing values count as 0 while
    smoothing, and the missing mask is carried over from the nearest cell.
    """
    def spread(index, n):
        # Output o sits at (o + 0.5) / factor - 0.5; a cell reaches one cell far,
        # and the outermost cells also stand in for what lies beyond the edge.
        o = F.sequence(
            F.greatest(F.lit(0), (index - 1) * factor), F.least(F.lit(n * factor - 1), (index + 2) * factor - 1)
        )

        def weight(k):
            at = (k + 0.5) / factor - 0.5
            clipped = F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), at))
            return F.greatest(F.lit(0.0), 1 - F.abs(clipped - index))

        return F.filter(
            F.transform(o, lambda k: F.struct(
                k.alias("o"), weight(k).alias("w"), (F.floor(k / factor) == index).alias("own")
            )),
            lambda s: s["w"] > 0,
        )

    rows = field.select(
        "ilat", "ilon", F.col(value).alias("v"), F.explode(spread(F.col("ilat"), n_lat)).alias("r")
    ).select("*", F.explode(spread(F.col("ilon"), n_lon)).alias("c"))
    own = F.col("r.own") & F.col("c.own")
    return rows.groupBy(F.col("r.o").alias("row"), F.col("c.o").alias("col")).agg(
        F.sum(F.coalesce("v", F.lit(0.0)) * F.col("r.w") * F.col("c.w")).alias("value"),
        F.coalesce(F.bool_or(F.when(own, F.col("v").isNull())), F.lit(True)).alias("missing"),
    )


def grow_mask(mask: DataFrame, n_lat: int, n_lon: int) -> DataFrame:
    """A mask of ``ilat, ilon`` grown by one cell in the four directions."""
    steps = F.array(*[
        F.struct((F.col("ilat") + dy).alias("ilat"), (F.col("ilon") + dx).alias("ilon"))
        for dy, dx in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))
    ])
    return (
        mask.select(F.explode(steps).alias("c")).select("c.*")
        .where(F.col("ilat").between(0, n_lat - 1) & F.col("ilon").between(0, n_lon - 1)).distinct()
    )


def apply_mask(field: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells of ``field`` that are not masked."""
    return field.join(mask, ["ilat", "ilon"], "left_anti")
