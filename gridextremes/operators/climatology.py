"""Day-of-year statistics per cell, and their join back to the days."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import cell_key
from .skew import tasks_for

DAYS = 366
LEAP_DAY = 60
# Windows and joins use the integer key: on the two doubles Spark would shuffle
# again for every operator, because it normalises floating-point keys.
CELL = ["cell", "lat", "lon"]
CLIM_ROWS = "lat double, lon double, doy int, seas double, thresh double"


def day_of_year(dt: Column) -> Column:
    return F.dayofyear(dt)


def _year_range(cube: DataFrame, first_year: int | None, last_year: int | None) -> DataFrame:
    if first_year is not None:
        cube = cube.where(F.col("dt") >= F.make_date(F.lit(first_year), F.lit(1), F.lit(1)))
    if last_year is not None:
        cube = cube.where(F.col("dt") <= F.make_date(F.lit(last_year), F.lit(12), F.lit(31)))
    return cube


def _fill_days(per_doy: DataFrame, values: list[str]) -> DataFrame:
    """Give every cell all days 1..366; added days carry NULL in ``values``.

    Each row also writes the days up to the next one present (the first row
    those before it), so no spine is joined and the partitioning by cell stays.
    """
    by_day = W.partitionBy("cell").orderBy("doy")
    first = F.when(F.lag("doy").over(by_day).isNull(), F.lit(1)).otherwise(F.col("doy"))
    last = F.coalesce(F.lead("doy").over(by_day) - 1, F.lit(DAYS))
    spread = per_doy.select("*", first.alias("_lo"), last.alias("_hi")).select(
        *CELL, "doy", *values, F.explode(F.sequence("_lo", "_hi")).alias("_d")
    )
    own = F.col("_d") == F.col("doy")
    return spread.select(
        *CELL, F.col("_d").alias("doy"),
        *[F.when(own, F.col(v)).alias(v) for v in values],
    )


def _pools(doy: np.ndarray, sst: np.ndarray, half_width: int, pctile: float) -> tuple[np.ndarray, ...]:
    """Mean and interpolated percentile of the values within ``half_width`` days of each day, and their number."""
    per_day = np.bincount(doy - 1, minlength=DAYS)
    upto = np.concatenate(([0], np.cumsum(per_day)))
    by_day = sst[np.argsort(doy, kind="stable")]
    # The year with its ends repeated on the far side: the pool of a day is one stretch of it.
    long = np.concatenate((by_day[upto[DAYS - half_width]:], by_day, by_day[:upto[half_width]]))
    bounds = np.concatenate(([0], np.cumsum(per_day[np.arange(-half_width, DAYS + half_width) % DAYS])))
    first, last = bounds[:DAYS, None], bounds[2 * half_width + 1:, None]
    size = (last - first)[:, 0]
    at = first + np.arange(size.max())
    pool = np.where(at < last, long[np.minimum(at, len(long) - 1)], np.nan)
    mean = np.where(at < last, pool, 0.0).sum(axis=1) / size
    pool.sort(axis=1)
    position = (size - 1) * pctile
    below = np.floor(position).astype(int)
    row = np.arange(DAYS)
    low, high = pool[row, np.maximum(below, 0)], pool[row, np.clip(below + 1, 0, np.maximum(size - 1, 0))]
    return mean, low + (high - low) * (position - below), size


def _smoothed(values: np.ndarray, known: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Circular running mean over the known values within ``half`` days, and where there is one."""
    days = np.arange(-half, DAYS + half) % DAYS
    total, n = (np.lib.stride_tricks.sliding_window_view(x[days], 2 * half + 1).sum(axis=1)
                for x in (np.where(known, values, 0.0), known))
    return total / n, n > 0


def _year_of_cell(half_width: int, smooth_width: int, pctile: float, fill_leap: bool) -> Callable[[pa.Table], pa.Table]:
    """The climatology of one cell's ``lat, lon, doy, sst`` rows as ``CLIM_ROWS``."""

    def year(rows: pa.Table) -> pa.Table:
        given = rows.select(["doy", "sst"]).drop_null()
        means, known = [np.zeros(DAYS)] * 2, np.zeros(DAYS, bool)
        with np.errstate(all="ignore"):
            if len(given):
                *means, size = _pools(given["doy"].to_numpy(), given["sst"].to_numpy(), half_width, pctile)
                known = size > 0
            if fill_leap:
                before, leap, after = LEAP_DAY - 2, LEAP_DAY - 1, LEAP_DAY
                known[leap] = known[before] and known[after]
                for m in means:
                    m[leap] = (m[before] + m[after]) / 2
            if (half := smooth_width // 2) > 0:
                (seas, sure), (thresh, _) = (_smoothed(m, known, half) for m in means)
                means, known = [seas, thresh], sure
        lat, lon = (np.full(DAYS, rows[c][0].as_py(), float) for c in ("lat", "lon"))
        return pa.table({
            "lat": lat, "lon": lon, "doy": np.arange(1, DAYS + 1, dtype=np.int32),
            **{c: pa.array(m, mask=~known) for c, m in zip(("seas", "thresh"), means)}})

    return year


def pooled_climatology(
    cube: DataFrame,
    first_year: int | None = None,
    last_year: int | None = None,
    half_width: int = 5,
    smooth_width: int = 31,
    pctile: float = 0.9,
    decimals: int | None = 6,
) -> DataFrame:
    """Mean and percentile per cell and day of year, pooled and smoothed.

    The pool of a day holds the values of all years within ``half_width`` days,
    on a circular year of 366 days; the smoothing is a circular running mean of
    ``smooth_width`` days. NULLs are left out of both.

    One shuffle, by coordinates, which no operator after it needs again; each
    cell's rows then come together once, as few columns as can be. A cell holds
    at most one row per day, so its size is bounded by the calendar.
    """
    if 2 * half_width + 1 > DAYS or smooth_width > DAYS:
        raise ValueError("the window is longer than the year")
    base = _year_range(cube, first_year, last_year).select(
        "lat", "lon", day_of_year(F.col("dt")).alias("doy"), "sst"
    )
    # Leap day: filled from its neighbours only if no cell has a value for it,
    # that is, if its pool is empty everywhere. The probe stops at one row.
    in_pool = [(LEAP_DAY - 1 + k) % DAYS + 1 for k in range(-half_width, half_width + 1)]
    fill_leap = base.where(F.col("doy").isin(in_pool) & F.col("sst").isNotNull()).isEmpty()
    years = (
        base.repartition(tasks_for(cube.sparkSession, base.count()), "lat", "lon")
        .groupBy("lat", "lon").applyInArrow(_year_of_cell(half_width, smooth_width, pctile, fill_leap), CLIM_ROWS)
    )
    return years.select("lat", "lon", "doy", *[
        (F.col(c) if decimals is None else F.round(c, decimals)).alias(c)
        for c in ("seas", "thresh")
    ])


def climatology_attrs(first_year: int, last_year: int, half_width: int = 5, smooth_width: int = 31,
                      pctile: float = 0.9, source_dataset: str = "", grid_resolution: str = "",
                      bbox: list[float] | None = None) -> dict:
    """What to store beside a climatology; ``pctile`` is kept in percent."""
    attrs = {
        "clim_start": first_year, "clim_end": last_year, "window_half_width": half_width,
        "smooth_width": smooth_width, "pctile": round(100 * pctile, 6), "source_dataset": source_dataset,
        "grid_resolution": grid_resolution, "units": "degC",
        "created_utc": datetime.now(timezone.utc).isoformat(timespec="seconds"),
    }
    return attrs if bbox is None else {**attrs, "bbox": list(bbox)}


def pooled_climatology_by_offsets(
    cube: DataFrame, first_year: int | None = None, last_year: int | None = None,
    half_width: int = 5, pctile: float = 0.9,
) -> DataFrame:
    """The unsmoothed pool the plain way: each value goes to all days it serves.

    Moves ``2 * half_width + 1`` copies of every value; kept to check
    :func:`pooled_climatology` against.
    """
    base = _year_range(cube, first_year, last_year)
    doy = day_of_year(F.col("dt"))
    shifted = base.select(
        "lat", "lon", "sst",
        F.explode(F.sequence(doy - half_width, doy + half_width)).alias("shifted"),
    ).withColumn("doy", F.pmod(F.col("shifted") - 1, F.lit(DAYS)) + 1)
    return shifted.groupBy("lat", "lon", "doy").agg(
        F.avg("sst").alias("seas"), F.percentile("sst", F.lit(pctile)).alias("thresh")
    )


def plain_climatology(cube: DataFrame, pctile: float = 0.9) -> DataFrame:
    """Mean and percentile per cell and calendar day of year, no pool or smoothing."""
    return cube.groupBy("lat", "lon", day_of_year(F.col("dt")).alias("doy")).agg(
        F.avg("sst").alias("seas"), F.percentile("sst", F.lit(pctile)).alias("thresh")
    )


def pack_climatology(clim: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per cell with the 366 values as arrays.

    Joining on the cell alone lets the join share the partitioning that the
    windows over a cell's days need; a join on (cell, doy) would not. ``tasks``
    is the number of partitions of the other side of that join.
    """
    keyed = clim.select(cell_key(), "lat", "lon", "doy", "seas", "thresh")
    keyed = keyed.repartition(tasks, "cell") if tasks else keyed.repartition("cell")
    rows = F.sort_array(F.collect_list(F.struct("doy", "seas", "thresh")))
    return _fill_days(keyed, ["seas", "thresh"]).groupBy("cell").agg(rows.alias("year")).select(
        "cell",
        F.col("year.seas").alias("seas_by_doy"),
        F.col("year.thresh").alias("thresh_by_doy"),
    )


def attach_by_day(cube: DataFrame, clim: DataFrame) -> DataFrame:
    """Add ``seas`` and ``thresh`` by a join on cell and day of year, for few days or cells."""
    days = clim.select(cell_key(), "doy", "seas", "thresh")
    keyed = cube.withColumns({"cell": cell_key(), "doy": F.least(F.lit(DAYS), day_of_year(F.col("dt")))})
    return keyed.join(days, ["cell", "doy"], "left").select(*cube.columns, "seas", "thresh")


def days_of_window(clim: DataFrame, start: date, end: date) -> DataFrame:
    """Only the days of the year a window has, where it is shorter than a year."""
    length = (end - start).days + 1
    if length >= DAYS:
        return clim
    days = {(start + timedelta(days=i)).timetuple().tm_yday for i in range(length)}
    return clim.where(F.col("doy").isin(sorted(days)))


def attach_baseline(cube: DataFrame, clim: DataFrame) -> DataFrame:
    """Add ``cell``, ``seas`` and ``thresh`` of the row's cell and day of year.

    The join leaves the rows partitioned by the cell, for callers that go on
    with windows per cell, in as many tasks as its rows need; they are counted first.
    """
    tasks = tasks_for(cube.sparkSession, cube.count())
    packed = pack_climatology(clim, tasks).hint("shuffle_hash")
    doy = F.least(F.lit(DAYS), day_of_year(F.col("dt")))
    return cube.withColumn("cell", cell_key()).repartition(tasks, "cell").join(packed, "cell", "left").select(
        "cell", *cube.columns,
        F.element_at("seas_by_doy", doy).alias("seas"),
        F.element_at("thresh_by_doy", doy).alias("thresh"),
    )


def slice_bbox(clim: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    x0, y0, x1, y1 = bbox
    return clim.where(F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1))
