import math
from datetime import date

import numpy as np
import pytest
from helpers import cube_of
from pyspark.sql import functions as F

from gridextremes.operators import climatology as K
from gridextremes.operators.grid import align_nearest, cell_key, grid_of, nearest_on_axis


def two_years(spark, f, cells=((40.0, 10.0),), start=date(2021, 1, 1), n=730):
    return cube_of(spark, {c: [f(i) for i in range(n)] for c in cells}, start)


def as_map(df):
    return {r["doy"]: (r["seas"], r["thresh"]) for r in df.collect()}


def test_constant(spark):
    got = as_map(K.pooled_climatology(two_years(spark, lambda i: 20.0)))
    assert sorted(got) == list(range(1, 367)) and set(got.values()) == {(20.0, 20.0)}


def test_cosine_phase(spark):
    cube = two_years(spark, lambda i: 15 + 5 * math.cos(2 * math.pi * (i % 365) / 365))
    seas = {d: v[0] for d, v in as_map(K.pooled_climatology(cube)).items()}
    assert abs(max(seas, key=seas.get) - 1) <= 2 or max(seas, key=seas.get) >= 364
    assert abs(min(seas, key=seas.get) - 183) <= 2 and 4.5 < max(seas.values()) - 15 < 5


def test_numpy_agrees_with_holes(spark):
    rng = np.random.default_rng(1)
    values = [None if rng.random() < 0.2 else float(v) for v in rng.normal(15, 3, 1000)]
    start = date(2019, 3, 1)
    cube = cube_of(spark, {(40.0, 10.0): values}, start)
    got = as_map(K.pooled_climatology(cube, decimals=None))
    doy = np.array([r[0] for r in cube.select(F.dayofyear("dt")).collect()])
    v = np.array([np.nan if x is None else x for x in values])
    seas, high = np.empty(366), np.empty(366)
    for d in range(366):
        window = [(d + k) % 366 + 1 for k in range(-5, 6)]
        pool = v[np.isin(doy, window)]
        seas[d], high[d] = np.nanmean(pool), np.nanpercentile(pool, 90)
    for d in range(366):
        around = [(d + k) % 366 for k in range(-15, 16)]
        assert got[d + 1][0] == pytest.approx(seas[around].mean(), abs=1e-9)
        assert got[d + 1][1] == pytest.approx(high[around].mean(), abs=1e-9)


def test_both_forms_of_the_pool_agree(spark):
    rng = np.random.default_rng(2)
    cube = cube_of(spark, {(40.0, 10.0): rng.normal(15, 3, 800).tolist(), (40.0, 11.0): rng.normal(9, 1, 800).tolist()}, date(2020, 1, 1))
    a = K.pooled_climatology(cube, smooth_width=1, decimals=9)
    b = K.pooled_climatology_by_offsets(cube).select(
        "lat", "lon", F.col("doy").cast("int").alias("doy"), F.round("seas", 9).alias("seas"), F.round("thresh", 9).alias("thresh"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_short_series_gets_all_days(spark):
    got = as_map(K.pooled_climatology(cube_of(spark, {(40.0, 10.0): [20.0] * 30}, date(2021, 6, 1)), smooth_width=1))
    assert len(got) == 366 and got[1] == (None, None) and got[152][0] == 20.0 and got[147][0] == 20.0 and got[146][0] is None


def test_leap_day_filled_only_if_empty_everywhere(spark):
    cube = two_years(spark, lambda i: float(i % 365), n=730).where(F.dayofyear("dt") != 60)
    plain = as_map(K.pooled_climatology(cube, half_width=0, smooth_width=1))
    assert plain[60][0] == pytest.approx((plain[59][0] + plain[61][0]) / 2)
    other = cube_of(spark, {(41.0, 10.0): [1.0] * 365}, date(2021, 1, 1))
    mixed = K.pooled_climatology(cube.unionByName(other), half_width=0, smooth_width=1).where("doy = 60")
    assert {(r["lat"], r["seas"]) for r in mixed.collect()} == {(40.0, None), (41.0, 1.0)}


def test_year_range(spark):
    cube = two_years(spark, lambda i: 10.0 if i < 365 else 30.0)
    assert as_map(K.pooled_climatology(cube, 2022, 2022))[100] == (30.0, 30.0)


def test_one_shuffle_by_cell(spark):
    plan = K.pooled_climatology(two_years(spark, lambda i: 20.0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_baseline_uses_plain_day_of_year(spark):
    rows = [(40.0, 10.0, d, float(d), float(d) + 1) for d in range(1, 367)]
    clim = spark.createDataFrame(rows, "lat double, lon double, doy int, seas double, thresh double")
    cube = cube_of(spark, {(40.0, 10.0): [0.0] * 800}, date(2023, 1, 1))
    got = {r["dt"]: (r["seas"], r["thresh"]) for r in K.attach_baseline(cube, clim).collect()}
    assert got[date(2023, 3, 1)] == (60.0, 61.0) and got[date(2024, 3, 1)] == (61.0, 62.0)
    assert got[date(2024, 12, 31)] == (366.0, 367.0)


def test_nearest_alignment(spark):
    axis = spark.createDataFrame([(float(v),) for v in (10, 11, 12)], "lat double")
    asked = spark.createDataFrame([(float(v),) for v in (9.0, 10.4, 10.5, 11.6, 20.0)], "lat double")
    got = {r["lat"]: r["near_lat"] for r in nearest_on_axis(asked, axis, "lat").collect()}
    assert got == {9.0: 10.0, 10.4: 10.0, 10.5: 11.0, 11.6: 12.0, 20.0: 12.0}
    clim = spark.createDataFrame([(10.0, 1.0, 1, 5.0, 6.0), (11.0, 1.0, 1, 7.0, 8.0)], "lat double, lon double, doy int, seas double, thresh double")
    cells = spark.createDataFrame([(10.1, 0.0), (10.9, 3.0)], "lat double, lon double")
    assert sorted((r["lat"], r["lon"], r["seas"]) for r in align_nearest(clim, cells).collect()) == [(10.1, 0.0, 5.0), (10.9, 3.0, 7.0)]


def test_grid_of(spark):
    cells = spark.createDataFrame([(40.0, 10.0), (40.25, 10.0), (40.75, 10.5)], "lat double, lon double")
    g = grid_of(cells)
    assert (g.lat0, g.lat_step, g.n_lat, g.lon0, g.lon_step, g.n_lon) == (40.0, 0.25, 4, 10.0, 0.5, 2)
    assert grid_of(cells.where("lat = 40")).lat_step == 0.25 and g.stride(2) == 2 and g.stride(None) == 1


def test_years_of_cells_come_without_windows(spark):
    """The values of a cell come together once; no window repeats them for each day."""
    plan = K.pooled_climatology(two_years(spark, lambda i: 20.0))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("FlatMapGroupsInArrow") == 1


def test_repeated_rows_and_cells_without_values(spark):
    cube = cube_of(spark, {(40.0, 10.0): [1.0, 2.0] * 200, (41.0, 10.0): [None] * 400}, date(2021, 1, 1))
    got = K.pooled_climatology(cube.unionByName(cube), smooth_width=1).where("doy = 100")
    assert {(r["lat"], r["seas"], r["thresh"]) for r in got.collect()} == {(40.0, round(16 / 11, 6), 2.0), (41.0, None, None)}


def test_cell_keys_are_rounded_half_up(spark):
    rows = [(k * 0.0234375 - 90, k * 0.0234375 - 180) for k in range(7680)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    plain = F.shiftleft(F.round((F.col("lat") + 90) * 1_000_000).cast("bigint"), 30) + F.round((F.col("lon") + 180) * 1_000_000).cast("bigint")
    assert df.where(~cell_key().eqNullSafe(plain)).count() == 0
