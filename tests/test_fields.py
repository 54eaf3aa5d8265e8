from datetime import date

import numpy as np
import pytest
from helpers import START, cube_of, day, flat_clim
from pyspark.sql import functions as F

from gridextremes.operators import compound, habitat, merge, quality, raster
from gridextremes.operators.catalog import items_bbox, year_coverage, year_items
from gridextremes.operators.climatology import climatology_attrs, pooled_climatology
from gridextremes.operators.skew import exact_percentile, hot_join
from gridextremes.plans.events import find_events, point_series
from gridextremes.sources import cube as cubes
from gridextremes.sources import sinks

ATTRS = {"units": "degC", "clim_start": 1991, "clim_end": 2020, "pctile": 90.0, "window_half_width": 5, "smooth_width": 31, "schema_version": "1"}


def test_anomaly_and_series(spark):
    cube = cube_of(spark, {(40.0, 10.0): [21.0, 22.0, None], (40.0, 11.0): [20.0, 20.5, 20.0]})
    clim = flat_clim(spark, [(40.0, 10.0), (40.0, 11.0)])
    assert sorted((r["lon"], r["anomaly"]) for r in raster.anomaly(cube, clim, day(1)).collect()) == [(10.0, 2.0), (11.0, 0.5)]
    text = [tuple(r) for r in sinks.anomaly_text(raster.anomaly(cube, clim, day(2))).orderBy("longitude").collect()]
    assert text == [("40.000000", "10.000000", ""), ("40.000000", "11.000000", "0.0000")]
    rows = point_series(cube, clim, 10.4, 39.0, day(0), day(1)).collect()
    assert [(r["dt"], r["lon"], r["sst"], r["seas"], r["thresh"]) for r in rows] == [(day(0), 10.0, 21.0, 20.0, 23.0), (day(1), 10.0, 22.0, 20.0, 23.0)]


def test_regrid(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(4, 5))
    cube = cube_of(spark, {(40.0 + i, 10.0 + j): [z[i, j]] for i in range(4) for j in range(5)})
    cube = cube.withColumn("sst", F.when((F.col("lat") == 43) & (F.col("lon") == 14), None).otherwise(F.col("sst")))
    asked = [(40.0, 10.0), (41.5, 12.25), (42.75, 13.9), (43.0, 10.5), (39.9, 11.0), (41.0, 14.01), (43.0, 14.0)]
    got = {(r["lat"], r["lon"]): r["sst"] for r in raster.regrid_bilinear(cube, spark.createDataFrame(asked, "lat double, lon double")).collect()}
    assert set(got) == set(asked)
    assert got[40.0, 10.0] == pytest.approx(z[0, 0]) and got[43.0, 10.5] == pytest.approx((z[3, 0] + z[3, 1]) / 2)
    assert got[41.5, 12.25] == pytest.approx(0.5 * (0.75 * z[1, 2] + 0.25 * z[1, 3]) + 0.5 * (0.75 * z[2, 2] + 0.25 * z[2, 3]))
    assert got[39.9, 11.0] is None and got[41.0, 14.01] is None and got[43.0, 14.0] is None and got[42.75, 13.9] is None


def test_upsample_and_mask(spark):
    z = {(0, 0): 1.0, (0, 1): None, (1, 0): 3.0, (1, 1): 5.0}
    field = spark.createDataFrame([(a, b, v) for (a, b), v in z.items()], "ilat int, ilon int, anomaly double")
    got = {(r["row"], r["col"]): r for r in raster.upsample_bilinear(field, 2, 2).collect()}
    assert len(got) == 64 and got[0, 0]["value"] == 1.0 and got[7, 7]["value"] == 5.0
    assert got[0, 3]["value"] == pytest.approx(1 * (1 - 0.375)) and got[0, 4]["missing"] and not got[0, 3]["missing"]
    assert got[4, 4]["value"] == pytest.approx(0.375 * 0.375 * 1 + 0.625 * 0.375 * 3 + 0.625 * 0.625 * 5)
    land = spark.createDataFrame([(0, 0)], "ilat int, ilon int")
    grown = raster.grow_mask(land, 2, 2)
    assert sorted(map(tuple, grown.collect())) == [(0, 0), (0, 1), (1, 0)]
    assert [tuple(r) for r in raster.apply_mask(field, grown).collect()] == [(1, 1, 5.0)]


def test_derived_cube(spark, tmp_path):
    cube = cube_of(spark, {(40.0, 10.0): [20.0] * 365 + [22.0] * 365 + [None] * 10}, date(2021, 1, 1))
    rows = raster.derived_cube(cube)
    r = rows.where("dt = date '2022-06-01'").first()
    assert (r["climatology"], r["mhw_flag"], r["mhw_category"], r["anomaly"]) == (21.0, 1, 1, 1.0) and r["threshold_90p"] == pytest.approx(21.8, abs=1e-5)
    same = raster.derived_cube(cube_of(spark, {(40.0, 10.0): [20.0] * 3})).collect()
    assert {(r["mhw_flag"], r["mhw_category"]) for r in same} == {(1, 5)}  # no margin: top class
    assert {t.dataType.simpleString() for t in rows.schema.fields[3:]} == {"float", "tinyint"}
    sinks.write_derived(rows, str(tmp_path / "d"), 2022, 2022)
    assert spark.read.parquet(str(tmp_path / "d")).select("year").distinct().collect()[0][0] == 2022


def test_harmonise(spark):
    rows = [(day(0), 0.5, 40.0, 10.0, 20.0, "degC"), (day(0), 1.0182, 40.0, 10.0, 299.15, "Kelvin"), (day(0), 1.0182, 40.0, 11.0, float("nan"), "K")]
    slab = spark.createDataFrame(rows, "time date, deptht double, nav_lat double, nav_lon double, thetao double, units string")
    got = sorted((r["lon"], None if r["sst"] is None else round(r["sst"], 6), r["product"]) for r in cubes.harmonise(slab, "forecast").collect())
    assert got == [(10.0, 26.0, "forecast"), (11.0, None, "forecast")]
    target = spark.createDataFrame([(40.2, 10.1)], "lat double, lon double")
    assert [(r["lat"], r["lon"], round(r["sst"], 6)) for r in cubes.harmonise(slab, target=target).collect()] == [(40.2, 10.1, 26.0)]
    with pytest.raises(ValueError):
        cubes.harmonise(slab.drop("thetao"))


def test_merge_and_extent(spark):
    have = cube_of(spark, {(40.0, 10.0): [1.0, 2.0, 3.0]})
    more = cube_of(spark, {(40.0, 10.0): [9.0, 9.0], (41.0, 11.0): [9.0, 9.0]}, day(2))
    merged = merge.merge_slab(have, more)
    assert sorted((r["dt"], r["lat"], r["sst"]) for r in merged.collect()) == [
        (day(0), 40.0, 1.0), (day(1), 40.0, 2.0), (day(2), 40.0, 3.0), (day(3), 40.0, 9.0), (day(3), 41.0, 9.0)]
    e = merge.extent(merged).first()
    assert (e["first_day"], e["last_day"], e["n_days"], e["x0"], e["x1"]) == (day(0), day(3), 4, 10.0, 11.0)
    gaps = [tuple(r) for r in merge.missing_ranges(have, day(-3), day(5)).orderBy("start").collect()]
    assert gaps == [(day(-3), day(-1)), (day(3), day(5))]
    assert [tuple(r) for r in merge.missing_ranges(have.limit(0), day(0), day(1)).collect()] == [(day(0), day(1))]
    assert merge.missing_ranges(have, day(0), day(2)).count() == 0
    assert [tuple(r) for r in merge.missing_ranges(have, day(5), day(6)).collect()] == [(day(5), day(6))]
    holes = have.where(F.col("dt") != F.lit(day(1)))
    assert [r["dt"] for r in merge.missing_days(holes, day(0), day(2)).collect()] == [day(1)]
    assert merge.covers_window(have, day(4), 4, 2).first()[0] and not merge.covers_window(have, day(5), 4, 2).first()[0]
    assert year_coverage(have).first()["year"] == 2022
    item = year_items(have, "grid").first()
    assert item["id"] == "grid-2022" and item["start_datetime"] == "2022-06-01T00:00:00Z" and items_bbox(year_items(have, "g")).first()["x0"] == 10.0


def test_stored_cube_prunes_years(spark, tmp_path):
    cube = cube_of(spark, {(40.0, 10.0): [float("nan")] + [2.0] * 799}, date(2020, 1, 1))
    sinks.write_cube(cube, str(tmp_path / "c"))
    got = cubes.read_cube(spark, str(tmp_path / "c"), date(2021, 12, 30), date(2022, 1, 2))
    assert got.count() == 4 and "PartitionFilters: [isnotnull(year" in got._jdf.queryExecution().executedPlan().toString()
    assert cubes.read_cube(spark, str(tmp_path / "c")).where("sst is null").count() == 1
    clim = pooled_climatology(cube)
    sinks.write_climatology(clim, {"clim_start": 2020}, str(tmp_path / "k"))
    back, attrs = cubes.read_climatology(spark, str(tmp_path / "k"))
    assert back.count() == 366 and attrs == {"clim_start": 2020, "schema_version": "1"}


def test_window_cuts_events(spark):
    cube = cube_of(spark, {(40.0, 10.0): [20.0] * 10 + [25.0] * 20 + [20.0] * 10})
    clim = flat_clim(spark, [(40.0, 10.0)])
    events, _ = find_events(cube, clim, day(0), day(15), raw=True)
    assert [(r["date_start"], r["date_end"]) for r in events.collect()] == [(day(10), day(15))]
    assert find_events(cube, clim, day(0), day(13), raw=True)[0].count() == 0
    assert find_events(cube, clim)[0].first()["date_start"] == day(10)  # the last 30 days
    with pytest.raises(ValueError):
        find_events(cube, clim, start=day(0))


def test_compound(spark):
    rng = np.random.default_rng(6)
    hot, salt = rng.normal(size=(3, 200)), rng.normal(size=(3, 200))
    salt[0] = -hot[0]
    a = cube_of(spark, {(40.0 + i, 10.0): hot[i].tolist() for i in range(3)})
    b = cube_of(spark, {(40.0 + i, 10.0): salt[i].tolist() for i in range(3)}).withColumnRenamed("sst", "sal")
    cells = compound.days_per_cell(compound.compound_days(a, b))
    got = {r["lat"]: (r["hot_days"], r["fresh_days"], r["compound_days"]) for r in cells.collect()}
    for i in range(3):
        h, f = hot[i] > np.percentile(hot[i], 90), salt[i] < np.percentile(salt[i], 10)
        assert got[40.0 + i] == (h.sum(), f.sum(), (h & f).sum())
    totals = compound.compound_totals(cells).first()
    assert totals["longest_run_days"] == 20 and totals["compound_affected_pixels"] >= 1
    assert sum(r["count"] for r in compound.day_classes(cells).collect()) == totals["compound_affected_pixels"]


def test_habitat(spark):
    cells = spark.createDataFrame([(0.0, 0.0, "rock", 1.0), (0.1, 0.0, "mud", 2.0), (0.1, 0.0, "mud", 3.0), (5.0, 5.0, "sand", 9.0)], "lon double, lat double, class string, rate double")
    ellipses = spark.createDataFrame([("a", 0.0, 0.0, 0.1, 0.2), ("b", 50.0, 50.0, 1.0, 1.0)], "event_id string, lon double, lat double, sx double, sy double")
    got = {r["event_id"]: r for r in habitat.class_overlap(ellipses, cells, list(habitat.VULNERABILITY), habitat.VULNERABILITY).collect()}
    assert (got["a"]["cells"], got["a"]["share_mud"], got["a"]["mean_rate"], got["a"]["score"]) == (3, 0.667, 2.0, 0.3)
    assert (got["b"]["cells"], got["b"]["share_rock"], got["b"]["score"]) == (0, 0.0, 0.0)
    assert habitat.basin_shares(cells, ["mud"]).first()[0] == 0.5 and habitat.rate_range(cells).first()["rate_median"] == 2.5
    coast = spark.createDataFrame([(0.1, 0.1, "eroding", 2.0), (0.2, 0.0, "stable", 6.0), (3.0, 3.0, "eroding", 5.0)], "lon double, lat double, class string, length_km double")
    near = habitat.coast_buffer(ellipses.select("event_id", "lon", "lat"), coast)
    assert {r["event_id"]: tuple(r)[1:] for r in near.collect()} == {"a": (8.0, 2.0, 0.25), "b": (0.0, 0.0, 0.0)}
    assert tuple(habitat.buffer_summary(near).first()) == (2, 0.125, 0.25, 0)
    assert tuple(habitat.coast_totals(coast).first()) == (13.0, 7.0, 53.8)


def test_quality(spark):
    good = flat_clim(spark, [(40.0, 10.0), (41.0, 10.0)])
    levels = {r["check"]: r["level"] for r in quality.quality_report(good, ATTRS).collect()}
    assert set(levels.values()) == {"ok"}
    bad = good.withColumn("thresh", F.when(F.col("lat") == 40, F.col("seas") - 1).otherwise(F.col("thresh"))).withColumn(
        "seas", F.when(F.col("doy") == 7, F.col("seas") + 3).otherwise(F.col("seas")))
    worse = {r["check"]: r["level"] for r in quality.quality_report(bad, {**ATTRS, "clim_end": 1995, "bbox": [5, 0, 1, 1], "schema_version": "2"}).collect()}
    assert worse["thresh >= seas"] == "error" and worse["doy continuity p99"] == "error"
    assert (worse["year span"], worse["bbox"], worse["schema version"]) == ("warn", "error", "error")
    assert all(r["ok"] for r in quality.light_check(good, ATTRS).collect())
    built = {**climatology_attrs(1991, 2020, bbox=[4, 34, 12, 42]), "schema_version": "1"}
    assert {r["level"] for r in quality.attr_checks(good, built).collect()} == {"ok"} and built["pctile"] == 90.0
    print_ = quality.fingerprint(good, ATTRS)
    assert print_ == quality.fingerprint(good.repartition(7), {**ATTRS, "created_utc": "now"})
    assert print_ != quality.fingerprint(good, {**ATTRS, "pctile": 95.0}) and print_ != quality.fingerprint(bad, ATTRS)


def test_hot_join_and_percentile(spark):
    big = spark.range(3000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (9, "d")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = sorted(map(str, hot_join(big, small, ["k"], how, hot_rows=100).select(*big.join(small, "k", how).columns).collect()))
        assert got == sorted(map(str, big.join(small, "k", how).collect()))
    rng = np.random.default_rng(0)
    for values in (rng.normal(size=5001), rng.integers(0, 4, 3000).astype(float), np.array([1.0, 2.0]), np.array([5.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for p in (0.0, 0.5, 0.9, 0.99, 1.0):
            assert exact_percentile(df, "v", p, "p").first()[0] == pytest.approx(np.percentile(values, 100 * p), abs=1e-12)
    many = spark.range(60000).select((F.hash("id") % 1000003 / 7).alias("v"))
    wide = np.array([r["v"] for r in many.collect()])
    for p in (0.001, 0.5, 0.99):
        assert exact_percentile(many, "v", p, "p").first()[0] == pytest.approx(np.percentile(wide, 100 * p), abs=1e-9)
    assert exact_percentile(spark.createDataFrame([], "v double"), "v", 0.5, "p").first()[0] is None
    assert START == day(0)
