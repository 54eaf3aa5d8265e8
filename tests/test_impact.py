import math
import re

import pytest
from helpers import day
from pyspark.sql import functions as F
from test_cluster import event, frame
from test_coverage import overlay, square

from gridextremes.operators import impact
from gridextremes.operators.cluster import cluster_events
from gridextremes.operators.detect import footprint_of_cells
from gridextremes.operators.exposure import farm_exposure, site_events
from gridextremes.operators.filters import features_in_bbox, filter_events, nearest_day, page
from gridextremes.operators.grid import Grid
from gridextremes.operators.impact import attach_impact, find_site, hit_details, impact_summary, index_overlay
from gridextremes.operators.rollup import aggregate_events, bubbles, category_histogram, intensity_histogram

GRID = Grid(lat0=40.0, lat_step=1.0, n_lat=6, lon0=10.0, lon_step=1.0, n_lon=6)


def placed(*at, **k):
    """Events on GRID cells (ilat, ilon)."""
    out = []
    for i, (r, c, a, b) in enumerate(at):
        e = list(event(i + 1, 10.0 + c, 40.0 + r, a, b, step=1.0, **k))
        e[-2:] = [r, c]
        out.append(tuple(e))
    return out


def all_kinds(spark):
    return (
        overlay(spark, ("Point", [10.0, 40.0]), ("Point", [10.2, 40.1]), ("Point", [25, 40]), kind="aquaculture")
        .unionByName(overlay(spark, ("Polygon", [square(9.75, 39.75, 10.75, 40.75)])))
        .unionByName(overlay(spark, ("Polygon", [square(10.1, 40.1, 10.3, 40.3)]), kind="seagrass"))
    )


def km2(w, h, lat):
    return w * h * 111.32 ** 2 * math.cos(math.radians(lat))


def test_cluster_impact(spark):
    c = cluster_events(frame(spark, placed((0, 0, 0, 9), (0, 1, 0, 9))))
    got = attach_impact(c.events, c.footprint, index_overlay(all_kinds(spark), GRID)).first()["impact"]
    assert got["n_aquaculture_sites"] == 2
    assert got["mpa_area_km2"] == pytest.approx(km2(1.0, 0.75, 40.125), abs=0.01)
    assert got["seagrass_area_km2"] == pytest.approx(km2(0.2, 0.2, 40.2), abs=0.01)
    assert got["summary"].startswith("2 aquaculture site(s), ")


def test_single_cell_cluster_is_a_point_but_raw_event_a_box(spark):
    events = frame(spark, placed((0, 0, 0, 9)))
    index = index_overlay(all_kinds(spark), GRID)
    c = cluster_events(events)
    point = attach_impact(c.events, c.footprint, index).first()["impact"]
    assert (point["n_aquaculture_sites"], point["mpa_area_km2"], point["seagrass_area_km2"]) == (1, 0.0, 0.0)
    raw = attach_impact(events.drop("ilat", "ilon"), footprint_of_cells(events), index).first()["impact"]
    assert raw["n_aquaculture_sites"] == 2 and raw["mpa_area_km2"] == pytest.approx(km2(0.75, 0.75, 40.125), abs=0.01)
    totals, by_category = impact_summary(c.events, c.footprint, index, ["aquaculture", "mpa", "seagrass"])
    assert tuple(totals.first()) == (1, 1, 1, 0) and by_category.count() == 1
    met = {(r["kind"], r["feature_id"]) for r in hit_details(c.footprint, index).collect()}
    assert met == {("aquaculture", "f0"), ("mpa", "f0")}


def test_events_of_one_cell_are_not_joined_to_features(spark, monkeypatch):
    """They take the sums of their cell, the same as by way of every (event, feature)."""
    shapes = all_kinds(spark).unionByName(overlay(spark, ("Point", [10.5, 40.5]), ("Point", [11.0, 41.0]), kind="aquaculture").withColumn(
        "feature_id", F.concat(F.lit("more"), "feature_id"))).unionByName(overlay(
            spark, ("Polygon", [square(10.25, 39.0, 12.0, 41.5)]), ("Polygon", [square(10.25, 39.0, 12.0, 41.5)]), kind="seagrass").withColumn(
        "feature_id", F.concat(F.lit("more"), "feature_id")))
    index = index_overlay(shapes, GRID)
    cells = [(0, 0), (0, 0), (0, 1), (1, 0), (1, 1), (4, 4)]
    rows = [(f"{kind}{i}", r, c, kind == "point") for kind in ("box", "point") for i, (r, c) in enumerate(cells)]
    foot = spark.createDataFrame([*rows, (None, 0, 0, False)], "event_id string, ilat int, ilon int, is_point boolean")
    events = foot.select("event_id")
    # A second cell with nothing on it leaves the numbers as they are, but takes the other way.
    far = foot.unionByName(foot.select("event_id", F.lit(5).alias("ilat"), F.lit(0).alias("ilon"), "is_point"))

    def found(footprint):
        got = attach_impact(events, footprint, index).collect()
        return {r["event_id"]: (r["impact"]["n_aquaculture_sites"], r["impact"]["mpa_area_km2"], r["impact"]["seagrass_area_km2"]) for r in got}

    want = found(far)
    assert want["box0"] == want["box1"] and want["box0"][0] == 3 and want["point0"][0] == 1 and want["box4"][2] > 0 and want[None] == (0, 0.0, 0.0)
    monkeypatch.setattr(impact, "event_hits", None)
    assert found(foot) == want


def test_overlapping_features_count_twice(spark):
    c = cluster_events(frame(spark, placed((0, 0, 0, 9), (0, 1, 0, 9))))
    twice = overlay(spark, ("Polygon", [square(10, 40, 10.5, 40.5)]), ("Polygon", [square(10, 40, 10.5, 40.5)]))
    got = attach_impact(c.events, c.footprint, index_overlay(twice, GRID)).first()["impact"]
    assert got["mpa_area_km2"] == pytest.approx(2 * km2(0.5, 0.5, 40.25), abs=0.02)


def test_farms(spark):
    c = cluster_events(frame(spark, placed((0, 0, 0, 9), (0, 1, 0, 9), (4, 4, 0, 9), (0, 0, 40, 50), (1, 0, 45, 50))))
    farms = spark.createDataFrame([
        ("in", 10.2, 40.2), ("border", 10.5, 39.5), ("far", -5.0, 36.0), ("disc", 14.0, 44.069), ("out", 14.0, 44.071), ("same", 10.2, 40.2),
    ], "id string, lon double, lat double")
    twice = farms.unionByName(farms.where("id = 'same'"))
    rows = farm_exposure(c.events, c.footprint, twice, GRID).collect()
    assert len(rows) == 7
    got = {r["id"]: r for r in rows}
    assert {k: v["n_events"] for k, v in got.items()} == {"in": 2, "border": 2, "far": 0, "disc": 1, "out": 0, "same": 2}
    dates = [e["date_start"] for e in got["in"]["events"]]
    assert dates == sorted(dates) and got["far"]["events"] == []


def test_site_events(spark):
    events = frame(spark, placed((0, 0, 0, 9), (0, 1, 0, 9), (3, 3, 0, 9), (5, 5, 0, 9)))
    sites = overlay(spark, ("Polygon", [square(10.2, 39.9, 11.1, 40.1)]))
    got = site_events(events, sites, " s0 ", GRID).collect()
    assert len(got) == 1 and got[0]["n_pixels"] == 2
    with pytest.raises(LookupError):
        find_site(sites, "nowhere")
    assert site_events(events, sites, "S0", GRID, start=day(20)).count() == 0


def test_filters_and_pages(spark):
    events = frame(spark, placed((0, 0, 0, 9), (0, 1, 20, 29), (3, 3, 5, 24, ), (5, 5, 0, 9)))
    assert [r["event_seq"] for r in filter_events(events, day(10), day(20)).orderBy("event_seq").collect()] == [2, 3]
    assert filter_events(events, bbox=(10.0, 40.0, 11.0, 43.0)).count() == 2
    assert filter_events(events, min_category=2).count() == 0
    rows, total = page(events, ["event_seq"], limit=2, offset=1)
    assert [r["event_seq"] for r in rows.collect()] == [2, 3] and total.first()[0] == 4
    with pytest.raises(ValueError):
        page(events, ["event_seq"], limit=0)
    shapes = overlay(spark, ("Polygon", [square(0, 0, 1, 1)]), ("Point", [5, 5]))
    assert [r["feature_id"] for r in features_in_bbox(shapes, (1, 1, 4, 4)).collect()] == ["f0"]
    days = spark.createDataFrame([(day(0),), (day(4),)], "dt date")
    assert [r["dt"] for r in nearest_day(days, day(1)).collect()] == [day(0)]


def test_rollups(spark):
    rows = placed((0, 0, 0, 9), (0, 1, 20, 29)) + [event(9, 30, 38, 220, 229, peak=-1.0, category=3)]
    events = frame(spark, rows)
    by_year = aggregate_events(events, "year").collect()
    assert [(r["key"], r["count"], r["intensity_max"], r["intensity_mean"]) for r in by_year] == [("2022", 2, 1.0, 1.0), ("2023", 1, 0.0, -1.0)]
    assert [r["key"] for r in aggregate_events(events, "country").collect()] == ["IT", "TR"]
    assert [(r["key"], r["category_name"]) for r in aggregate_events(events, "category").collect()] == [("1", "I Moderate"), ("3", "III Severe")]
    assert [r["key"] for r in aggregate_events(events, "mpa").collect()] == ["events_not_touching_mpa"]
    with pytest.raises(ValueError):
        aggregate_events(events, "planet")
    assert [r["n"] for r in category_histogram(events).orderBy("category").collect()] == [2, 0, 1, 0, 0]
    bins = intensity_histogram(events).collect()
    assert [(b["category"], b["bin"], b["n"]) for b in bins] == [(1, 13, 2)]
    rings = spark.createDataFrame([("z", [(0.0, 0.0), (2.0, 0.0), (1.0, 3.0)]), ("z", [(9.0, 9.0)])], "event_id string, ring array<struct<x:double,y:double>>")
    bare = spark.createDataFrame([("z", None, None)], "event_id string, centroid_lon double, centroid_lat double")
    assert tuple(bubbles(bare, rings).first()) == ("z", 1.0, 1.0)
    assert bubbles(events).where(F.col("event_id") == "mhw-000009").first()["x"] == 30.0


def test_deep_pages_gather_a_few_ranges(spark):
    rows = spark.range(0, 60_000).select((F.col("id") * 7919 % 60_000).alias("k"), F.col("id").alias("v")).repartition(8)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for offset in (0, 9_999, 10_000, 31_234, 59_950, 60_000, 70_000):
            got, matched = page(rows, ["k"], 100, offset)
            assert [r["k"] for r in got.collect()] == list(range(offset, min(60_000, offset + 100)))
            assert matched.first()[0] == 60_000
        deep, _ = page(rows, ["k"], 100, 31_234)
        limit = int(re.search(r"limit=(\d+)", deep._jdf.queryExecution().executedPlan().toString().replace("limit = ", "limit=")).group(1))
        assert limit < 60_000 / 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
