from datetime import date

import numpy as np
import pytest
from helpers import START, cube_of, day, events_of_series, flat_clim, spike
from pyspark.sql import functions as F

from gridextremes.operators.climatology import attach_baseline, pooled_climatology
from gridextremes.operators.detect import cell_events, detect_events, detect_self_baseline, mark_events

CELL = (40.0, 10.0)


def found(spark, values, **options):
    cube = cube_of(spark, {CELL: values})
    rows = cell_events(cube, flat_clim(spark, [CELL]), **options).orderBy("date_start").collect()
    return [((r["date_start"] - START).days, (r["date_end"] - START).days, r["duration_days"]) for r in rows]


def test_one_spike(spark):
    assert found(spark, spike(60, (20, 27))) == [(20, 27, 8)]


def test_short_spike_is_no_event(spark):
    assert found(spark, spike(60, (20, 22))) == []


def test_gap_is_joined(spark):
    assert found(spark, spike(60, (10, 14), (17, 21))) == [(10, 21, 12)]
    assert found(spark, spike(60, (10, 14), (18, 22))) == [(10, 14, 5), (18, 22, 5)]
    assert found(spark, spike(60, (10, 14), (17, 21)), join_gaps=False) == [(10, 14, 5), (17, 21, 5)]
    assert found(spark, spike(60, (10, 14), (18, 22)), max_gap=3) == [(10, 22, 13)]


def test_short_runs_go_before_joining(spark):
    assert found(spark, spike(60, (10, 12), (14, 16))) == []
    # A short run inside a gap counts as gap days only.
    assert found(spark, spike(60, (10, 14), (16, 16), (18, 22))) == [(10, 14, 5), (18, 22, 5)]


def test_null_breaks_a_run(spark):
    values = spike(60, (20, 27))
    values[22] = values[24] = None
    assert found(spark, values) == []
    values = spike(60, (20, 30))
    values[25] = None
    assert found(spark, values) == [(20, 30, 11)]


def test_missing_rows_do_not_break_a_run(spark):
    cube = cube_of(spark, {CELL: spike(60, (20, 29))}).where(~F.col("dt").between(day(24), day(26)))
    rows = cell_events(cube, flat_clim(spark, [CELL])).collect()
    assert [(r["date_start"], r["date_end"], r["duration_days"]) for r in rows] == [(day(20), day(29), 7)]


def test_metrics_include_gap_days(spark):
    values = spike(60, (10, 14), (17, 21))
    values[12], values[20] = 27.0, 27.0
    cube = cube_of(spark, {CELL: values})
    r = cell_events(cube, flat_clim(spark, [CELL])).first()
    assert r["date_peak"] == day(12) and r["intensity_max"] == 7.0
    assert r["intensity_cumulative"] == 54.0 and r["intensity_mean"] == 4.5 and r["category"] == 2


def test_threshold_is_strict(spark):
    assert found(spark, spike(60, (20, 27), high=23.0)) == []


def test_numbering_order_and_boxes(spark):
    series = {(40.0 + a, 10.0 + b): spike(60, (20, 27), (40, 45)) for a in (0, 0.5) for b in (0, 0.25)}
    events = detect_events(cube_of(spark, series), flat_clim(spark, series)).orderBy("event_seq").collect()
    assert [e["event_id"] for e in events] == [f"mhw-{i:06d}" for i in range(1, 9)]
    keys = [(e["centroid_lat"], e["centroid_lon"], e["date_start"]) for e in events]
    assert keys == sorted(keys)
    assert tuple(events[0]["bbox"]) == (9.875, 39.75, 10.125, 40.25)


def test_decimation(spark):
    series = {(40.0 + a, 10.0 + b): spike(40, (20, 27)) for a in range(4) for b in range(4)}
    events = detect_events(cube_of(spark, series), flat_clim(spark, series), max_cells=4).collect()
    assert {(e["centroid_lat"], e["centroid_lon"]) for e in events} == {(a, b) for a in (40.0, 42.0) for b in (10.0, 12.0)}
    assert tuple(events[0]["bbox"]) == (events[0]["centroid_lon"] - 1, events[0]["centroid_lat"] - 1, events[0]["centroid_lon"] + 1, events[0]["centroid_lat"] + 1)


def test_random_series_against_plain_code(spark):
    rng = np.random.default_rng(5)
    series, keep = {}, {}
    for c in range(12):
        noise = np.convolve(rng.normal(0, 3, 420), np.ones(7) / 7, "same")
        series[40.0 + c, 10.0] = [None if rng.random() < 0.03 else round(float(20 + v * 3), 3) for v in noise]
        keep[40.0 + c] = rng.random(420) > 0.05
    clim = flat_clim(spark, series, 20.0, 21.0)
    drop = [(lat, day(i)) for lat, k in keep.items() for i in range(420) if not k[i]]
    gone = spark.createDataFrame(drop, "lat double, dt date")
    cube = cube_of(spark, series).join(gone, ["lat", "dt"], "left_anti")
    got = sorted(
        (r["lat"], r["date_start"], r["date_end"], r["date_peak"], r["duration_days"], r["intensity_max"], r["intensity_mean"], r["intensity_cumulative"])
        for r in cell_events(cube, clim).collect())
    want = []
    for (lat, _), values in series.items():
        rows = [(day(i), v) for i, v in enumerate(values) if keep[lat][i]]
        days, sst = [d for d, _ in rows], [v for _, v in rows]
        for e in events_of_series(days, sst, [20.0] * len(rows), [21.0] * len(rows)):
            want.append((lat, *e))
    want.sort()
    assert len(want) > 20 and [w[:5] for w in want] == [g[:5] for g in got]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], abs=0.00051)


def test_one_shuffle_of_the_cube(spark):
    cube = cube_of(spark, {CELL: spike(60, (20, 27))})
    clim = flat_clim(spark, [CELL])
    plan = cell_events(cube, clim)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the cube and the climatology, once each


def test_self_baseline_is_cut_to_the_series(spark):
    rng = np.random.default_rng(3)
    values = (18 + 5 * np.sin(np.arange(1461) / 365.25 * 2 * np.pi) + rng.normal(0, 0.3, 1461)).tolist()
    for i in range(900, 915):
        values[i] += 4
    cube = cube_of(spark, {CELL: values}, date(2019, 1, 1))
    events = detect_self_baseline(cube, 1991, 2020).collect()
    hit = [e for e in events if abs((e["date_start"] - day(900, date(2019, 1, 1))).days) <= 1]
    assert len(hit) == 1 and 14 <= hit[0]["duration_days"] <= 17
    clim = pooled_climatology(cube, 2019, 2020)
    assert {e["event_id"] for e in detect_events(cube, clim).collect()} == {e["event_id"] for e in events}


def test_events_of_a_cell_keep_their_distance(spark):
    series = attach_baseline(cube_of(spark, {CELL: spike(60, (5, 9), (12, 16), (20, 26))}), flat_clim(spark, [CELL]))
    rows = mark_events(series).groupBy("event_no").agg(F.min("dt").alias("a"), F.max("dt").alias("b"), F.count("*").alias("n")).orderBy("event_no").collect()
    assert all(r["n"] >= 5 for r in rows) and all((y["a"] - x["b"]).days > 3 for x, y in zip(rows, rows[1:]))


def test_rows_far_from_hot_ones_leave_early(spark):
    """Of 400 days only those around the hot ones reach the windows that find the runs; the events are the same."""
    cube = cube_of(spark, {CELL: spike(400, (100, 106), (109, 113), (117, 117), (200, 203), (300, 309))})
    marked = mark_events(attach_baseline(cube, flat_clim(spark, [CELL])))
    lines = marked._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [line for line in lines if "Window [" in line or "Filter" in line and "near_hot" in line]
    first = next(i for i, line in enumerate(windows) if "Filter" in line)
    assert "AS near_hot" in windows[first + 1] and any("AS kept" in line for line in windows[:first])
    rows = marked.groupBy("event_no").agg(F.min("dt").alias("a"), F.max("dt").alias("b"), F.count("*").alias("n"))
    assert sorted(map(tuple, rows.collect())) == [(1, day(100), day(113), 14), (2, day(300), day(309), 10)]
