from datetime import date, datetime

import numpy as np
import pytest
from helpers import cube_of, day, events_of_series, flat_clim, spike
from pyspark.sql import functions as F

from gridextremes.operators.detect import cell_events
from gridextremes.sources.sinks import write_cube
from gridextremes.streaming import incremental
from gridextremes.streaming.manifest import Manifest
from gridextremes.operators.grid import cell_key
from gridextremes.streaming.detection import _EMPTY, CellRuns, over_at_end, read_days, state_at_end, stream_detect


def run_all(values, thresh=23.0, seas=20.0, **k):
    runs, out = CellRuns(5, 2), []
    for i, v in enumerate(values):
        out += runs.add(i, v, seas, thresh)
        runs = CellRuns(5, 2, runs.event, runs.gap, runs.run)  # as if stored and read back
    return [(e[1], e[2], e[6], e[0], e[5], e[3]) for e in out]


def test_state_machine():
    assert run_all(spike(60, (20, 27))) == [(20, 27, 20, 8, 5.0, 40.0)]
    assert run_all(spike(60, (20, 22))) == []
    assert run_all(spike(60, (10, 14), (17, 21))) == [(10, 21, 10, 12, 5.0, 50.0)]
    assert run_all(spike(60, (10, 14), (16, 16), (18, 22))) == [(10, 14, 10, 5, 5.0, 25.0), (18, 22, 18, 5, 5.0, 25.0)]
    assert run_all(spike(60, (50, 59))) == []  # still open
    assert CellRuns(5, 2).event == _EMPTY


def test_state_machine_against_plain_code():
    rng = np.random.default_rng(9)
    for _ in range(60):
        noise = np.convolve(rng.normal(0, 3, 300), np.ones(5) / 5, "same")
        values = [None if rng.random() < 0.04 else round(float(20 + 3 * v), 3) for v in noise] + [0.0] * 5
        days = [day(i) for i in range(len(values))]
        want = events_of_series(days, values, [20.0] * len(values), [21.0] * len(values))
        got = run_all(values, 21.0)
        assert [(day(a), day(b), day(p), n) for a, b, p, n, _, _ in got] == [w[:4] for w in want]
        for g, w in zip(got, want):
            assert (g[4], g[5]) == pytest.approx((w[4], w[6]), abs=1e-5)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_stream_equals_batch_with_late_and_double_rows(spark, rocks, tmp_path):
    rng = np.random.default_rng(3)
    series = {}
    for c in range(3):
        noise = np.convolve(rng.normal(0, 3, 120), np.ones(7) / 7, "same")
        series[40.0 + c, 10.0] = [round(float(20 + 3 * v), 3) for v in noise] + [0.0] * 20
    cube, clim = cube_of(spark, series), flat_clim(spark, series, 20.0, 20.5)
    n = F.datediff("dt", F.lit(day(0)))
    # Every third day comes one file late, and every fifth day twice.
    late = cube.withColumn("file", F.floor(n / 35) + F.when(n % 35 < 32, 0).otherwise(1).cast("int"))
    source = tmp_path / "in"
    for f in range(5):
        part = late.where(F.col("file") == f).drop("file")
        part.unionByName(part.where(n % 5 == 0)).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(cube.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    run = stream_detect(stream, clim).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    columns = ["lat", "date_start", "date_end", "date_peak", "duration_days", "intensity_max", "intensity_mean", "intensity_cumulative", "category"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*columns).collect())
    want = sorted(tuple(r) for r in cell_events(cube, clim).select(*columns).collect())
    assert len(want) > 5 and got == want


@pytest.mark.parametrize("until", [30, 57, 58, 60, 64, 66, 68, 71, 90])  # before, within, just after events and gaps
def test_hand_over_at_any_day(spark, until):
    """The state at the end of a history is that of the state machine after the same days."""
    rng = np.random.default_rng(until)
    blocks = [(20, 26), (40, 44), (47, 48), (50, 57), (60, 64), (66, 69)]
    series = {(40.0, 10.0): spike(100, *blocks), (41.0, 10.0): spike(100, (0, 99)), (42.0, 10.0): spike(100),
              (43.0, 10.0): [None if rng.random() < 0.1 else round(float(v), 3) for v in 21 + 2 * np.convolve(rng.normal(0, 2, 100), np.ones(4) / 4, "same")]}
    cube = cube_of(spark, {c: v[:until + 1] for c, v in series.items()})
    clim = flat_clim(spark, series, 20.0, 21.5)
    states = {r["cell"]: r for r in state_at_end(cube, clim).collect()}
    keys = {(r["lat"], r["lon"]): r["cell"] for r in flat_clim(spark, series).select("lat", "lon", cell_key()).distinct().collect()}
    epoch = (day(0) - date(1970, 1, 1)).days
    over = []
    for place, values in series.items():
        runs = CellRuns(5, 2)
        for i, v in enumerate(values[:until + 1]):
            over += [(*place, day(e[1] - epoch), day(e[2] - epoch)) for e in runs.add(epoch + i, v, 20.0, 21.5)]
        row = states[keys[place]]
        for part in ("event", "gap", "run"):
            want = getattr(runs, part)
            got = tuple(row[f"{part}_{f}"] for f in ("n", "first", "last", "total", "known", "best", "best_day", "best_seas", "best_thresh"))
            assert got[:3] == (want[0], *(want[1:3] if want[0] else (None, None))), (place, part)
            assert got[3:6] == pytest.approx(want[3:6]) if want[5] is not None else got[4:] == want[4:]
            assert got[6:] == want[6:]
        assert row["done"] == epoch + until and len(row["seas"]) == len(row["thresh"]) == 366
    found = over_at_end(cube, clim).select("lat", "lon", "date_start", "date_end").collect()
    assert sorted(map(tuple, found)) == sorted(over)


def test_stream_goes_on_from_the_batch(spark, rocks, tmp_path):
    series = {(40.0, 10.0): spike(120, (10, 16), (50, 70), (90, 95)), (41.0, 10.0): spike(120, (55, 59), (62, 66)), (42.0, 10.0): spike(120, (57, 58))}
    cube, clim = cube_of(spark, series), flat_clim(spark, series)
    history, later = cube.where(F.col("dt") <= day(60)), cube.where(F.col("dt") > day(58))  # two days come again
    for a, b in ((59, 75), (76, 100), (101, 119)):
        later.where(F.col("dt").between(day(a), day(b))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    days = read_days(spark, str(tmp_path / "in"), cube.schema, 1)
    run = stream_detect(days, clim, history=history).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert len([p for p in run.recentProgress if p["numInputRows"]]) == 3
    both = spark.read.parquet(str(tmp_path / "out")).unionByName(over_at_end(history, clim))
    columns = ["lat", "date_start", "date_end", "date_peak", "duration_days", "intensity_max", "intensity_mean", "intensity_cumulative", "category"]
    want = sorted(tuple(r) for r in cell_events(cube, clim).select(*columns).collect())
    assert len(want) == 4 and sorted(tuple(r) for r in both.select(*columns).collect()) == want


def test_cells_of_a_tile_share_a_state(spark, rocks, tmp_path):
    """Each cell keeps its own runs and waiting days, also where the others of its tile have rows it lacks."""
    rng = np.random.default_rng(5)
    series = {}
    for place in [(40.0 + i / 10, 10.0 + j / 10) for i in range(10) for j in range(2)] + [(42.5, 10.0)]:
        noise = np.convolve(rng.normal(0, 3, 90), np.ones(7) / 7, "same")
        series[place] = [None if rng.random() < 0.03 else round(float(20 + 3 * v), 3) for v in noise] + [0.0] * 20
    cube, clim = cube_of(spark, series), flat_clim(spark, series, 20.0, 20.5)
    history, later = cube.where(F.col("dt") <= day(30)), cube.where(F.col("dt") > day(30))
    n = F.datediff("dt", F.lit(day(31)))
    # Of every other row of cells, the last days of a file come with the next one.
    behind = (F.round(F.col("lat") * 10).cast("int") % 2 == 0) & (n % 27 >= 23)
    parts = later.withColumn("file", F.floor(n / 27) + F.when(behind, 1).otherwise(0).cast("int"))
    for f in range(4):
        parts.where(F.col("file") == f).drop("file").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    days = read_days(spark, str(tmp_path / "in"), cube.schema, 1)
    run = stream_detect(days, clim, history=history).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) < len(series)
    both = spark.read.parquet(str(tmp_path / "out")).unionByName(over_at_end(history, clim))
    columns = ["lat", "lon", "date_start", "date_end", "date_peak", "duration_days", "intensity_max", "intensity_mean", "intensity_cumulative", "category"]
    want = sorted(tuple(r) for r in cell_events(cube, clim).where(F.col("date_end") < day(95)).select(*columns).collect())
    assert len(want) > 20 and sorted(tuple(r) for r in both.select(*columns).collect()) == want


def test_append_backfill_and_freshness(spark, tmp_path):
    path = str(tmp_path / "cube")
    cells = [(40.0, 10.0), (40.0, 10.25)]
    incremental.append_slab(spark, path, cube_of(spark, {c: [20.0] * 40 for c in cells}))
    incremental.append_slab(spark, path, cube_of(spark, {c: [99.0] * 5 + [25.0] * 8 for c in cells}, day(35)))
    stored = spark.read.parquet(path)
    assert stored.count() == 96 and stored.where("sst = 99").count() == 0
    events = incremental.detect_recent(spark, path, flat_clim(spark, cells), day(50))
    assert {(r["date_start"], r["date_end"]) for r in events.collect()} == {(day(40), day(47))}

    def load(year):
        if year == 2001:
            raise OSError("no data")
        return cube_of(spark, {cells[0]: [float(year)] * 3}, date(year, 1, 1))

    out = str(tmp_path / "years")
    assert incremental.backfill([2000, 2001, 2002], load, out) == [(2000, "ok"), (2001, "failed: OSError"), (2002, "ok")]
    assert incremental.backfill([2002], load, out) == [(2002, "ok")]
    assert {r["year"]: r["count"] for r in spark.read.parquet(out).groupBy("year").count().collect()} == {2000: 3, 2002: 3}
    log = spark.createDataFrame([(datetime(2022, 6, 1), True), (datetime(2022, 6, 9), False)], "finished_at timestamp, ok boolean")
    row = incremental.freshness(stored, log, "2022-06-01 08:00:00").first()
    assert (row["cube_start"], row["age_seconds"], row["bucket"]) == (day(0), 8 * 3600, "good")


def test_slab_folder_stream(spark, tmp_path):
    slab = spark.createDataFrame([(day(0), 40.0, 10.0, 293.15, "K"), (day(1), 40.0, 10.0, 294.15, "K")], "time date, lat double, lon double, analysed_sst double, units string")
    slab.where("time = date '2022-06-01'").coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        run = incremental.stream_append(spark, str(tmp_path / "in"), slab.schema, str(tmp_path / "cube"), str(tmp_path / "state"))
        run.awaitTermination()
        slab.where("time = date '2022-06-02'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = sorted((r["dt"], round(r["sst"], 6)) for r in spark.read.parquet(str(tmp_path / "cube")).collect())
    assert got == [(day(0), 20.0), (day(1), 21.0)]


def test_append_stores_a_day_once_and_keeps_the_cells(spark, tmp_path):
    path = str(tmp_path / "cube")
    rows = [(day(i), lat, lon, 20.0 + i, "nrt") for i in range(3) for lat in (40.0, 40.5) for lon in (10.0, 10.5)]
    names = "dt date, lat double, lon double, sst double, product string"
    first = spark.createDataFrame(rows, names)
    incremental.append_slab(spark, path, first.unionByName(first))
    assert spark.read.parquet(path).count() == len(rows)
    slab = spark.createDataFrame([(day(i), lat + 0.1, lon + 0.1, 30.0, "nrt") for i in (2, 3, 4) for lat in (39.5, 40.0, 40.5) for lon in (9.5, 10.0, 10.5)], names)
    incremental.append_slab(spark, path, slab.unionByName(slab))
    got = spark.read.parquet(path)
    assert got.select("lat", "lon").distinct().count() == 4 and got.count() == len(rows) + 2 * 4
    assert {r["sst"] for r in got.where(F.col("dt") > day(2)).collect()} == {30.0}


def test_append_after_a_part_of_the_grid_opened_a_year(spark, tmp_path):
    path = str(tmp_path / "cube")
    cells = [(lat, lon) for lat in (40.0, 40.5, 41.0) for lon in (10.0, 10.5, 11.0)]
    part = [(lat, lon) for lat, lon in cells if lat < 41 and lon < 11]
    incremental.append_slab(spark, path, cube_of(spark, {c: [20.0, 20.5] for c in cells}, date(2021, 12, 30)))
    incremental.append_slab(spark, path, cube_of(spark, {c: [21.0] for c in part}, date(2022, 1, 1)))
    incremental.append_slab(spark, path, cube_of(spark, {c: [22.0 + i, None] for i, c in enumerate(cells)}, date(2022, 1, 2)))
    got = {(r["dt"], r["lat"], r["lon"]): r["sst"] for r in spark.read.parquet(path).where("year = 2022").collect()}
    want = {(date(2022, 1, 1), *c): 21.0 for c in part}
    want |= {(date(2022, 1, 2), *c): 22.0 + i for i, c in enumerate(cells)} | {(date(2022, 1, 3), *c): None for c in cells}
    assert got == want


def grid_rows(days, cells, value=20.0, product="nrt"):
    return [(d, lat, lon, value, product) for d in days for lat, lon in cells]


ROWS = "dt date, lat double, lon double, sst double, product string"
CELLS = [(lat, lon) for lat in (40.0, 40.5, 41.0) for lon in (10.0, 10.5, 11.0)]


def test_append_reads_no_old_file_and_a_batch_counts_once(spark, tmp_path):
    path = tmp_path / "cube"
    for year, name in ((2020, "a"), (2021, "b")):
        incremental.append_slab(spark, str(path), spark.createDataFrame(grid_rows([date(year, 5, d) for d in (1, 2)], CELLS), ROWS), name)
    for file in path.glob("year=*/*.parquet"):
        file.write_bytes(b"not parquet")  # whoever reads it fails
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    slab = spark.createDataFrame(grid_rows([date(2021, 5, 2), date(2022, 5, 1)], CELLS, 30.0), ROWS)
    for name in ("c", "c", "d"):
        incremental.append_slab(spark, str(path), slab, name)
    got = spark.read.schema(ROWS).parquet(str(path / "year=2022"))
    assert got.count() == 9 and {r["sst"] for r in got.collect()} == {30.0}
    assert not list(path.glob("year=2021/*.parquet"))[1:]


def test_a_moved_slab_leaves_the_other_cells_open_and_keeps_products(spark, tmp_path):
    path = str(tmp_path / "cube")
    incremental.append_slab(spark, path, spark.createDataFrame(grid_rows([day(0)], CELLS), ROWS))
    moved = [(lat + 0.1, lon + 0.1) for lat, lon in CELLS]
    mixed = grid_rows([day(1)], moved, 30.0, "reprocessed") + grid_rows([day(2)], moved, 31.0)
    incremental.append_slab(spark, path, spark.createDataFrame(mixed, ROWS))
    rows = spark.read.parquet(path).where(F.col("dt") > day(0))
    assert {(r["dt"], r["product"]): r["count"] for r in rows.groupBy("dt", "product").count().collect()} == {
        (day(1), "reprocessed"): 4, (day(2), "nrt"): 4}
    incremental.append_slab(spark, path, spark.createDataFrame(grid_rows([day(1)], CELLS, 25.0), ROWS))
    first = spark.read.parquet(path).where(F.col("dt") == day(1))
    assert {r["sst"]: r["count"] for r in first.groupBy("sst").count().collect()} == {30.0: 4, 25.0: 5}


def test_a_batch_cut_off_before_its_commit_goes_on(spark, tmp_path):
    path = str(tmp_path / "cube")
    incremental.append_slab(spark, path, spark.createDataFrame(grid_rows([day(0)], CELLS), ROWS), "a")
    slab = spark.createDataFrame(grid_rows([day(1), day(2)], CELLS, 22.0), ROWS)
    Manifest(spark, path).intend("b", [2022])
    write_cube(slab.where(F.col("lat") < 41), path, mode="append")  # and then the lights went out
    for name in ("b", "b", "c"):
        incremental.append_slab(spark, path, slab, name)
    got = spark.read.parquet(path)
    assert got.count() == 27 == got.select("dt", "lat", "lon").distinct().count()
    assert {r["dt"]: r["n"] for r in Manifest(spark, path).days().collect()} == {day(i): 9 for i in range(3)}
    incremental.compact_years(spark, path, [2022])
    assert spark.read.parquet(path).count() == 27
