"""Plans of joins and the size of tasks, which small results do not show."""

from datetime import date

from helpers import cube_of, flat_clim
from pyspark.sql import functions as F

from gridextremes.operators import climatology, compound, coverage, raster, skew
from gridextremes.operators.cluster import active_days, cluster_members, tile_links
from gridextremes.operators.detect import cell_events
from gridextremes.operators.exposure import events_by_cell
from gridextremes.operators.grid import Grid
from gridextremes.operators.impact import event_hits
from gridextremes.operators.numbering import number_by_cell
from gridextremes.session import materialise
from gridextremes.sources import sinks
from workload import tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_table_that_grows_is_broadcast(spark):
    """Small as files, these tables unpack to many rows: a join of two of them deals both by key."""
    day = F.lit("1998-01-01").cast("date")
    events = materialise(spark.range(50).select(
        F.col("id").alias("event_seq"), F.format_string("e%d", "id").alias("event_id"),
        (F.col("id") * 0.25).alias("centroid_lon"), F.lit(40.0).alias("centroid_lat"),
        day.alias("date_start"), F.date_add(day, 60).alias("date_end"), day.alias("date_peak"),
        F.lit(61).alias("duration_days"), F.lit(1).alias("category"), F.lit("Moderate").alias("category_name"),
        *[F.lit(1.0).alias(f"intensity_{c}") for c in ("max", "mean", "cumulative")],
        F.lit(0).alias("ilat"), F.col("id").cast("int").alias("ilon"), F.lit(False).alias("is_point"),
    ), "events")
    footprint = events.select("event_id", "ilat", "ilon", "is_point")
    cover = materialise(footprint.select(
        F.lit("mpa").alias("kind"), F.col("event_id").alias("feature_id"), "ilat", "ilon", F.lit(1.0).alias("area"),
        F.lit(40.0).alias("moment"), F.lit(True).alias("holds_centre")), "cover")
    for name, df, joins in (
        ("links", tile_links(active_days(events, 1.05), 1.5), 2),
        ("members", cluster_members(events), 2),
        ("hits", event_hits(footprint, cover), 1),
        ("by cell", events_by_cell(events.drop("ilat", "ilon", "is_point"), footprint), 1),
        ("numbers", number_by_cell(events.select("ilat", "ilon", F.lit(1).alias("no")), "ilat", "ilon", "no", "n"), 1),
    ):
        assert plan_of(df).count("SortMergeJoin") >= joins, name
    assert "Broadcast" not in plan_of(tile_links(active_days(events, 1.05), 1.5))


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """Rows that sort or unpack large are dealt to tasks by their number, not merged by their size."""
    monkeypatch.setattr(skew, "TASK_ROWS", 10)
    cells = [(40.0 + 0.25 * i, 10.0) for i in range(3)]
    cube = cube_of(spark, {cell: [20.0] * 40 for cell in cells})
    clim = flat_clim(spark, cells)
    salinity = cube.select("dt", "lat", "lon", F.col("sst").alias("sal"))
    square = [(0.1, 0.1), (9.9, 0.1), (9.9, 9.9), (0.1, 9.9), (0.1, 0.1)]
    overlay = spark.sql("SELECT 'mpa' AS kind, 'a' AS feature_id, 'Polygon' AS geom_type, array(array(array({}))) AS parts".format(
        ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in square)))
    for name, df, tasks in (
        ("climatology", climatology.pooled_climatology(cube), 12),
        ("detection", cell_events(cube, clim), 12),
        ("compound days", compound.compound_days(cube, salinity), 24),
        ("regridding", raster.regrid_bilinear(cube, cube.select("lat", "lon")), 48),
        ("cover", coverage.polygon_cover(overlay, Grid(0.5, 1.0, 10, 0.5, 1.0, 10)), 5),
    ):
        assert f", {tasks}), REPARTITION_BY_NUM" in plan_of(df), name


def test_hits_and_days_take_tasks_by_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(skew, "TASK_ROWS", 10)
    footprint = materialise(spark.range(60).select(
        F.format_string("e%d", "id").alias("event_id"), F.lit(0).alias("ilat"), F.lit(0).alias("ilon"), F.lit(False).alias("is_point")), "footprint")
    cover = spark.sql("SELECT 'mpa' AS kind, 'a' AS feature_id, 0 AS ilat, 0 AS ilon, 1D AS area, 40D AS moment, true AS holds_centre")
    assert ", 6), REPARTITION_BY_NUM" in plan_of(event_hits(footprint, materialise(cover, "cover")))
    spark.sql("SELECT id AS s_suppkey FROM range(3)").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("SELECT id % 3 AS l_suppkey, timestamp'1998-01-01' + make_dt_interval(CAST(id AS INT)) AS l_shipdate, 1D AS l_quantity "
              "FROM range(40)").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert ", 12), REPARTITION_BY_NUM" in plan_of(tables.daily(spark, str(tmp_path), "l_quantity"))
    assert tables.daily(spark, str(tmp_path), "l_quantity").count() == 3 * 40


def test_the_edges_of_a_cover_are_moved_once(spark):
    """Not the pieces that they are cut into, which are many more on a fine grid."""
    overlay = materialise(spark.sql("SELECT 'mpa' AS kind, 'a' AS feature_id, 'Polygon' AS geom_type, array(array(array("
                                    "named_struct('x', 0D, 'y', 0D), named_struct('x', 9D, 'y', 0D), named_struct('x', 9D, 'y', 9D)))) AS parts"), "overlay")
    assert plan_of(coverage.polygon_cover(overlay, Grid(0.5, 0.25, 80, 0.5, 0.25, 80))).count("Exchange ") == 1


def test_the_derived_cube_is_moved_once(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 10)
    cube = cube_of(spark, {(40.0 + 0.25 * i, 10.0): [20.0] * 40 for i in range(3)})
    plan = plan_of(sinks.derived_by_year(raster.derived_cube(cube)))
    assert plan.count("Exchange ") == 1 and ", 12), REPARTITION_BY_NUM" in plan


def test_trailing_sums_of_days(spark, tmp_path):
    """Only days with lines are moved; a repeated supplier gives its days twice, one without lines only zeros."""
    day = "timestamp'2000-01-01' + make_interval(0, 0, 0, cast({} as int))"
    spark.sql(f"select k as l_suppkey, {day.format('d')} as l_shipdate, q as l_quantity from values "
              "(0L, 0, 2.5D), (0L, 0, null), (0L, 3, 4D), (0L, 20, 1D), (1L, 30, null), (7L, 2, 9D), (null, 2, 9D) as t(k, d, q)"
              ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select s_suppkey from values (0L), (1L), (2L), (2L) as t(s_suppkey)").write.parquet(f"{tmp_path}/supplier.parquet")
    sums = tables._trailing(spark, str(tmp_path), "l_quantity")
    assert "Window" not in plan_of(sums) and "Generate" not in plan_of(sums)
    got = {}
    for r in sums.collect():
        got.setdefault(r["k"], []).append(((r["dt"] - date(2000, 1, 1)).days, r["sw"], r["nw"]))
    first = {i: (2.5, 2) if i < 3 else (6.5, 3) if i < 15 else (4.0, 1) if i < 18 else (0.0, 0) if i < 20 else (1.0, 1) for i in range(31)}
    assert sorted(got[0]) == [(i, *first[i]) for i in range(31)]
    assert sorted(got[1]) == [(i, 0.0, int(i == 30)) for i in range(31)]
    assert sorted(got[2]) == sorted(2 * [(i, 0.0, 0) for i in range(31)]) and set(got) == {0, 1, 2}
    assert tables.daily(spark, str(tmp_path), "l_quantity").where("k = 1 and n = 1 and s is null").count() == 1
