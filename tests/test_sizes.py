"""Grids of other sizes and steps than the given tables have."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from gridextremes.functions.scalars import category_index  # noqa: E402
from gridextremes.operators.grid import grid_of  # noqa: E402
from test_queries import DATA, TABLES, table  # noqa: E402
from workload import tables as t  # noqa: E402
from workload.oracle import ORACLE  # noqa: E402
from workload.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    """The smallest tables with 2500 suppliers: 51 cells per side."""
    path = tmp_path_factory.mktemp("sf")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    con.execute("CREATE OR REPLACE TABLE supplier AS SELECT * REPLACE (k AS s_suppkey) FROM "
                "(SELECT * FROM supplier LIMIT 1), (SELECT unnest(generate_series(1, 2500)) AS k)")
    con.execute("CREATE OR REPLACE TABLE lineitem AS SELECT * REPLACE ((l_orderkey * 7 + l_linenumber * 13) % 2500 + 1 AS l_suppkey) "
                "FROM lineitem WHERE year(l_shipdate) = 1998")
    for name in TABLES:
        con.execute(f"COPY {name} TO '{path}/{name}.parquet' (FORMAT parquet)")
    return con, str(path)


def test_steps_are_halves():
    assert [t.step_of(w) for w in (4, 48, 49, 96, 97, 3200)] == [0.75, 0.75, 0.375, 0.375, 0.1875, 0.005859375]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", ["cover_area", "mask_grow", "overlay_bbox", "decimated_cells", "impact_area", "site_events",
                                  "coast_buffer", "ellipse_class_shares"])
def test_more_cells_than_the_given_tables(spark, larger, name):
    con, path = larger
    df = QUERIES[name](spark, path)
    cursor = con.execute(ORACLE[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in cursor.description], cursor.fetchall())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_places_lie_where_cells_are(spark, larger):
    _, path = larger
    g = t.grid(spark, path)
    west, south = g.lon0 - g.lon_step / 2, g.lat0 - g.lat_step / 2
    spans = {}
    for name, df in (("farms", t.farms(spark, path)), ("class cells", t.class_cells(spark, path)), ("coast", t.coast(spark, path))):
        rows = [(r["lon"] - west, r["lat"] - south) for r in df.collect()]
        inside = [0 <= x <= g.n_lon * g.lon_step and 0 <= y <= g.n_lat * g.lat_step for x, y in rows]
        assert sum(inside) > 0.95 * len(inside), name  # the region begins half a standard step before the first cell
        spans[name] = max(x for x, _ in rows) / (g.n_lon * g.lon_step)
    assert min(spans.values()) > 0.9


def cells(spark, lats, lons=(10.0, 10.25)):
    return spark.createDataFrame([(a, b) for a in lats for b in lons], "lat double, lon double")


def test_axes_with_gaps(spark):
    g = grid_of(cells(spark, [40.0, 40.5, 40.75, 41.0]))
    assert (g.lat_step, g.n_lat, g.lon_step) == (0.25, 5, 0.25)
    fine = grid_of(cells(spark, [30 + k / 24 for k in (0, 1, 2, 700)]))
    assert fine.n_lat == 701 and abs(fine.lat_step - 1 / 24) < 1e-12
    assert grid_of(cells(spark, [40.0])).n_lat == 1
    with pytest.raises(ValueError):
        grid_of(cells(spark, [40.0, 40.25, 40.6]))


def test_category_without_a_threshold(spark):
    rows = spark.createDataFrame([(25.0, 20.0, None), (25.0, 20.0, 19.0), (25.0, 20.0, 21.0), (None, 20.0, 21.0)], "m double, c double, t double")
    assert [r[0] for r in rows.select(category_index(rows.m, rows.c, rows.t)).collect()] == [None, 1, 5, None]
