import json

from pyspark.sql import functions as F
from test_cluster import event, frame

from gridextremes.functions.rings import assemble_polygons, double_area, point_wkb, polygons_wkb
from gridextremes.operators.cluster import Clusters
from gridextremes.operators.grid import Grid
from gridextremes.operators.outline import cell_regions, footprint_outline, outline_edges, outline_segments, with_geometry
from gridextremes.sources import sinks
from gridextremes.sources.cube import read_events
from workload import queries

GRID = Grid(lat0=40.125, lat_step=0.25, n_lat=9, lon0=10.125, lon_step=0.25, n_lon=9)


def foot(spark, cells, name="e"):
    return spark.createDataFrame([(name, r, c) for r, c in cells], "event_id string, ilat int, ilon int")


def polygons(spark, cells):
    segments = [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in outline_segments(outline_edges(foot(spark, cells))).collect()]
    got = assemble_polygons(segments)
    assert sum(double_area(ring) for p in got for ring in p) == 2 * len(set(cells))
    return sorted([len(ring) for ring in p] for p in got)


def test_shapes(spark):
    assert polygons(spark, [(0, 0)]) == [[4]]
    assert polygons(spark, [(0, 0), (0, 1)]) == [[4]]
    assert polygons(spark, [(0, 0), (0, 1), (1, 0)]) == [[6]]
    assert polygons(spark, [(0, 0), (5, 5)]) == [[4], [4]]
    assert polygons(spark, [(0, 0), (1, 1)]) == [[4], [4]]  # a common corner does not join
    assert polygons(spark, [(0, 0), (1, 1), (0, 1)]) == [[6]]


def test_holes(spark):
    ring = [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    assert polygons(spark, ring) == [[4, 4]]
    # A hole that meets the outside in a corner stays a hole.
    notch = [c for c in ring if c != (2, 2)]
    assert polygons(spark, notch) == [[6, 4]]
    # Two holes that meet in a corner.
    two = [(r, c) for r in range(4) for c in range(4) if (r, c) not in ((1, 1), (2, 2))]
    assert polygons(spark, two) == [[4, 4, 4]]
    # An island in a hole.
    island = [(r, c) for r in range(5) for c in range(5) if r in (0, 4) or c in (0, 4) or (r, c) == (2, 2)]
    assert polygons(spark, island) == [[4], [4, 4]]


def test_many_random_footprints_keep_their_area(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    for share in (0.3, 0.5, 0.7):
        polygons(spark, [(int(r), int(c)) for r in range(9) for c in range(9) if rng.random() < share])


def test_lists_and_joins_give_the_same_polygons(spark):
    """Random footprints, full of holes, islands and touching corners, by either way."""
    import numpy as np

    rng = np.random.default_rng(3)
    cells = []
    for k in range(40):
        side, share = int(rng.integers(3, 9)), rng.choice([0.3, 0.5, 0.6, 0.7, 0.85])
        cells += [(f"e{k}", r, c) for r in range(side) for c in range(side) if rng.random() < share]
    ring = [(r, c) for r in range(4) for c in range(4) if (r, c) not in ((1, 1), (2, 2))]
    comb = [(r, c) for r in range(40) for c in range(40) if r == 0 or c % 2 == 0]
    cells += [("two holes", *c) for c in ring] + [("comb", *c) for c in comb] + [("notch", *c) for c in ring if c != (3, 3)]
    frame_ = spark.createDataFrame(cells, "event_id string, ilat int, ilon int")
    plain = {r["event_id"]: r["polygons"] for r in footprint_outline(frame_, GRID).collect()}
    joined = {r["event_id"]: r["polygons"] for r in footprint_outline(frame_, GRID, list_corners=0).collect()}
    assert len(plain) > 40 and plain == joined
    mixed = {r["event_id"]: r["polygons"] for r in footprint_outline(frame_, GRID, list_corners=60).collect()}
    assert mixed == plain


def test_regions(spark):
    got = cell_regions(foot(spark, [(0, 0), (0, 1), (1, 1), (2, 0), (3, 0), (3, 1), (3, 2), (2, 2), (5, 5)])).collect()
    by = {}
    for r in got:
        by.setdefault(r["region"], set()).add((r["ilat"], r["ilon"]))
    assert sorted(map(sorted, by.values())) == [[(0, 0), (0, 1), (1, 1)], [(2, 0), (2, 2), (3, 0), (3, 1), (3, 2)], [(5, 5)]]


def shaped(spark):
    events = frame(spark, [event(1, 10.125, 40.125, 0, 9), event(2, 11.0, 41.0, 0, 9), event(3, 12.0, 41.0, 0, 9)])
    kinds = events.withColumn("geom_type", F.when(F.col("event_seq") == 3, "Point").otherwise("Polygon"))
    outlines = footprint_outline(foot(spark, [(0, 0), (0, 1), (5, 5)], "mhw-000001"), GRID)
    return with_geometry(kinds, outlines).drop("ilat", "ilon")


def test_feature_lines(spark):
    got = {f["id"]: f for f in (json.loads(r["value"]) for r in sinks.feature_lines(shaped(spark)).collect())}
    assert got["mhw-000001"]["geometry"]["type"] == "MultiPolygon"
    rings = [p[0] for p in got["mhw-000001"]["geometry"]["coordinates"]]
    assert sorted(rings)[0][0] == [10.0, 40.0] and all(r[0] == r[-1] for r in rings)
    assert got["mhw-000002"]["geometry"] == {"type": "Polygon", "coordinates": [[[10.875, 40.875], [11.125, 40.875], [11.125, 41.125], [10.875, 41.125], [10.875, 40.875]]]}
    assert got["mhw-000003"]["geometry"] == {"type": "Point", "coordinates": [12.0, 41.0]}
    assert got["mhw-000003"]["properties"]["centroid"] == [12.0, 41.0] and got["mhw-000003"]["properties"]["date_start"] == "2022-06-01"


def test_files(spark, tmp_path):
    events = shaped(spark)
    sinks.write_events_csv(events, str(tmp_path / "csv"))
    lines = sorted(line for f in (tmp_path / "csv").glob("*.csv") for line in f.read_text().splitlines())
    assert lines[0].split(",") == sinks.CSV_COLUMNS and "mhw-000002,2022-06-01,2022-06-10,2022-06-01,10,1.0,0.5,3.0,1,x,1,11.0,41.0,0,0.0,0.0" in lines
    sinks.write_geoparquet(events, str(tmp_path / "geo"))
    back = read_events(spark, str(tmp_path / "geo"))
    assert back.schema["geometry"].metadata["crs"] == "EPSG:4326" and back.count() == 3
    wkb = {r["event_id"]: bytes(r["geometry"]) for r in back.collect()}
    assert wkb["mhw-000003"] == point_wkb(12.0, 41.0) and wkb["mhw-000001"][:5] == b"\x01\x06\x00\x00\x00"
    assert wkb["mhw-000002"] == polygons_wkb([[[{"x": x, "y": y} for x, y in ((10.875, 40.875), (11.125, 40.875), (11.125, 41.125), (10.875, 41.125), (10.875, 40.875))]]])
    sinks.write_geojson(events, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).count() == 3
    text = events.select("event_id", F.lit("2020-13-01").alias("date_start"), F.col("date_end").cast("string").alias("date_end"))
    text.write.parquet(str(tmp_path / "text"))
    row = read_events(spark, str(tmp_path / "text")).first()
    assert row["date_start"] is None and str(row["date_end"]) == "2022-06-10"


def test_polygons_and_rings_per_cluster(spark, monkeypatch):
    """The query counts polygons, rings and cells of every cluster, also where a step has more digits than a coordinate."""
    grid = Grid(lat0=34.0, lat_step=0.046875, n_lat=9, lon0=4.0, lon_step=0.046875, n_lon=9)
    ring = [(r, c) for r in range(5) for c in range(5) if r in (0, 4) or c in (0, 4) or (r, c) == (2, 2)]
    cells = {"hole": [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)], "corner": [(0, 0), (1, 1)], "island": ring, "one": [(7, 7)]}
    events = frame(spark, [event(i + 1, 4.0, 34.0, 0, 9) for i in range(len(cells))]).withColumn(
        "event_id", F.element_at(F.array(*map(F.lit, cells)), F.col("event_seq").cast("int"))).withColumn(
        "geom_type", F.when(F.col("event_id") == "one", "Point").otherwise("Polygon"))
    footprint = spark.createDataFrame([(e, r, c, e == "one") for e, at in cells.items() for r, c in at],
                                      "event_id string, ilat int, ilon int, is_point boolean")
    monkeypatch.setattr(queries.t, "clusters", lambda *_: Clusters(events.drop("ilat", "ilon"), None, footprint))
    monkeypatch.setattr(queries.t, "grid", lambda *_: grid)
    got = {r["event_id"]: (r["n_polygons"], r["n_rings"], r["n_cells"]) for r in queries.QUERIES["cluster_polygons"](spark, "").collect()}
    assert got == {"hole": (1, 2, 8.0), "corner": (2, 2, 2.0), "island": (2, 3, 17.0), "one": (0, 0, 0.0)}
