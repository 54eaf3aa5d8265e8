import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridextremes.operators import coverage
from gridextremes.operators.coverage import cover_cells, point_groups, polygon_cover
from gridextremes.operators.grid import Grid
from gridextremes.sources.overlays import read_geojson, site_attributes, to_overlay

GRID = Grid(lat0=0.5, lat_step=1.0, n_lat=8, lon0=0.5, lon_step=1.0, n_lon=8)
FEATURES = "id string, properties map<string,string>, geometry struct<type:string,coordinates:string>"


def overlay(spark, *shapes, kind="mpa"):
    rows = [(f"f{i}", {"SITECODE": f"S{i}"}, (t, json.dumps(c))) for i, (t, c) in enumerate(shapes)]
    return to_overlay(spark.createDataFrame(rows, FEATURES), kind)


def cells(df):
    return {(r["feature_id"], r["ilat"], r["ilon"]): r for r in df.collect()}


def square(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]


def test_square_with_touching_borders(spark):
    got = cells(polygon_cover(overlay(spark, ("Polygon", [square(2, 2, 4, 3.5)])), GRID))
    area = {k[1:]: round(v["area"], 12) for k, v in got.items()}
    assert {k: v for k, v in area.items() if v} == {(2, 2): 1.0, (2, 3): 1.0, (3, 2): 0.5, (3, 3): 0.5}
    # Closed sets: cells that share only a side or a corner are touched too.
    assert set(area) == {(r, c) for r in (1, 2, 3) for c in (1, 2, 3, 4)}
    assert got["f0", 2, 2]["holds_centre"] and got["f0", 3, 2]["holds_centre"] and not got["f0", 1, 1]["holds_centre"]


@pytest.mark.parametrize("turn", [1, -1])
def test_triangle_area_and_moment(spark, turn):
    ring = [[0.3, 0.2], [7.1, 1.7], [2.9, 6.6], [0.3, 0.2]][::turn]
    rows = polygon_cover(overlay(spark, ("Polygon", [ring])), GRID)
    total = rows.agg(F.sum("area"), F.sum("moment")).first()
    (x0, y0), (x1, y1), (x2, y2) = ring[:3]
    area = abs((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2
    assert total[0] == pytest.approx(area, abs=1e-9) and total[1] / total[0] == pytest.approx((y0 + y1 + y2) / 3, abs=1e-9)
    assert rows.agg(F.max("area")).first()[0] <= 1 + 1e-9


def test_hole_and_parts(spark):
    shape = ("MultiPolygon", [[square(0, 0, 5, 5), square(1, 1, 4, 4)], [square(6, 6, 8, 7)]])
    got = cells(polygon_cover(overlay(spark, shape), GRID))
    assert sum(v["area"] for v in got.values()) == pytest.approx(16 + 2)
    assert ("f0", 2, 2) not in got and not got["f0", 1, 1]["holds_centre"] and got["f0", 0, 2]["holds_centre"]


def test_random_polygons_against_sampling(spark):
    rng = np.random.default_rng(4)
    shapes = []
    for _ in range(6):
        a = np.sort(rng.uniform(0, 2 * math.pi, 9))
        r = rng.uniform(0.7, 3.3, 9)
        pts = [[4 + float(k * math.cos(t)), 4 + float(k * math.sin(t))] for t, k in zip(a, r)]
        shapes.append(("Polygon", [pts]))  # not closed: closed on reading edges
    got = cells(polygon_cover(overlay(spark, *shapes), GRID))
    xs = (np.arange(400) + 0.5) / 50
    gx, gy = np.meshgrid(xs, xs)
    for i, (_, (pts,)) in enumerate(shapes):
        inside = np.zeros(gx.shape, bool)
        for (x0, y0), (x1, y1) in zip(pts, pts[1:] + pts[:1]):
            hit = (y0 > gy) != (y1 > gy)
            with np.errstate(divide="ignore", invalid="ignore"):
                inside ^= hit & (gx < (x1 - x0) * (gy - y0) / (y1 - y0) + x0)
        share = inside.reshape(8, 50, 8, 50).mean(axis=(1, 3))
        centre = inside[24::50, 24::50]
        for r in range(8):
            for c in range(8):
                cell = got.get((f"f{i}", r, c))
                assert (cell["area"] if cell else 0.0) == pytest.approx(share[r, c], abs=0.02)
                if 0.0 < share[r, c] and cell and abs(share[r, c] - 0.5) > 0.3:
                    assert cell["holds_centre"] == bool(centre[r, c])


def test_blocks_of_columns_do_not_show(spark, monkeypatch):
    rng = np.random.default_rng(12)
    shapes = [("Polygon", [square(-3, 1, 20, 2.5)]), ("Polygon", [square(0.5, 0.5, 7.5, 7.5), square(1, 1, 7, 7)])]
    for _ in range(6):
        a, r = np.sort(rng.uniform(0, 2 * math.pi, 9)), rng.uniform(0.7, 3.3, 9)
        shapes.append(("Polygon", [[[4 + float(k * math.cos(t)), 4 + float(k * math.sin(t))] for t, k in zip(a, r)]]))

    def found(columns):
        monkeypatch.setattr(coverage, "BLOCK_COLUMNS", columns)
        rows = polygon_cover(overlay(spark, *shapes), GRID).collect()
        assert len({(r["feature_id"], r["ilat"], r["ilon"]) for r in rows}) == len(rows)
        return sorted((r["feature_id"], r["ilat"], r["ilon"], round(r["area"], 9), round(r["moment"], 9), r["holds_centre"]) for r in rows)

    assert found(16) == found(3) == found(1)


def test_polygon_beyond_the_grid(spark):
    got = cells(polygon_cover(overlay(spark, ("Polygon", [square(-3, -3, 20, 20)])), GRID))
    assert len(got) == 64 and all(v["area"] == pytest.approx(1) and v["holds_centre"] for v in got.values())


def test_points(spark):
    shapes = [("Point", [2.5, 2.5]), ("Point", [3.0, 2.2]), ("Point", [3.0, 3.0]), ("Point", [99, 0]), ("MultiPoint", [[0.1, 0.1], [7.9, 7.9]])]
    rows = overlay(spark, *shapes, kind="aquaculture")
    got = cells(cover_cells(rows, GRID))
    assert {k[1:] for k in got if k[0] == "f1"} == {(2, 2), (2, 3)} and len([k for k in got if k[0] == "f2"]) == 4
    assert got["f0", 2, 2]["holds_centre"] and len([k for k in got if k[0] == "f3"]) == 0 and len([k for k in got if k[0] == "f4"]) == 2
    same = overlay(spark, *[("Point", [1.1 + i / 100, 1.2]) for i in range(50)], kind="aquaculture")
    groups = point_groups(same, GRID).collect()
    assert len(groups) == 1 and groups[0]["n"] == 50


def test_geojson_files(spark, tmp_path):
    features = [
        {"type": "Feature", "id": "a", "properties": {"SITECODE": "x1", "Area_ha": 12.5, "SITENAME": None, "RELEASE_DATE": "2020-01-02"},
         "geometry": {"type": "Polygon", "coordinates": [square(0, 0, 1, 1)]}},
        {"type": "Feature", "properties": {"SITECODE": "x2", "Area_ha": "n/a"}, "geometry": {"type": "Point", "coordinates": [3, 4]}},
        {"type": "Feature", "id": "bad", "properties": {}, "geometry": {"type": "Polygon", "coordinates": "nonsense"}},
        {"type": "Feature", "id": "none", "properties": {}, "geometry": None},
    ]
    one = tmp_path / "one.geojson"
    one.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    rows = {r["feature_id"]: r for r in read_geojson(spark, str(one), "mpa").collect()}
    assert set(rows) == {"a", "x2"} and rows["a"]["xmax"] == 1.0 and rows["x2"]["parts"][0][0][0]["y"] == 4.0
    lines = tmp_path / "lines.geojsonl"
    lines.write_text("\n".join(json.dumps(f) for f in features))
    assert {r["feature_id"] for r in read_geojson(spark, str(lines), "mpa").collect()} == {"a", "x2"}
    typed = {r["site_code"]: r for r in site_attributes(read_geojson(spark, str(one), "mpa")).collect()}
    assert typed["x1"]["area_ha"] == 12.5 and typed["x2"]["area_ha"] is None and typed["x1"]["release_date"].year == 2020
