import pytest
from pyspark.sql import functions as F

from gridextremes.functions import scalars as S


def values(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_category_index(spark):
    rows = [(22.0, 20.0, 21.0), (20.5, 20.0, 21.0), (25.0, 20.0, 21.0), (24.0, 20.0, 21.0), (23.0, 20.0, 21.0),
            (29.0, 20.0, 21.0), (22.0, 20.0, 20.0), (22.0, 20.0, 19.0)]
    got = values(spark, "s double, c double, t double", rows, S.category_index(F.col("s"), F.col("c"), F.col("t")))
    assert got == [2, 1, 5, 4, 3, 5, 1, 1]


def test_grid_category_differs_without_a_margin(spark):
    rows = [(22.0, 20.0, 21.0), (21.0, 20.0, 21.0), (20.9, 20.0, 21.0), (26.0, 20.0, 21.0), (20.0, 20.0, 20.0), (None, 20.0, 21.0)]
    got = values(spark, "s double, c double, t double", rows, S.grid_category(F.col("s"), F.col("c"), F.col("t")))
    assert got == [2, 1, 0, 5, 5, 0]


@pytest.mark.parametrize("lon,lat,code", [
    (33.0, 35.0, "EG"), (20.0, 33.0, "LY"), (7.0, 37.0, "TN"), (6.9, 37.0, "DZ"), (-3.0, 35.0, "MA"),
    (-2.0, 38.5, "ES"), (3.0, 42.0, "FR"), (12.0, 40.0, "IT"), (20.0, 44.0, "HR"), (24.0, 38.0, "GR"),
    (33.0, 36.8, "CY"), (30.0, 37.0, "TR"), (-20.0, 40.0, "??"),
])
def test_country(spark, lon, lat, code):
    assert values(spark, "x double, y double", [(lon, lat)], S.country_of(F.col("x"), F.col("y"))) == [code]


def test_freshness_and_product(spark):
    hour = 3600
    rows = [(0,), (6 * hour,), (24 * hour,), (72 * hour,), (None,)]
    assert values(spark, "a long", rows, S.freshness_bucket(F.col("a"))) == [
        "fresh", "good", "stale", "very_stale", "unknown"]
    spans = [("2024-06-02", "2024-06-03"), ("2022-01-01", "2022-02-01"), ("2024-01-01", "2024-02-01"), ("2020-01-01", "2024-06-03")]
    today = F.lit("2024-06-01").cast("date")
    assert values(spark, "a string, b string", spans, S.product_for(F.to_date("a"), F.to_date("b"), today)) == [
        "forecast", "reanalysis", "nrt", "nrt"]


def test_texts(spark):
    row = spark.range(1).select(
        S.event_id_text(F.lit(7)), S.cluster_id_text(F.lit(12)),
        S.impact_sentence(F.lit(2), F.lit(1.5), F.lit(0.0)), S.site_code(F.lit(" ita01 ")),
        S.split_bbox(F.lit("1,2,3.5,4")), S.split_interval(F.lit("2020-01-01/..")), S.split_interval(F.lit("2020-01-05T00:00:00Z")),
    ).first()
    assert row[0] == "mhw-000007" and row[1] == "mhw-cluster-0012" and row[3] == "ITA01"
    assert row[2] == "2 aquaculture site(s), 1.5 km² MPA, 0.0 km² seagrass"
    assert tuple(row[4]) == (1.0, 2.0, 3.5, 4.0)
    assert str(row[5]["start"]) == "2020-01-01" and row[5]["end"] is None
    assert str(row[6]["start"]) == str(row[6]["end"]) == "2020-01-05"


def test_kelvin_and_area(spark):
    rows = [(300.0, " Kelvin "), (300.0, "K"), (20.0, "degC"), (None, "k")]
    got = values(spark, "v double, u string", rows, F.round(S.to_celsius(F.col("v"), F.col("u")), 4))
    assert got == [26.85, 26.85, 20.0, None]
    km2 = values(spark, "a double, m double", [(1.0, 0.0), (0.0, 0.0), (2.0, 120.0)], S.degrees2_to_km2(F.col("a"), F.col("m")))
    assert km2[0] == pytest.approx(111.32 ** 2) and km2[1] == 0.0 and km2[2] == pytest.approx(111.32 ** 2)
