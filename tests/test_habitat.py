"""Ellipses over places, by a pyramid of tiles."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from gridextremes.operators.habitat import class_overlap, ellipse_tiles, tile_pyramid

CLASSES = ["rock", "sand"]


def half_up(value, digits):
    return float(Decimal(value).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def brute(ellipses, cells):
    out = {}
    for e, lon, lat, sx, sy in ellipses:
        inside = [c for c in cells if ((c[0] - lon) / sx) ** 2 + ((c[1] - lat) / sy) ** 2 <= 1.0]
        n = len(inside)
        out[e] = (n, *[half_up(sum(c[2] == k for c in inside) / n, 3) if n else 0.0 for k in CLASSES],
                  half_up(sum(c[3] for c in inside) / n, 2) if n else 0.0)
    return out


def frames(spark, ellipses, cells):
    return (spark.createDataFrame(ellipses, "event_id string, lon double, lat double, sx double, sy double"),
            spark.createDataFrame(cells, "lon double, lat double, class string, rate double"))


@pytest.mark.parametrize("levels", [1, 3, 7])
def test_against_brute_force(spark, levels):
    deal = random.Random(levels)
    cells = [(deal.randrange(-80, 80) / 16, deal.randrange(-80, 80) / 16, deal.choice(CLASSES), deal.randrange(4) / 2) for _ in range(1500)]
    cells += [(0.25, 0.25, "rock", 1.0)] * 300  # one place many times
    ellipses = [(f"e{i}", deal.randrange(-64, 64) / 16, deal.randrange(-64, 64) / 16, deal.choice([0.25, 0.3, 1.5, 4.0]), deal.choice([0.25, 0.3, 2.0]))
                for i in range(40)] + [("all", 0.0, 0.0, 60.0, 50.0), ("none", 90.0, 80.0, 0.5, 0.5)]
    got = {r["event_id"]: tuple(r)[1:] for r in class_overlap(*frames(spark, ellipses, cells), CLASSES, levels=levels).collect()}
    assert got == brute(ellipses, cells)


def test_tiles_grow_with_the_border(spark):
    ellipses, _ = frames(spark, [(f"{r}", 0.1, 0.2, float(r), float(r)) for r in (4, 8, 16, 32)], [(0.0, 0.0, "rock", 1.0)])
    counts = {int(r["event_id"]): r for r in ellipse_tiles(ellipses).groupBy("event_id").agg(
        F.count_if(~F.col("whole")).alias("border"), F.count_if(F.col("whole")).alias("whole"),
        F.sum(F.when(F.col("whole"), F.pow(F.lit(4.0), F.col("level")) * 0.0625)).alias("area")).collect()}
    for r in (4, 8, 16):
        assert counts[2 * r]["border"] < 2.2 * counts[r]["border"] and counts[2 * r]["whole"] < 2.4 * counts[r]["whole"]
    # 51 471 finest tiles lie in the largest; what is joined is a small part of that.
    assert counts[32]["border"] + counts[32]["whole"] < 0.05 * 3.1416 * 32**2 / 0.0625
    assert counts[32]["area"] == pytest.approx(3.1416 * 32**2, rel=0.02)


def test_pyramid_sums_all_places(spark):
    cells = [(x / 8, y / 8, CLASSES[(x + y) % 2], 1.0) for x in range(-20, 20) for y in range(-20, 20)]
    _, places = frames(spark, [("e", 0.0, 0.0, 1.0, 1.0)], cells)
    tiled = places.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n"), F.sum("rate").alias("rate"), *[
        F.count_if(F.col("class") == c).alias(f"n_{c}") for c in CLASSES]).withColumns(
        {"tx": F.floor(F.col("lon") / 0.25).cast("int"), "ty": F.floor(F.col("lat") / 0.25).cast("int")})
    rows = tile_pyramid(tiled, CLASSES, 5).groupBy("level").agg(F.sum("n").alias("n"), F.sum("rate").alias("rate"), F.sum("n_rock").alias("rock"),
                                                              F.count(F.lit(1)).alias("tiles")).orderBy("level").collect()
    assert [(r["n"], r["rate"], r["rock"]) for r in rows] == [(1600, 1600.0, 800)] * 5
    assert [r["tiles"] for r in rows] == [400, 100, 36, 16, 4]
