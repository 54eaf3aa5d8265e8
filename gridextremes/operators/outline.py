"""Outlines of event footprints."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rings import assemble_polygons
from ..session import materialise
from .components import connected_components
from .grid import Grid
from .skew import keyed_join

LIST_CORNERS = 4096  # an event with more corners is closed ring by ring in joins, never as one list

CORNERS = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))))
POLYGONS = T.ArrayType(T.ArrayType(T.ArrayType(T.StructType([
    T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())
]))))


def outline_edges(footprint: DataFrame) -> DataFrame:
    """Cell sides with the footprint on one side only.

    ``side`` is ``h`` (level, from ``(ilon, ilat)`` to the right) or ``v``
    (upright, from there upwards) and ``sign`` +1 or -1 if the inside lies to
    the left of that direction or to its right.
    """
    c, r = F.col("ilon"), F.col("ilat")

    def side(kind, ilon, ilat, sign):
        return F.struct(F.lit(kind).alias("side"), ilon.alias("ilon"), ilat.alias("ilat"), F.lit(sign).alias("sign"))

    sides = F.array(
        side("h", c, r, 1), side("h", c, r + 1, -1), side("v", c, r, -1), side("v", c + 1, r, 1)
    )
    return (
        footprint.select("event_id", "ilat", "ilon").distinct()
        .select("event_id", F.explode(sides).alias("s")).select("event_id", "s.*")
        .groupBy("event_id", "side", "ilon", "ilat").agg(F.sum("sign").cast("int").alias("sign"))
        .where(F.col("sign") != 0)
    )


def outline_segments(edges: DataFrame) -> DataFrame:
    """Straight edges in a row made one, directed with the inside on the left."""
    level = F.col("side") == "h"
    along = F.when(level, F.col("ilon")).otherwise(F.col("ilat"))
    across = F.when(level, F.col("ilat")).otherwise(F.col("ilon"))
    lines = edges.select("event_id", "side", "sign", along.alias("along"), across.alias("across"))
    # One line of the grid per window.
    line = W.partitionBy("event_id", "side", "across", "sign").orderBy("along")
    runs = lines.withColumn("run", F.col("along") - F.row_number().over(line)).groupBy(
        "event_id", "side", "across", "sign", "run"
    ).agg(F.min("along").alias("a"), (F.max("along") + 1).alias("b"))
    first = F.when(F.col("sign") > 0, F.col("a")).otherwise(F.col("b"))
    last = F.when(F.col("sign") > 0, F.col("b")).otherwise(F.col("a"))
    level = F.col("side") == "h"
    return runs.select(
        "event_id",
        F.when(level, first).otherwise(F.col("across")).alias("x0"),
        F.when(level, F.col("across")).otherwise(first).alias("y0"),
        F.when(level, last).otherwise(F.col("across")).alias("x1"),
        F.when(level, F.col("across")).otherwise(last).alias("y1"),
    )


@F.arrow_udf(POLYGONS)
def _assemble(segments: pa.Array) -> pa.Array:
    return pa.array([
        [[[{"x": x, "y": y} for x, y in ring + ring[:1]] for ring in rings]
         for rings in assemble_polygons([tuple(s.values()) for s in event])]
        for event in segments.to_pylist()
    ], CORNERS)


def footprint_outline(footprint: DataFrame, grid: Grid, decimals: int = 4, list_corners: int = LIST_CORNERS) -> DataFrame:
    """``event_id, polygons``: the union of the cells of every event.

    A polygon is a region of cells that meet in sides, its outer ring first. Rings
    begin at their smallest corner; polygons and holes are in the order of these.
    Events of at most ``list_corners`` corners are assembled as one bounded list each.
    The corners of larger ones are never gathered before they are rings: see ``closed_rings``.
    """
    footprint = footprint.select("event_id", "ilat", "ilon").distinct()
    segments = materialise(outline_segments(outline_edges(footprint)), "segments")
    large = materialise(segments.groupBy("event_id").count().where(F.col("count") > list_corners).select("event_id"), "large_events")
    corners = keyed_join(segments, large, "event_id", "left_anti").groupBy("event_id").agg(
        F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("segments")
    ).select("event_id", _assemble("segments").alias("corners"))
    if not large.isEmpty():
        corners = corners.unionByName(_assemble_large(
            keyed_join(segments, large, "event_id", "left_semi"), keyed_join(footprint, large, "event_id", "left_semi")))

    def place(p):
        return F.struct(
            F.round(grid.west(p["x"]), decimals).alias("x"), F.round(grid.south(p["y"]), decimals).alias("y")
        )

    return corners.select("event_id", F.transform(
        "corners", lambda rings: F.transform(rings, lambda ring: F.transform(ring, place))
    ).alias("polygons"))


# Segments of an event are numbered by their first corner and direction (0 east, 1 north, 2 west, 3 south), so the
# smallest number of a ring is that of its smallest corner.

def _number(x, y, way):
    return F.shiftleft(x.cast("long"), 34) + F.shiftleft(y.cast("long"), 4) + way


def _followed(segments: DataFrame) -> DataFrame:
    """``segments`` with ``s``, their number, ``to``, the next one turning left where two go on, and ``other`` there."""
    way = F.when(F.col("x1") > F.col("x0"), 0).when(F.col("y1") > F.col("y0"), 1).when(F.col("x1") < F.col("x0"), 2).otherwise(3)
    rows = segments.withColumn("way", way)
    leaving = rows.groupBy("event_id", F.col("x0").alias("x1"), F.col("y0").alias("y1")).agg(F.collect_set("way").alias("ways"))
    left, right = F.pmod(F.col("way") + 1, F.lit(4)), F.pmod(F.col("way") + 3, F.lit(4))
    turned = F.when(F.array_contains(F.col("ways"), left), left).otherwise(right)
    return keyed_join(rows, leaving, ["event_id", "x1", "y1"]).select(
        "event_id", "x0", "y0", "x1", "y1", "way", _number(F.col("x0"), F.col("y0"), F.col("way")).alias("s"),
        _number(F.col("x1"), F.col("y1"), turned).alias("to"),
        F.when(F.size("ways") == 2, _number(F.col("x1"), F.col("y1"), right)).alias("other"))


def _jumped(rows: DataFrame) -> DataFrame:
    """``rows`` (``event_id, s, to`` and values) with ``to`` and the values of the segment ``to`` leads to, as ``far_...``."""
    values = [c for c in rows.columns if c not in ("event_id", "s")]
    ahead = rows.select("event_id", F.col("s").alias("to"), *[F.col(c).alias(f"far_{c}") for c in values])
    return keyed_join(rows, ahead, ["event_id", "to"], "left")


def _ring_of(follows: DataFrame) -> DataFrame:
    """``event_id, s, ring``: the smallest number on the ring of each segment.

    Each round doubles the stretch of the ring a segment has seen. When no number
    falls any more, all stretches of a ring have the same smallest one.
    """
    rows = materialise(follows.select("event_id", "s", "to", F.col("s").alias("ring")), "rings")
    while True:
        wide = rows
        for _ in range(2):
            wide = _jumped(wide).select("event_id", "s", F.col("far_to").alias("to"), F.least("ring", "far_ring").alias("ring"))
        before = rows.select("event_id", "s", F.col("ring").alias("before"))
        wide = materialise(keyed_join(wide, before, ["event_id", "s"]), "rings")
        if wide.where("ring < before").isEmpty():
            return wide.select("event_id", "s", "ring")
        rows = wide.drop("before")


def closed_rings(segments: DataFrame) -> DataFrame:
    """``event_id, ring, corners, area, x, y``: simple closed rings, the cell on their inside, twice their signed area.

    Where two rings touch in a corner each turns left and so stays with its cell. A
    ring that passes a corner twice would be split there, which is the same as
    turning right at it; such corners never interleave, so all are changed at once.
    Segments find their ring and their place on it by pointer jumping: tables of
    segments are joined a number of times that grows with the logarithm of the
    longest ring. Only the corners of one ring come together.
    """
    follows = materialise(_followed(segments), "follows")
    rings = _ring_of(follows)
    on_ring = keyed_join(follows, rings, ["event_id", "s"])
    twice = materialise(on_ring.where(F.col("other").isNotNull()).groupBy("event_id", "x1", "y1").agg(
        F.min("ring").alias("low"), F.max("ring").alias("high")).where("low = high").select("event_id", "x1", "y1"), "twice")
    if not twice.isEmpty():
        turned = keyed_join(follows, twice.withColumn("split", F.lit(True)), ["event_id", "x1", "y1"], "left")
        follows = materialise(turned.withColumn("to", F.when(F.col("split"), F.col("other")).otherwise(F.col("to"))).drop("split"), "follows")
        rings = _ring_of(follows)
    on_ring = materialise(keyed_join(follows, rings, ["event_id", "s"]), "on_ring")
    # Segments up to the end of the ring, which is cut before its smallest corner.
    left = on_ring.select("event_id", "s", F.when(F.col("to") != F.col("ring"), F.col("to")).alias("to")).withColumn(
        "left", F.when(F.col("to").isNull(), 0).otherwise(1))
    while not left.where(F.col("to").isNotNull()).isEmpty():
        for _ in range(2):
            left = _jumped(left).select("event_id", "s", F.col("far_to").alias("to"), (F.col("left") + F.coalesce("far_left", F.lit(0))).alias("left"))
        left = materialise(left, "left")
    placed = keyed_join(on_ring, left.select("event_id", "s", "left"), ["event_id", "s"])
    first = F.col("s") == F.col("ring")
    beside_x = F.col("x0") - F.when(F.col("way").isin(1, 2), 1).otherwise(0)
    beside_y = F.col("y0") - F.when(F.col("way").isin(2, 3), 1).otherwise(0)
    in_order = F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("at"), F.col("x0").alias("x"), F.col("y0").alias("y"))))
    cross = F.col("x0").cast("long") * F.col("y1") - F.col("x1").cast("long") * F.col("y0")
    return placed.groupBy("event_id", "ring").agg(
        F.transform(in_order, lambda c: F.struct(c["x"].cast("int").alias("x"), c["y"].cast("int").alias("y"))).alias("corners"),
        F.sum(cross).alias("area"), F.max(F.when(first, beside_x)).alias("x"), F.max(F.when(first, beside_y)).alias("y"))


def cell_regions(footprint: DataFrame) -> DataFrame:
    """``event_id, ilat, ilon, region``: cells of an event that hang together by sides have one region.

    Cells in a row of the grid are one run; runs of neighbouring rows that overlap are joined.
    """
    row = W.partitionBy("event_id", "ilat").orderBy("ilon")
    runs = footprint.withColumn("run", F.col("ilon") - F.row_number().over(row))
    spans = materialise(runs.groupBy("event_id", "ilat", "run").agg(F.min("ilon").alias("a"), F.max("ilon").alias("b")).withColumn(
        "node", F.struct("event_id", "ilat", "run")), "runs")
    above = spans.select("event_id", (F.col("ilat") - 1).alias("ilat"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("node").alias("other"))
    meet = keyed_join(spans, above, ["event_id", "ilat"]).where((F.col("a") <= F.col("b2")) & (F.col("a2") <= F.col("b")))
    parts = connected_components(meet.select(F.col("node").alias("a"), F.col("other").alias("b")), spans.select("node"))
    return keyed_join(runs, parts.select("node.*", F.col("component").alias("region")), ["event_id", "ilat", "run"]).select(
        "event_id", "ilat", "ilon", "region")


def _assemble_large(segments: DataFrame, footprint: DataFrame) -> DataFrame:
    """``event_id, corners`` as ``_assemble`` gives them; a ring belongs to the region of the cell beside it."""
    regions = cell_regions(footprint).withColumnsRenamed({"ilat": "y", "ilon": "x"})
    rings = keyed_join(closed_rings(segments), regions, ["event_id", "x", "y"])
    closed = F.concat("corners", F.slice("corners", 1, 1))
    polygons = rings.groupBy("event_id", "region").agg(F.sort_array(F.collect_list(
        F.struct((F.col("area") < 0).alias("is_hole"), F.col("ring"), closed.alias("corners")))).alias("rings"))
    return polygons.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("rings")[0]["ring"].alias("first"), F.col("rings.corners").alias("rings")))).alias("p")).select(
        "event_id", F.col("p.rings").alias("corners"))


def with_geometry(events: DataFrame, outlines: DataFrame | None = None, decimals: int = 4) -> DataFrame:
    """Add ``polygons`` and ``geom_type``: the outline if there is one, no polygon
    for points, else the rectangle of the event's box."""
    corner = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]
    box = F.array(F.array(F.array(*[
        F.struct(F.round(F.col("bbox")[x], decimals).alias("x"), F.round(F.col("bbox")[y], decimals).alias("y"))
        for x, y in corner
    ])))
    is_point = F.col("geom_type") == "Point"
    if outlines is None:
        shaped = events.withColumn("polygons", F.when(~is_point, box))
    else:
        shaped = keyed_join(events, outlines, "event_id", "left").withColumn(
            "polygons", F.when(~is_point, F.coalesce("polygons", box))
        )
    return shaped.withColumn("geom_type", F.when(is_point, "Point").when(
        F.size("polygons") > 1, "MultiPolygon").otherwise("Polygon"))
