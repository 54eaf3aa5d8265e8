"""Space-time clusters: closure of "near and overlapping in time"."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import category_name, cluster_id_text
from ..session import materialise
from .components import connected_components
from .numbering import number_by_key
from .skew import hot_join, keyed_join

# Tiles are a little narrower than distance / sqrt(2), so that two points of a
# tile are always near, also after rounding; partners lie at most 2 tiles away.
TILE_SHARE = 0.7
REACH = 2


@dataclass(frozen=True)
class Clusters:
    """Clusters, the cluster of every event, and the cells each cluster covers."""

    events: DataFrame
    members: DataFrame
    footprint: DataFrame


def _tile(value: Column, side: float) -> Column:
    return F.floor(value / F.lit(side)).cast("int")


def _node(tx: Column, ty: Column, day: Column) -> Column:
    """One number for (tile, first day of a chain): 20, 20 and 22 bits."""
    return (
        F.shiftleft((tx + 2**19).cast("bigint"), 42)
        + F.shiftleft((ty + 2**19).cast("bigint"), 22)
        + (F.unix_date(day) + 2**21)
    )


def active_days(events: DataFrame, side: float) -> DataFrame:
    """One row per event and day, with the tile of the event."""
    return events.select(
        _tile(F.col("centroid_lon"), side).alias("tx"),
        _tile(F.col("centroid_lat"), side).alias("ty"),
        F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat"),
        "date_start", "date_end",
        F.explode(F.sequence("date_start", "date_end")).alias("day"),
    )


def tile_chains(active: DataFrame) -> DataFrame:
    """The chain each (tile, day) belongs to, as a node number.

    Events of one tile are all near each other, so there only time matters: a
    chain goes on as long as some event reaches from one day into the next. A
    tile has one row per day, whatever the number of its events.
    """
    per_day = active.groupBy("tx", "ty", "day").agg(
        F.max(F.col("date_end") > F.col("day")).alias("goes_on")
    )
    by_day = W.partitionBy("tx", "ty").orderBy("day")
    begins = ~F.coalesce(F.lag("goes_on").over(by_day), F.lit(False))
    first = F.max(F.when(begins, F.col("day"))).over(
        by_day.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return per_day.select("tx", "ty", "day", _node(F.col("tx"), F.col("ty"), first).alias("node"))


def tile_links(active: DataFrame, distance: float) -> DataFrame:
    """Tile pairs and days on which they hold near events: ``tx, ty, ux, uy, day``.

    Two events that overlap in time both run on the day the later one starts,
    so starting events of one tile meet running events of the other. Of a line
    of points only the one nearest to the other tile can decide: per tile, day
    and latitude the outermost longitudes stay (per longitude the outermost
    latitudes, for tiles straight above or below). What meets is thus one row
    per grid line of a tile, not one per event.
    """
    side = distance * TILE_SHARE
    starting = active.where(F.col("day") == F.col("date_start"))

    def ends(rows: DataFrame, line: str, along: str) -> DataFrame:
        return rows.groupBy("tx", "ty", "day", F.col(line).alias("line")).agg(
            F.min(along).alias("lo"), F.max(along).alias("hi")
        )

    def meet(line: str, along: str, offsets: list[tuple[int, int]], axis: int) -> DataFrame:
        shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
        ahead = F.col("o.dx" if axis == 0 else "o.dy") > 0
        # Pruned at once by the gap between the outermost point and the tile.
        near_edge = (F.col("tx" if axis == 0 else "ty")
                     + F.col("o.dx" if axis == 0 else "o.dy")
                     + F.when(ahead, 0).otherwise(1)) * F.lit(side)
        out = F.when(ahead, F.col("hi")).otherwise(F.col("lo"))
        left = (
            ends(starting, line, along)
            .select("*", F.explode(shifts).alias("o"))
            .select(
                "tx", "ty", "day", F.col("line").alias("line_a"), out.alias("a"),
                (F.col("tx") + F.col("o.dx")).alias("ux"),
                (F.col("ty") + F.col("o.dy")).alias("uy"),
                ahead.alias("ahead"), F.abs(near_edge - out).alias("gap"),
            )
            .where(F.col("gap") < distance * 1.000001)
        )
        right = ends(active, line, along).select(
            F.col("tx").alias("ux"), F.col("ty").alias("uy"), "day",
            F.col("line").alias("line_b"), "lo", "hi",
        )
        b = F.when(F.col("ahead"), F.col("lo")).otherwise(F.col("hi"))
        d_along, d_line = F.col("a") - b, F.col("line_a") - F.col("line_b")
        return (
            keyed_join(left, right, ["ux", "uy", "day"])
            .where(F.sqrt(d_along * d_along + d_line * d_line) < distance)
            .select("tx", "ty", "ux", "uy", "day")
        )

    span = range(-REACH, REACH + 1)
    sideways = [(dx, dy) for dx in span for dy in span if dx != 0]
    upright = [(0, dy) for dy in span if dy != 0]
    return meet("lat", "lon", sideways, 0).unionByName(meet("lon", "lat", upright, 1)).distinct()


def cluster_members(events: DataFrame, max_distance_deg: float = 1.5) -> DataFrame:
    """``(event_seq, component)`` of the closure over near and overlapping events.

    The graph has a node per (tile, chain) instead of one per event.
    """
    side = max_distance_deg * TILE_SHARE
    active = active_days(events, side)
    chains = materialise(tile_chains(active), "chains")
    links = tile_links(active, max_distance_deg)
    a = chains.withColumnsRenamed({"node": "a"})
    b = chains.select(F.col("tx").alias("ux"), F.col("ty").alias("uy"), "day", F.col("node").alias("b"))
    edges = keyed_join(keyed_join(links, a, ["tx", "ty", "day"]), b, ["ux", "uy", "day"]).select("a", "b").distinct()
    parts = connected_components(edges, chains.select("node").distinct())
    # Chains take the component first, at most one row per tile and day, so that
    # no join has a key with all events of a large cluster.
    starts = keyed_join(chains, parts, "node").select(
        "tx", "ty", F.col("day").alias("date_start"), "component"
    )
    placed = events.select(
        "event_seq", "date_start",
        _tile(F.col("centroid_lon"), side).alias("tx"),
        _tile(F.col("centroid_lat"), side).alias("ty"),
    )
    return keyed_join(placed, starts, ["tx", "ty", "date_start"]).select("event_seq", "component")


def cluster_events(events: DataFrame, max_distance_deg: float = 1.5) -> Clusters:
    """Group events into clusters and roll them up.

    Duration, intensities and category are the largest of the members; the peak
    day is that of the strongest member, the first one among equals. Clusters
    are numbered by their first member.
    """
    events = materialise(events, "events")
    members = materialise(
        keyed_join(events, cluster_members(events, max_distance_deg), "event_seq"), "members"
    )
    rolled = members.groupBy("component").agg(
        F.min("event_seq").alias("first_seq"),
        F.min("date_start").alias("date_start"),
        F.max("date_end").alias("date_end"),
        F.max_by("date_peak", F.struct(F.col("intensity_max"), -F.col("event_seq"))).alias("date_peak"),
        F.max("duration_days").alias("duration_days"),
        F.max("intensity_max").alias("intensity_max"),
        F.max("intensity_mean").alias("intensity_mean"),
        F.max("intensity_cumulative").alias("intensity_cumulative"),
        F.max("category").alias("category"),
        F.struct(
            F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"),
            F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"),
        ).alias("bbox"),
        F.count(F.lit(1)).cast("int").alias("n_pixels"),
    )
    numbered = number_by_key(rolled, "first_seq", "cluster_seq")
    clusters = numbered.select(
        "component",
        cluster_id_text(F.col("cluster_seq")).alias("event_id"),
        F.col("cluster_seq").alias("event_seq"),
        "date_start", "date_end", "date_peak", "duration_days",
        "intensity_max", "intensity_mean", "intensity_cumulative",
        "category", category_name(F.col("category")).alias("category_name"),
        F.round((F.col("bbox.x0") + F.col("bbox.x1")) / 2, 4).alias("centroid_lon"),
        F.round((F.col("bbox.y0") + F.col("bbox.y1")) / 2, 4).alias("centroid_lat"),
        "bbox", "n_pixels",
        F.when(F.col("n_pixels") == 1, "Point").otherwise("Polygon").alias("geom_type"),
    )
    clusters = materialise(clusters, "clusters")
    names = clusters.select(
        "component", F.col("event_id").alias("cluster_id"), (F.col("geom_type") == "Point").alias("is_point")
    )
    named = hot_join(members, names, ["component"])
    footprint = named.select(F.col("cluster_id").alias("event_id"), "ilat", "ilon", "is_point").distinct()
    return Clusters(
        events=clusters.drop("component"),
        members=named.select("event_id", "event_seq", "cluster_id"),
        footprint=materialise(footprint, "footprint"),
    )


def by_severity(clusters: DataFrame) -> DataFrame:
    """Strongest category first, then largest, then earliest."""
    return clusters.orderBy(F.desc("category"), F.desc("n_pixels"), "date_start", "event_seq")
