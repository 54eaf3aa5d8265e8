"""Events against class cells and coast segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import KM_PER_DEGREE_DISTANCE, local_km
from ..session import materialise
from .skew import exact_percentile, hot_join, keyed_join

# --- fixed values -----------------------------------------------------------
VULNERABILITY = {"biogenic": 1.0, "rock": 0.7, "sand": 0.3, "mud": 0.1}
RATE_CLASSES = ["low", "medium", "high"]
ERODING = "eroding"
MUCH_ERODING = 0.30
# ----------------------------------------------------------------------------


def _tiles(low, high, side: float):
    return F.explode(F.sequence(
        F.floor(low / F.lit(side)).cast("int"), F.floor(high / F.lit(side)).cast("int")
    ))


TILE_DEG = 0.25  # side of the finest tiles
LEVELS = 7  # sides double from level to level
MARGIN = 1e-9  # of the squared distance: tiles nearer to the border are tested place by place


def _sums(classes: list[str]) -> list:
    return [F.sum(c).alias(c) for c in ("n", "rate", *(f"n_{c}" for c in classes))]


def tile_pyramid(places: DataFrame, classes: list[str], levels: int = LEVELS) -> DataFrame:
    """``level, tx, ty`` and the sums of all places in the tile, for tiles of every level.

    Places are summed in the finest tiles first; those go to all their larger ones at once.
    """
    tiles = places.groupBy("tx", "ty").agg(*_sums(classes))
    above = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.struct(
        k.alias("level"), F.call_function("shiftright", F.col("tx"), k).alias("x"), F.call_function("shiftright", F.col("ty"), k).alias("y")))
    spread = tiles.withColumn("t", F.explode(above)).select(
        "t.level", F.col("t.x").alias("tx"), F.col("t.y").alias("ty"), "n", "rate", *(f"n_{c}" for c in classes))
    return spread.groupBy("level", "tx", "ty").agg(*_sums(classes))


def ellipse_tiles(ellipses: DataFrame, tile_deg: float = TILE_DEG, levels: int = LEVELS) -> DataFrame:
    """The tiles of every ellipse: ``whole`` ones inside it, as large as fit, and the finest ones on its border.

    From the coarsest tiles that meet its box down, a tile outside is dropped, one
    inside stays as it is, and any other gives way to its four parts. So the tiles
    grow with the border in finest tiles, not with the area. Only column functions
    of the ellipse are used; nothing is joined.
    """
    side = tile_deg * 2 ** (levels - 1)
    tiles = ellipses.select(
        "event_id", "lon", "lat", "sx", "sy", _tiles(F.col("lon") - F.col("sx"), F.col("lon") + F.col("sx"), side).alias("tx"),
    ).select("*", _tiles(F.col("lat") - F.col("sy"), F.col("lat") + F.col("sy"), side).alias("ty")).withColumns(
        {"level": F.lit(levels - 1), "whole": F.lit(False)})

    def reach(side: float, tile: str, centre: str, radius: str) -> tuple:
        low = F.col(tile) * F.lit(side) - F.col(centre)
        high = low + F.lit(side)
        near = F.greatest(F.lit(0.0), low, -high) / F.col(radius)
        far = F.greatest(F.abs(low), F.abs(high)) / F.col(radius)
        return near * near, far * far

    for level in reversed(range(levels)):
        (near_u, far_u), (near_v, far_v) = (reach(tile_deg * 2**level, *names) for names in (("tx", "lon", "sx"), ("ty", "lat", "sy")))
        tiles = tiles.where(F.col("whole") | (near_u + near_v <= 1 + MARGIN)).withColumn(
            "whole", F.col("whole") | (far_u + far_v <= 1 - MARGIN))
        if level:
            own = F.array(F.struct("level", "tx", "ty"))
            parts = F.array(*[F.struct(F.lit(level - 1).alias("level"), (F.col("tx") * 2 + i).alias("tx"), (F.col("ty") * 2 + j).alias("ty"))
                              for i in (0, 1) for j in (0, 1)])
            tiles = tiles.withColumn("tile", F.explode(F.when(F.col("whole"), own).otherwise(parts))).select(
                "event_id", "lon", "lat", "sx", "sy", "whole", "tile.level", "tile.tx", "tile.ty")
    return tiles


def class_overlap(ellipses: DataFrame, cells: DataFrame, classes: list[str], weights: dict[str, float] | None = None,
                  tile_deg: float = TILE_DEG, levels: int = LEVELS) -> DataFrame:
    """Class shares of the cells inside each event's ellipse, with the mean rate.

    ``ellipses`` has ``event_id, lon, lat, sx, sy``, ``cells`` ``lon, lat, class,
    rate``. Events without a cell stay, with zeros. With ``weights`` a score is
    added: the sum of the rounded shares times the weights.

    Tiles inside an ellipse give their sums; only places in tiles on its border are
    tested one by one.
    """
    # A place given many times becomes one row with a count.
    places = cells.groupBy("lon", "lat").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rate").alias("rate"),
        *[F.count_if(F.col("class") == c).alias(f"n_{c}") for c in classes],
    ).select(
        "*",
        F.floor(F.col("lon") / F.lit(tile_deg)).cast("int").alias("tx"),
        F.floor(F.col("lat") / F.lit(tile_deg)).cast("int").alias("ty"),
    ).withColumnsRenamed({"lon": "cell_lon", "lat": "cell_lat"})
    sums = ["event_id", "n", "rate", *(f"n_{c}" for c in classes)]
    # Each is read several times below.
    places, tiles = materialise(places, "places"), materialise(ellipse_tiles(ellipses, tile_deg, levels), "tiles")
    whole = hot_join(tiles.where("whole").select("event_id", "level", "tx", "ty"), tile_pyramid(places, classes, levels),
                     ["level", "tx", "ty"]).select(sums)
    u = (F.col("cell_lon") - F.col("lon")) / F.col("sx")
    v = (F.col("cell_lat") - F.col("lat")) / F.col("sy")
    border = hot_join(places, tiles.where(~F.col("whole")).drop("whole", "level"), ["tx", "ty"]).where(u * u + v * v <= 1.0).select(sums)
    counts = whole.unionByName(border).groupBy("event_id").agg(*_sums(classes)).withColumnRenamed("n", "cells")
    share = {
        c: F.coalesce(F.round(F.col(f"n_{c}") / F.col("cells"), 3), F.lit(0.0)) for c in classes
    }
    out = keyed_join(ellipses.select("event_id"), counts, "event_id", "left")
    columns = [
        "event_id", F.coalesce("cells", F.lit(0)).alias("cells"),
        *[share[c].alias(f"share_{c}") for c in classes],
        F.coalesce(F.round(F.col("rate") / F.col("cells"), 2), F.lit(0.0)).alias("mean_rate"),
    ]
    if weights:
        score = sum((share[c] * F.lit(weights[c]) for c in classes), F.lit(0.0))
        columns.append(F.round(score, 3).alias("score"))
    return out.select(*columns)


def basin_shares(cells: DataFrame, classes: list[str]) -> DataFrame:
    """Share of every class over all cells."""
    return cells.agg(*[
        F.round(F.avg((F.col("class") == c).cast("double")), 3).alias(f"share_{c}") for c in classes
    ])


def rate_range(cells: DataFrame) -> DataFrame:
    """Smallest, largest and median rate."""
    median = exact_percentile(cells, "rate", 0.5, "m").scalar()
    return cells.agg(F.min("rate").alias("rate_min"), F.max("rate").alias("rate_max")).select(
        F.round("rate_min", 2).alias("rate_min"), F.round("rate_max", 2).alias("rate_max"),
        F.round(median, 2).alias("rate_median"),
    )


def rank_events(overlap: DataFrame, by: str) -> DataFrame:
    """Largest value of ``by`` first."""
    return overlap.orderBy(F.desc(by), "event_id")


def coast_buffer(events: DataFrame, segments: DataFrame, buffer_km: float = 50.0) -> DataFrame:
    """Coast near each event, and how much of it erodes.

    ``events`` has ``event_id, lon, lat``, ``segments`` ``lon, lat, class,
    length_km``. Distances are on a plane scaled at the mean of the event's
    latitude and the mean latitude of all segments.
    """
    side = buffer_km / KM_PER_DEGREE_DISTANCE
    mean_segment_lat = segments.agg(F.avg("lat").alias("m")).scalar()
    places = segments.groupBy("lon", "lat").agg(
        F.sum("length_km").alias("length"),
        F.sum(F.when(F.col("class") == ERODING, F.col("length_km")).otherwise(0.0)).alias("eroding"),
    ).select(
        F.col("lon").alias("seg_lon"), F.col("lat").alias("seg_lat"), "length", "eroding",
        F.floor(F.col("lon") / F.lit(side)).cast("int").alias("tx"),
        F.floor(F.col("lat") / F.lit(side)).cast("int").alias("ty"),
    )
    scaled = events.select(
        "event_id", "lon", "lat", ((F.col("lat") + mean_segment_lat) / 2).alias("mean_lat")
    )
    # Rounded outwards a little, so that rounding never drops a tile.
    reach_y = F.lit(side * 1.000001)
    reach_x = reach_y / F.cos(F.radians("mean_lat"))
    reach = scaled.select(
        "*", _tiles(F.col("lon") - reach_x, F.col("lon") + reach_x, side).alias("tx")
    ).select("*", _tiles(F.col("lat") - reach_y, F.col("lat") + reach_y, side).alias("ty"))
    km = local_km(F.col("lon"), F.col("lat"), F.col("seg_lon"), F.col("seg_lat"), F.col("mean_lat"))
    near = hot_join(places, reach, ["tx", "ty"]).where(km <= buffer_km).groupBy("event_id").agg(
        F.sum("length").alias("length"), F.sum("eroding").alias("eroding")
    )
    return keyed_join(events.select("event_id"), near, "event_id", "left").select(
        "event_id",
        F.round(F.coalesce("length", F.lit(0.0)), 2).alias("near_km"),
        F.round(F.coalesce("eroding", F.lit(0.0)), 2).alias("eroding_km"),
        F.round(F.when(F.col("length") > 0, F.col("eroding") / F.col("length")).otherwise(0.0), 3)
        .alias("eroding_fraction"),
    )


def buffer_summary(near: DataFrame) -> DataFrame:
    return near.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.round(F.avg("eroding_fraction"), 3).alias("mean_eroding_fraction"),
        F.round(F.max("eroding_fraction"), 3).alias("max_eroding_fraction"),
        F.count_if(F.col("eroding_fraction") >= MUCH_ERODING).alias("events_above_30pct"),
    )


def coast_totals(segments: DataFrame) -> DataFrame:
    total = F.sum("length_km")
    eroding = F.sum(F.when(F.col("class") == ERODING, F.col("length_km")).otherwise(0.0))
    return segments.agg(
        F.round(total, 1).alias("coast_total_km"), F.round(eroding, 1).alias("coast_eroding_km"),
        F.round(100 * eroding / total, 1).alias("coast_eroding_pct"),
    )
