"""Column functions: categories, country boxes, classes, distances, texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
CATEGORY_NAMES = ["I Moderate", "II Strong", "III Severe", "IV Extreme", "V Super-Extreme"]

# (code, lat min, lat max, lon min, lon max); closed boxes, the first match wins.
COUNTRY_BOXES = [
    ("EG", 30.0, 36.5, 32.0, 36.5),
    ("LY", 30.0, 35.0, 19.0, 32.0),
    ("TN", 30.0, 38.0, 7.0, 19.0),
    ("DZ", 30.0, 38.0, -2.0, 7.0),
    ("MA", 30.0, 36.0, -7.0, -2.0),
    ("ES", 35.0, 39.0, -2.0, 9.0),
    ("FR", 41.0, 43.0, 0.0, 5.0),
    ("IT", 36.0, 46.0, 5.0, 19.0),
    ("HR", 40.0, 46.0, 13.0, 21.0),
    ("GR", 34.0, 42.0, 19.0, 28.0),
    ("CY", 35.0, 37.0, 32.0, 36.0),
    ("TR", 36.0, 42.0, 26.0, 36.0),
]
NO_COUNTRY = "??"

KELVIN_UNITS = ["kelvin", "k", "degrees_kelvin", "degree_kelvin"]
KM_PER_DEGREE_AREA = 111.32
KM_PER_DEGREE_DISTANCE = 111.0
# ----------------------------------------------------------------------------


def category_index(sst_max: Column, clim: Column, thresh: Column) -> Column:
    """Severity 1..5 of an event peak; 1 where the threshold is not above the mean, NULL without one."""
    ratio = F.floor((sst_max - clim) / F.nullif(thresh - clim, F.lit(0.0)))
    return (
        F.when((thresh <= clim) | (ratio < 1), F.lit(1))
        .when(ratio.isNotNull(), F.least(F.lit(5), ratio))
        .cast("int")
    )


def category_name(category: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in CATEGORY_NAMES]), category)


def grid_category(sst: Column, clim: Column, thresh: Column) -> Column:
    """Severity 0..5 of one cell and day of the derived cube.

    Unlike :func:`category_index`, a flagged value whose threshold is not above
    the mean has no ratio and ends in the top class.
    """
    ratio = F.when(thresh > clim, (sst - clim) / (thresh - clim))
    graded = F.lit(5)
    for upper, level in ((5, 4), (4, 3), (3, 2), (2, 1)):
        graded = F.when(ratio < upper, F.lit(level)).otherwise(graded)
    return F.when(grid_flag(sst, thresh) == 0, F.lit(0)).otherwise(graded).cast("tinyint")


def grid_flag(sst: Column, thresh: Column) -> Column:
    return F.coalesce(sst >= thresh, F.lit(False)).cast("tinyint")


def exceeds(sst: Column, thresh: Column) -> Column:
    return F.coalesce(sst > thresh, F.lit(False))


def country_of(lon: Column, lat: Column) -> Column:
    matches = [
        F.when(lat.between(y0, y1) & lon.between(x0, x1), F.lit(code))
        for code, y0, y1, x0, x1 in COUNTRY_BOXES
    ]
    return F.coalesce(*matches, F.lit(NO_COUNTRY))


def rate_class(rate: Column) -> Column:
    return F.when(rate < 1.0, "low").when(rate < 2.0, "medium").otherwise("high")


def freshness_bucket(age_seconds: Column) -> Column:
    hours = age_seconds / 3600
    return (
        F.when(age_seconds.isNull(), "unknown")
        .when(hours < 6, "fresh")
        .when(hours < 24, "good")
        .when(hours < 72, "stale")
        .otherwise("very_stale")
    )


def product_for(start: Column, end: Column, today: Column, lookback_days: int = 365) -> Column:
    """Which product serves a window, seen from ``today``."""
    return (
        F.when(start > today, "forecast")
        .when(end < F.date_sub(today, lookback_days), "reanalysis")
        .otherwise("nrt")
    )


def to_celsius(value: Column, units: Column) -> Column:
    is_kelvin = F.lower(F.trim(units)).isin(*KELVIN_UNITS)
    return F.when(is_kelvin, value - 273.15).otherwise(value)


def local_km(lon: Column, lat: Column, other_lon: Column, other_lat: Column,
             mean_lat: Column) -> Column:
    """Distance in km on a plane scaled at ``mean_lat``."""
    dx = (other_lon - lon) * F.cos(F.radians(mean_lat)) * KM_PER_DEGREE_DISTANCE
    dy = (other_lat - lat) * KM_PER_DEGREE_DISTANCE
    return F.sqrt(dx * dx + dy * dy)


def degrees2_to_km2(area: Column, moment_y: Column) -> Column:
    """Area in square degrees to km², scaled at the area's own centroid latitude."""
    lat = moment_y / area
    km2 = area * KM_PER_DEGREE_AREA * KM_PER_DEGREE_AREA * F.cos(F.radians(lat))
    return F.when(area > 0, km2).otherwise(F.lit(0.0))


def colour_scale(value: Column, low: float = -5.0, high: float = 5.0) -> Column:
    """Position of ``value`` on a colour bar, clipped to 0..1; NULL stays NULL."""
    return F.when(
        value.isNotNull(),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low))),
    )


def event_id_text(seq: Column) -> Column:
    return F.format_string("mhw-%06d", seq)


def cluster_id_text(seq: Column) -> Column:
    return F.format_string("mhw-cluster-%04d", seq)


def impact_sentence(n_sites: Column, mpa_km2: Column, seagrass_km2: Column) -> Column:
    return F.concat(
        n_sites.cast("string"), F.lit(" aquaculture site(s), "),
        mpa_km2.cast("string"), F.lit(" km² MPA, "),
        seagrass_km2.cast("string"), F.lit(" km² seagrass"),
    )


def site_code(code: Column) -> Column:
    return F.upper(F.trim(code))


def split_bbox(text: Column) -> Column:
    """``"x0,y0,x1,y1"`` as a box struct."""
    part = F.split(text, ",")
    return F.struct(*[
        F.try_element_at(part, F.lit(i + 1)).cast("double").alias(name)
        for i, name in enumerate(("x0", "y0", "x1", "y1"))
    ])


def split_interval(text: Column) -> Column:
    """``"a/b"``, ``"a/.."``, ``"../b"`` or one day, as a struct of two dates."""
    part = F.split(F.trim(text), "/")
    first = F.try_element_at(part, F.lit(1))
    last = F.try_element_at(part, F.lit(-1))
    return F.struct(
        F.try_to_date(F.substring(first, 1, 10)).alias("start"),
        F.try_to_date(F.substring(last, 1, 10)).alias("end"),
    )
