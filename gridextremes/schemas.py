"""Table layouts shared by the whole package."""

from __future__ import annotations

from pyspark.sql import types as T

CUBE = T.StructType([
    T.StructField("dt", T.DateType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("sst", T.DoubleType()),
    T.StructField("product", T.StringType()),
])

CLIM = T.StructType([
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("doy", T.IntegerType()),
    T.StructField("seas", T.DoubleType()),
    T.StructField("thresh", T.DoubleType()),
])

CLIM_ATTRS = T.StructType([
    T.StructField("clim_start", T.IntegerType()),
    T.StructField("clim_end", T.IntegerType()),
    T.StructField("window_half_width", T.IntegerType()),
    T.StructField("smooth_width", T.IntegerType()),
    T.StructField("pctile", T.DoubleType()),
    T.StructField("source_dataset", T.StringType()),
    T.StructField("grid_resolution", T.StringType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("created_utc", T.StringType()),
    T.StructField("schema_version", T.StringType()),
])

BOX = T.StructType([
    T.StructField("x0", T.DoubleType()),
    T.StructField("y0", T.DoubleType()),
    T.StructField("x1", T.DoubleType()),
    T.StructField("y1", T.DoubleType()),
])

# Footprints are not an array column of the event: a cluster may cover most of
# the grid, so its cells stay rows of FOOTPRINT, keyed by event_id. ``is_point``
# marks clusters of one event, which count as the centre of their cell.
EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_seq", T.LongType()),
    T.StructField("date_start", T.DateType()),
    T.StructField("date_end", T.DateType()),
    T.StructField("date_peak", T.DateType()),
    T.StructField("duration_days", T.IntegerType()),
    T.StructField("intensity_max", T.DoubleType()),
    T.StructField("intensity_mean", T.DoubleType()),
    T.StructField("intensity_cumulative", T.DoubleType()),
    T.StructField("category", T.IntegerType()),
    T.StructField("category_name", T.StringType()),
    T.StructField("centroid_lon", T.DoubleType()),
    T.StructField("centroid_lat", T.DoubleType()),
    T.StructField("bbox", BOX),
    T.StructField("n_pixels", T.IntegerType()),
    T.StructField("geom_type", T.StringType()),
])

FOOTPRINT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("ilat", T.IntegerType()),
    T.StructField("ilon", T.IntegerType()),
    T.StructField("is_point", T.BooleanType()),
])

POINT = T.StructType([
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
])

OVERLAY = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("feature_id", T.StringType()),
    T.StructField("props", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geom_type", T.StringType()),
    T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(POINT)))),
    T.StructField("xmin", T.DoubleType()),
    T.StructField("ymin", T.DoubleType()),
    T.StructField("xmax", T.DoubleType()),
    T.StructField("ymax", T.DoubleType()),
])

FARM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
])

SEGMENT = T.StructType([
    T.StructField("seg_id", T.LongType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("class", T.StringType()),
    T.StructField("length_km", T.DoubleType()),
])

CLASS_GRID = T.StructType([
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("class", T.StringType()),
    T.StructField("rate", T.DoubleType()),
])
