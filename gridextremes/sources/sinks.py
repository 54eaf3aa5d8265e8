"""Writing events, anomalies, derived cubes and climatologies."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rings import point_wkb, polygons_wkb
from ..operators.grid import cell_key
from ..operators.quality import SCHEMA_VERSION
from ..operators.impact import EMPTY_IMPACT

# --- fixed values: the columns of the event table ------------------------------
CSV_COLUMNS = [
    "event_id", "date_start", "date_end", "date_peak", "duration_days",
    "intensity_max", "intensity_mean", "intensity_cumulative",
    "category", "category_name", "n_pixels", "centroid_lon", "centroid_lat",
    "n_aquaculture_sites", "mpa_area_km2", "seagrass_area_km2",
]
CRS = "EPSG:4326"
# ----------------------------------------------------------------------------


def flat_events(events: DataFrame) -> DataFrame:
    """The flat event table; a missing impact counts as 0."""
    if "impact" in events.columns:
        fields = {c: F.coalesce(F.col("impact")[c], F.lit(v)) for c, v in EMPTY_IMPACT.items()}
    else:
        fields = {c: F.lit(v) for c, v in EMPTY_IMPACT.items()}
    return events.select(*[fields[c].alias(c) if c in fields else F.col(c) for c in CSV_COLUMNS])


def write_events_csv(events: DataFrame, path: str) -> None:
    flat_events(events).write.mode("overwrite").csv(path, header=True, dateFormat="yyyy-MM-dd")


def geometry_json(geom_type: Column, polygons: Column, x: Column, y: Column) -> Column:
    """GeoJSON geometry text from polygons (rings of points) or a point."""
    nested = F.transform(polygons, lambda rings: F.transform(
        rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    ))
    coordinates = (
        F.when(geom_type == "Point", F.to_json(F.array(x, y)))
        .when(geom_type == "MultiPolygon", F.to_json(nested))
        .otherwise(F.to_json(F.get(nested, F.lit(0))))
    )
    return F.concat(F.lit('{"type":"'), geom_type, F.lit('","coordinates":'), coordinates, F.lit("}"))


def feature_lines(shaped: DataFrame) -> DataFrame:
    """One GeoJSON feature per row, from events with ``polygons`` (see ``with_geometry``)."""
    names = [
        "event_id", "date_start", "date_end", "date_peak", "duration_days", "intensity_max",
        "intensity_mean", "intensity_cumulative", "category", "category_name", "n_pixels",
    ]
    properties = F.struct(
        *names, F.array("centroid_lon", "centroid_lat").alias("centroid"),
        *([F.col("impact")] if "impact" in shaped.columns else []),
    )
    geometry = geometry_json(
        F.col("geom_type"), F.col("polygons"), F.col("centroid_lon"), F.col("centroid_lat")
    )
    return shaped.select(F.concat(
        F.lit('{"type":"Feature","id":"'), "event_id", F.lit('","geometry":'), geometry,
        F.lit(',"properties":'), F.to_json(properties), F.lit("}"),
    ).alias("value"))


def write_geojson(shaped: DataFrame, path: str) -> None:
    """GeoJSON text sequence: one feature per line, written in parallel."""
    feature_lines(shaped).write.mode("overwrite").text(path)


@F.arrow_udf(T.BinaryType())
def _wkb(polygons: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    rows = zip(polygons.to_pylist(), x.to_pylist(), y.to_pylist())
    return pa.array(
        [point_wkb(px, py) if shape is None else polygons_wkb(shape) for shape, px, py in rows], pa.binary()
    )


def geo_events(shaped: DataFrame) -> DataFrame:
    """The flat table plus a WKB column whose metadata names the reference system."""
    flat = shaped.withColumn("geometry", _wkb("polygons", "centroid_lon", "centroid_lat"))
    impact = F.col("impact") if "impact" in shaped.columns else F.struct(
        *[F.lit(v).alias(k) for k, v in EMPTY_IMPACT.items()]
    )
    named = flat.withColumn("impact", impact)
    geometry = F.col("geometry").alias("geometry", metadata={"crs": CRS, "encoding": "WKB"})
    return named.select(*[
        F.coalesce(F.col("impact")[c], F.lit(EMPTY_IMPACT[c])).alias(c) if c in EMPTY_IMPACT else F.col(c)
        for c in CSV_COLUMNS
    ], geometry)


def write_geoparquet(shaped: DataFrame, path: str) -> None:
    geo_events(shaped).write.mode("overwrite").option("compression", "snappy").parquet(path)


def anomaly_text(anomaly: DataFrame) -> DataFrame:
    """Fixed-point text columns; a NULL value becomes an empty field."""
    def text(pattern, c):
        return F.when(F.col(c).isNotNull(), F.format_string(pattern, c)).otherwise(F.lit(""))

    return anomaly.select(
        text("%.6f", "lat").alias("latitude"), text("%.6f", "lon").alias("longitude"),
        text("%.4f", "anomaly").alias("anomaly_degC"),
    )


def write_anomaly_csv(anomaly: DataFrame, path: str) -> None:
    anomaly_text(anomaly).write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def derived_by_year(derived: DataFrame, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """The rows of the years wanted, in the order of the files: by year, cell and day.

    ``derived_cube`` has dealt them to ranges of cells, so they are sorted where they lie.
    Dealing them to ranges here would move all rows again, and derive them twice to find the ranges.
    """
    rows = derived.withColumn("year", F.year("dt"))
    if first_year is not None:
        rows = rows.where(F.col("year") >= first_year)
    if last_year is not None:
        rows = rows.where(F.col("year") <= last_year)
    return rows.withColumn("cell", cell_key()).sortWithinPartitions("year", "cell", "dt").drop("cell")


def write_derived(derived: DataFrame, path: str, first_year: int | None = None,
                  last_year: int | None = None) -> None:
    """Derived cube by year, cells near each other in the same files."""
    derived_by_year(derived, first_year, last_year).write.mode("overwrite").partitionBy("year").parquet(path)


def write_cube(cube: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows = cube.withColumn("year", F.year("dt"))
    rows.repartitionByRange("year", "lat", "lon").write.mode(mode).partitionBy("year").parquet(path)


def write_climatology(clim: DataFrame, attrs: dict, path: str) -> None:
    """Rows as Parquet, attributes as one JSON line beside them."""
    clim.write.mode("overwrite").parquet(f"{path}/clim")
    line = json.dumps({**attrs, "schema_version": SCHEMA_VERSION}, sort_keys=True)
    clim.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/attrs")
