"""Overlay features from GeoJSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import OVERLAY

# Coordinates nest differently per geometry type: they are read as text first.
_FEATURE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.StringType()),
    ])),
])


def read_geojson(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Features of FeatureCollection files, or of files with one feature per line.

    The latter split over tasks; a collection is one document and is read by
    one task per file. Features without a usable geometry are left out.
    """
    lines = spark.read.schema(_FEATURE).json(path)
    collection = T.StructType([T.StructField("features", T.ArrayType(_FEATURE))])
    whole = spark.read.schema(collection).option("multiLine", True).json(path).select(
        F.explode("features").alias("f")
    ).select("f.*")
    return to_overlay(lines.where(F.col("geometry").isNotNull()).unionByName(whole), kind)


def to_overlay(features: DataFrame, kind: str) -> DataFrame:
    """OVERLAY rows from ``id, properties, geometry(type, coordinates as text)``."""
    text, geom = F.col("geometry.coordinates"), F.col("geometry.type")

    def point(p):
        return F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))

    def ring(r):
        return F.transform(r, point)

    def polygon(p):
        return F.transform(p, ring)

    one = F.from_json(text, "array<double>")
    many = F.from_json(text, "array<array<double>>")
    rings = F.from_json(text, "array<array<array<double>>>")
    polygons = F.from_json(text, "array<array<array<array<double>>>>")
    parts = (
        F.when(geom == "Point", F.array(F.array(F.array(point(one)))))
        .when(geom == "MultiPoint", F.array(F.array(ring(many))))
        .when(geom == "Polygon", F.array(polygon(rings)))
        .when(geom == "MultiPolygon", F.transform(polygons, polygon))
    )
    rows = features.select(
        F.lit(kind).alias("kind"),
        F.coalesce(F.col("id"), F.col("properties")["SITECODE"],
                   F.sha2(F.concat_ws("|", F.to_json("properties"), text), 256)).alias("feature_id"),
        F.col("properties").alias("props"), geom.alias("geom_type"), parts.alias("parts"),
    )
    points = F.flatten(F.flatten("parts"))
    usable = (F.size(points) > 0) & F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return rows.where(F.col("parts").isNotNull()).where(usable).select(
        "kind", "feature_id", "props", "geom_type", "parts",
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"),
    ).select(*OVERLAY.fieldNames())


def site_attributes(overlay: DataFrame) -> DataFrame:
    """Typed columns of the protected areas."""
    props = F.col("props")
    return overlay.where(F.col("kind") == "mpa").select(
        "feature_id", props["SITECODE"].alias("site_code"), props["SITENAME"].alias("site_name"),
        props["MS"].alias("member_state"), props["SITETYPE"].alias("site_type"),
        F.try_to_timestamp(props["RELEASE_DATE"]).alias("release_date"),
        props["Area_ha"].try_cast("double").alias("area_ha"),
    )
