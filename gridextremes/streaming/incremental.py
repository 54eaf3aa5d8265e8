"""Scheduled refreshes: append new days, detect again at the end of the cube, backfill."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scalars import freshness_bucket
from ..operators.detect import detect_events
from ..operators.merge import KEYS, one_per_day
from ..operators.raster import regrid_bilinear
from ..schemas import CUBE
from ..session import materialise
from ..sources.cube import harmonise, read_cube
from ..sources.sinks import write_cube
from .manifest import Manifest

TRAILING_DAYS = 60


def append_slab(spark: SparkSession, cube_path: str, slab: DataFrame, batch: str | None = None) -> None:
    """Add the rows of a harmonised slab whose day and cell the stored cube lacks.

    What the cube holds is read from its manifest (see ``Manifest``), not from the
    cube; only days of which it has some cells but not all are looked up in their
    years. New rows are appended to the year folders, nothing is rewritten. Rows
    that repeat a day and cell are stored once. A slab on cells the cube does not have is
    interpolated onto the cube's, each cell and day with its own product; cells
    that it does not reach stay open for later slabs. A ``batch`` that is already
    committed adds nothing; one that was cut off goes on where it stopped. Only the
    slab's years go to the driver.
    """
    batch = batch or uuid.uuid4().hex
    manifest, cube = Manifest(spark, cube_path), stored_cube(spark, cube_path)
    if cube is not None:
        manifest.recover(cube)
        if manifest.is_committed(batch):
            return
    new = one_per_day(slab)
    if cube is not None:
        cells = materialise(manifest.cells(), "cells")
        if not new.select("lat", "lon").distinct().join(cells, ["lat", "lon"], "left_anti").isEmpty():
            moved = regrid_bilinear(new.select("dt", "lat", "lon", "sst", "product"), cells, label="product")
            new = moved.where(F.col("sst").isNotNull()).select("dt", "lat", "lon", "sst", "product")
        new = _lacking(cube, manifest.days(), cells.count(), new)
    new = materialise(new, "new-days")
    years = [r[0] for r in new.select(F.year("dt")).distinct().collect()]
    if years:
        manifest.intend(batch, years)
        write_cube(new, cube_path, mode="append")
    manifest.commit(batch, new)


def _lacking(cube: DataFrame, days: DataFrame, n_cells: int, slab: DataFrame) -> DataFrame:
    """Rows of ``slab`` whose day and cell the cube lacks, the cube's days being known with their number of rows."""
    known = slab.join(days, "dt", "left")
    open_days = materialise(
        known.where((F.col("n") > 0) & (F.col("n") < n_cells)).select("dt", F.year("dt").alias("year")).distinct(), "open-days")
    fresh = known.where(F.coalesce("n", F.lit(0)) == 0).select(slab.columns)
    years = [r[0] for r in open_days.select("year").distinct().collect()]
    if not years:
        return fresh
    there = cube.where(F.col("year").isin(years)).join(open_days.select("dt"), "dt", "left_semi").select(*KEYS)
    return fresh.unionByName(slab.join(open_days.select("dt"), "dt", "left_semi").join(there, KEYS, "left_anti"))


def stored_cube(spark: SparkSession, path: str) -> DataFrame | None:
    """The cube of a folder, none if there is none yet; no file is opened for its layout."""
    try:
        return spark.read.schema(StructType([*CUBE, StructField("year", IntegerType())])).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def compact_years(spark: SparkSession, cube_path: str, years: list[int]) -> None:
    """Write year folders anew with the files of a single write; what they hold stays the same."""
    rows = materialise(spark.read.parquet(cube_path).where(F.col("year").isin(years)), "compacted")
    rows.repartitionByRange("year", "lat", "lon").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("year").parquet(cube_path)


def detect_recent(spark: SparkSession, cube_path: str, clim: DataFrame, today: date,
                  days: int = TRAILING_DAYS) -> DataFrame:
    """Events of the trailing days, against the stored climatology."""
    return detect_events(read_cube(spark, cube_path, today - timedelta(days=days), today), clim)


def append_day(spark: SparkSession, cube_path: str, slab: DataFrame, clim: DataFrame, today: date) -> DataFrame:
    append_slab(spark, cube_path, slab)
    return detect_recent(spark, cube_path, clim, today)


def stream_append(spark: SparkSession, slab_path: str, slab_schema: StructType, cube_path: str,
                  checkpoint: str, every: str | None = None, product: str = "nrt",
                  files: int | None = None) -> StreamingQuery:
    """Append every slab file that lands in a folder; all at once, or ``every`` so often.

    ``files`` bounds a micro-batch. A micro-batch that comes again after a failure is
    known by its number and the checkpoint, and adds nothing twice.
    """
    stream = f"{zlib.crc32(checkpoint.encode()):08x}"

    def add(batch: DataFrame, number: int) -> None:
        append_slab(batch.sparkSession, cube_path, harmonise(batch, product), f"stream-{stream}-{number}")

    reader = spark.readStream.schema(slab_schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    writer = reader.parquet(slab_path).writeStream.foreachBatch(add).option(
        "checkpointLocation", checkpoint
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def backfill(years: list[int], load: Callable[[int], DataFrame], cube_path: str) -> list[tuple[int, str]]:
    """Write one year after the other, each replacing its own folder; goes on after
    an error. Returns the outcome per year."""
    outcome = []
    for year in years:
        try:
            rows = load(year).where(F.year("dt") == year).withColumn("year", F.lit(year))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "year"
            ).parquet(cube_path)
            outcome.append((year, "ok"))
        except Exception as e:  # the next years do not depend on this one
            outcome.append((year, f"failed: {type(e).__name__}"))
    return outcome


def freshness(cube: DataFrame, log: DataFrame, now: str) -> DataFrame:
    """One row: extent of the cube, last successful refresh, its age and bucket.

    ``log`` has ``finished_at, ok``; ``now`` is a timestamp text.
    """
    last = log.where("ok").agg(F.max("finished_at").alias("t")).scalar()
    row = cube.agg(F.min("dt").alias("cube_start"), F.max("dt").alias("cube_end")).withColumn(
        "last_success_at", last
    )
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_success_at")
    return row.withColumn("age_seconds", age).withColumn("bucket", freshness_bucket(F.col("age_seconds")))
