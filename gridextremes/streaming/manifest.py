"""What a stored cube holds, written beside it, so that an append need not read the cube.

A commit says how many rows of which day and which new cells a batch has added. It
is written after the batch's data; an intent, which names the years, before. A
batch with an intent but no commit was cut off, and only its years are counted
again from the cube. Readers of the cube do not see the folder: its name begins
with an underscore.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "_manifest"
_PARTS = {"commits": "dt date, n long, batch string", "cells": "lat double, lon double, batch string", "intents": "year int, batch string"}


class Manifest:
    def __init__(self, spark: SparkSession, cube_path: str):
        self.spark, self.cube_path = spark, cube_path.rstrip("/")

    def _read(self, part: str) -> DataFrame:
        try:
            return self.spark.read.schema(_PARTS[part]).parquet(f"{self.cube_path}/{FOLDER}/{part}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _PARTS[part])

    def _write(self, part: str, rows: DataFrame, batch: str) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.cube_path}/{FOLDER}/{part}/batch={batch}")

    def days(self) -> DataFrame:
        """``dt, n``: rows of every day."""
        return self._read("commits").where(F.col("dt").isNotNull()).groupBy("dt").agg(F.sum("n").alias("n"))

    def cells(self) -> DataFrame:
        return self._read("cells").select("lat", "lon").distinct()

    def is_committed(self, batch: str) -> bool:
        return not self._read("commits").where(F.col("batch") == batch).isEmpty()

    def intend(self, batch: str, years: list[int]) -> None:
        self._write("intents", self.spark.createDataFrame([(y,) for y in years], "year int"), batch)

    def commit(self, batch: str, added: DataFrame) -> None:
        """Record the rows ``added`` (``dt, lat, lon``) by a batch, days last. One row per day and per new cell is written."""
        self._write("cells", added.select("lat", "lon").distinct().join(self.cells(), ["lat", "lon"], "left_anti"), batch)
        mark = self.spark.createDataFrame([(None, 0)], "dt date, n long")  # also a batch that adds nothing is done
        self._write("commits", mark.unionByName(added.groupBy("dt").agg(F.count(F.lit(1)).alias("n"))), batch)

    def recover(self, cube: DataFrame) -> None:
        """Count batches again that were cut off between data and commit, or a cube that has no manifest yet."""
        commits = self._read("commits")
        if commits.isEmpty():
            self.commit("base", cube.select("dt", "lat", "lon"))
            return
        open_ones = self._read("intents").join(commits.select("batch").distinct(), "batch", "left_anti").collect()
        for batch in sorted({r["batch"] for r in open_ones}):
            there = cube.where(F.col("year").isin([r["year"] for r in open_ones if r["batch"] == batch])).select("dt", "lat", "lon")
            known = self.days().withColumnRenamed("n", "known")
            found = there.groupBy("dt").agg(F.count(F.lit(1)).alias("n")).join(known, "dt", "left").select(
                "dt", (F.col("n") - F.coalesce("known", F.lit(0))).alias("n")).where("n <> 0")
            # Under a name of its own: the batch itself is not done and may come again.
            name = f"recovered-{uuid.uuid4().hex}"
            self._write("cells", there.select("lat", "lon").distinct().join(self.cells(), ["lat", "lon"], "left_anti"), name)
            self._write("commits", found, name)
            self._write("intents", self.spark.createDataFrame([], "year int"), batch)
