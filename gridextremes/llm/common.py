"""What several operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = (" ", "\t", "\n", "\x0b", "\f", "\r")  # fixed values: [\x20\x09-\x0D]
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, row: str = "row") -> Column:
    """All columns of ``docs`` in one struct, so that no helper column can clash with them."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(row)


def without_white(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def summed_arrays(rows: DataFrame, kind: str, unpack: Callable[[bytes], np.ndarray] | None = None,
                  pack: Callable[[np.ndarray], bytes] | None = None) -> dict[int, np.ndarray] | dict[int, bytes]:
    """Sum of the arrays (``counts``, packed as ``kind`` unless ``unpack`` reads them) of each ``block``.

    The blocks are dealt to tasks that add up one row after the other, so a task
    holds one array per block of its own. The sums go to the driver, as the bytes
    that ``pack`` makes of them if it is given: the caller bounds their number and size.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                more = unpack(counts.as_py()) if unpack else np.frombuffer(counts.as_buffer(), kind)
                sums[block] = sums[block] + more if block in sums else more.copy()
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([pack(c) if pack else c.tobytes() for c in sums.values()], pa.binary())],
                ["block", "counts"],
            )

    found = rows.repartition("block").mapInArrow(add, "block int, counts binary").collect()
    return {r["block"]: bytes(r["counts"]) if pack else np.frombuffer(r["counts"], kind) for r in found}
