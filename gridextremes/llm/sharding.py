"""Sharding over fixed virtual slots and a versioned slot-to-shard map.

Only Spark's own column functions touch the records. The map has one row per
slot, a fixed number, and is edited on the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import packed

SLOTS = 4096
MAP_SCHEMA = "version int, slot int, shard int"


def slot_of(key: Column, text: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record: fixed for ever, whatever the number of shards."""
    return F.pmod(F.xxhash64(key, text), F.lit(slots)).cast("int")


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``row``, ``size`` (UTF-8 bytes plus 1), ``crc`` and ``vslot`` of each record."""
    text = F.col(f"row.`{text_col}`")
    return docs.select(packed(docs)).select(
        "row", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        slot_of(F.col(f"row.`{id_col}`"), text, slots).alias("vslot"),
    )


def slot_bytes(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per virtual slot, combined map-side; at most as many rows as slots."""
    found = records.groupBy("vslot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return {r["vslot"]: (r["size"], r["n"]) for r in found}


def new_map(weights: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """Shard of each slot: heaviest slot first, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    shard_of = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-weights.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), shard))
    return shard_of


def edited_map(shard_of: list[int], weights: dict[int, int], shards: int, slack: float = 0.01) -> list[int]:
    """The map moved towards ``shards`` shards of equal bytes by moving as few bytes as needed.

    Slots only leave shards above the mean (by more than ``slack``) or shards that
    no longer exist, and only go to the lightest shard; all others stay.
    """
    edited = list(shard_of)
    loads = [0] * shards
    homeless = []
    members: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(edited):
        if shard < shards:
            loads[shard] += weights.get(slot, 0)
            members[shard].append(slot)
        else:
            homeless.append(slot)
    mean = sum(weights.values()) / shards
    for shard in range(shards):
        for slot in sorted(members[shard], key=lambda s: (-weights.get(s, 0), s)):
            size = weights.get(slot, 0)
            if size and loads[shard] - size >= mean * (1 - slack) and loads[shard] > mean * (1 + slack):
                loads[shard] -= size
                homeless.append(slot)
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda s: (-weights.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        edited[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), shard))
    return edited


def write_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """Add a version of the map beside the earlier ones; a version is written once."""
    rows = [(version, slot, shard) for slot, shard in enumerate(shard_of)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("error").parquet(f"{path}/map-{version}")


def read_map(spark: SparkSession, path: str, version: int) -> list[int]:
    rows = spark.read.schema(MAP_SCHEMA).parquet(f"{path}/map-{version}").orderBy("slot").collect()
    return [r["shard"] for r in rows]


def placed(records: DataFrame, shard_of: list[int], stats: dict[int, tuple[int, int]],
           order: tuple[str, ...] = ()) -> DataFrame:
    """``records`` with ``shard`` and ``place``, gapless from 0 in each shard.

    A shard lists its slots in turn: the rows before a slot come from the counts
    per slot, the place inside from a window over that slot alone, so no task sees
    a whole shard. The map that is broadcast has one row per slot.
    """
    before: dict[int, int] = {}
    rows = []
    for slot, shard in enumerate(shard_of):
        rows.append((slot, shard, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + stats.get(slot, (0, 0))[1]
    spark = records.sparkSession
    slots = spark.createDataFrame(rows, "vslot int, shard int, before long")
    inside = W.partitionBy("vslot").orderBy(*order, "crc", "size")
    return records.withColumn("inside", F.row_number().over(inside)).join(F.broadcast(slots), "vslot").withColumn(
        "place", F.col("before") + F.col("inside") - 1
    ).drop("before", "inside")


def sharded(docs: DataFrame, store: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 8,
            slots: int = SLOTS, version: int = 1) -> DataFrame:
    """``row``, ``size``, ``crc``, ``vslot``, ``shard`` and ``place`` of every record; sizes per shard near equal.

    Version ``version`` of the map is written to ``store``; with an earlier
    version there, that one is edited, so only the slots that must move do.

    Null text has size 1 and the checksum of the empty text; a null id hashes like
    any other value; rows that repeat entirely share a slot and get places of
    their own; an empty table gives an empty result (and an even map); extra
    columns of any name stay inside ``row``. A single record, or rows repeated
    entirely, cannot be parted: beyond an even share they set the largest shard.
    """
    spark = docs.sparkSession
    records = with_slots(docs, id_col, text_col, slots)
    stats = slot_bytes(records)
    weights = {slot: size for slot, (size, _) in stats.items()}
    if version > 1:
        shard_of = edited_map(read_map(spark, store, version - 1), weights, shards)
    else:
        shard_of = new_map(weights, shards, slots)
    write_map(spark, store, version, shard_of)
    return placed(records, read_map(spark, store, version), stats, (f"row.`{id_col}`",))
