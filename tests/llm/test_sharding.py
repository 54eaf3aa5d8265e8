import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from gridextremes.llm import sharding
from gridextremes.session import new_path


def rows(n=400):
    return [(i, None if i % 50 == 0 else f"text {i} " * (i % 37 + 1)) for i in range(n)] + [(7, "text 7 " * 8), (None, "x"), (None, None)]


def place(spark, docs, **kw):
    return sharding.sharded(docs, kw.pop("store", None) or new_path(spark, "shards"), **kw)


def test_sizes_places_and_balance(spark, documents):
    given = rows()
    out = place(spark, documents(given)).select("row.doc_id", "row.text", "size", "crc", "shard", "place").collect()
    assert len(out) == len(given)
    loads, places = Counter(), defaultdict(list)
    for r in out:
        text = (r["text"] or "").encode()
        assert r["size"] == len(text) + 1 and r["crc"] == zlib.crc32(text)
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["place"])
    assert max(loads.values()) - min(loads.values()) <= max(r["size"] for r in out)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) == set(range(8))


def test_rebalancing_moves_few(spark, documents):
    docs, store = documents(rows()), new_path(spark, "shards")
    first = place(spark, docs, store=store)
    before = sharding.read_map(spark, store, 1)
    again = place(spark, docs, store=store, version=2)
    assert sharding.read_map(spark, store, 2) == before
    grown = place(spark, docs, store=store, version=3, shards=9)
    after = sharding.read_map(spark, store, 3)
    size = Counter()
    for r in grown.select("vslot", "size").collect():
        size[r["vslot"]] += r["size"]
    moved = [s for s, (a, b) in enumerate(zip(before, after)) if a != b]
    share = sum(size.values()) / 9
    assert 0.7 * share < sum(size[s] for s in moved) < 1.4 * share
    assert sum(size[s] for s in moved if after[s] == 8) > 0.7 * sum(size[s] for s in moved)
    loads = Counter()
    for r in grown.select("shard", "size").collect():
        loads[r["shard"]] += r["size"]
    mean = sum(loads.values()) / 9
    assert len(loads) == 9 and max(loads.values()) < 1.25 * mean
    shrunk = sharding.edited_map(after, {s: 1 for s in range(len(after))}, 8)
    assert max(shrunk) == 7
    assert first.count() == again.count()


def test_slots_do_not_depend_on_shards(spark, documents):
    docs = documents(rows())
    a = place(spark, docs, shards=8).select("row.doc_id", "vslot").collect()
    b = place(spark, docs, shards=3).select("row.doc_id", "vslot").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_empty_clashes_and_plan(spark, documents):
    assert place(spark, documents([]).where("false")).count() == 0
    clash = documents(rows()).withColumns({c: F.lit(1) for c in ("row", "size", "crc", "vslot", "shard", "place", "before", "inside")})
    df = place(spark, clash)
    assert df.count() == len(rows())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute(given, shards=8, slots=4096):
    """Slot, shard and place of every row in plain code."""
    def slot(doc, text):
        seed = 42
        for part in (None if doc is None else struct.pack("<q", doc), None if text is None else text.encode()):
            seed = seed if part is None else xxhash.xxh64_intdigest(part, seed=seed)
        return seed % slots

    rows = [(slot(d, t), d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in given]
    weights = Counter()
    for r in rows:
        weights[r[0]] += r[4]
    loads, shard_of = [0] * shards, {}
    for s in sorted(range(slots), key=lambda s: (-weights[s], s)):
        shard_of[s] = loads.index(min(loads))
        loads[shard_of[s]] += weights[s]
    places, out = Counter(), []
    for s, _, doc, crc, size in sorted(rows, key=lambda r: (shard_of[r[0]], *r)):
        out.append((s, size, crc, shard_of[s], places[shard_of[s]]))
        places[shard_of[s]] += 1
    return sorted(out)


def test_slots_map_and_places_against_plain_code(spark, documents):
    given = rows() + [(i, "x" * (i * 977 % 5000)) for i in range(1000, 1400)] + [(5000, "long " * 300_000)]
    found = place(spark, documents(given, 5)).select("vslot", "size", "crc", "shard", "place").collect()
    assert sorted(map(tuple, found)) == brute(given)
