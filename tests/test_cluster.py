import numpy as np
from helpers import clusters_by_brute_force, day
from pyspark.sql import functions as F

from gridextremes.operators import components
from gridextremes.operators.cluster import by_severity, cluster_events
from gridextremes.operators.components import connected_components
from gridextremes.operators.numbering import number_by_cell, number_by_key
from gridextremes.session import materialise

SCHEMA = (
    "event_id string, event_seq long, date_start date, date_end date, date_peak date, duration_days int, "
    "intensity_max double, intensity_mean double, intensity_cumulative double, category int, category_name string, "
    "centroid_lon double, centroid_lat double, bbox struct<x0:double,y0:double,x1:double,y1:double>, "
    "n_pixels int, geom_type string, ilat int, ilon int"
)


def event(seq, lon, lat, a, b, peak=1.0, category=1, step=0.25):
    h, lon, lat = step / 2, float(lon), float(lat)
    return (
        f"mhw-{seq:06d}", seq, day(a), day(b), day(a), b - a + 1, peak, peak / 2, peak * 3, category, "x",
        lon, lat, (lon - h, lat - h, lon + h, lat + h), 1, "Polygon", round(lat / step), round(lon / step),
    )


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def groups(clusters):
    out = {}
    for r in clusters.members.collect():
        out.setdefault(r["cluster_id"], set()).add(r["event_seq"])
    return out


def test_near_and_overlapping(spark):
    got = cluster_events(frame(spark, [event(1, 10, 40, 0, 9, 2.0), event(2, 10.5, 40, 5, 14, 3.0)]))
    c = got.events.collect()
    assert len(c) == 1 and c[0]["n_pixels"] == 2 and c[0]["geom_type"] == "Polygon"
    assert (c[0]["date_start"], c[0]["date_end"], c[0]["duration_days"]) == (day(0), day(14), 10)
    assert c[0]["intensity_max"] == 3.0 and c[0]["date_peak"] == day(5)
    assert (c[0]["centroid_lon"], c[0]["centroid_lat"]) == (10.25, 40.0)


def test_far_or_disjoint_stay_apart(spark):
    got = cluster_events(frame(spark, [event(1, 10, 40, 0, 9), event(2, 20, 40, 0, 9), event(3, 10, 40, 20, 29)]))
    assert len(groups(got)) == 3
    assert {r["geom_type"] for r in got.events.collect()} == {"Point"}


def test_distance_is_strict_and_dates_are_closed(spark):
    assert len(groups(cluster_events(frame(spark, [event(1, 10, 40, 0, 9), event(2, 11.5, 40, 0, 9)])))) == 2
    assert len(groups(cluster_events(frame(spark, [event(1, 10, 40, 0, 9), event(2, 11.4375, 40, 9, 15)])))) == 1
    assert len(groups(cluster_events(frame(spark, [event(1, 10, 40, 0, 9), event(2, 11, 40, 10, 15)])))) == 2


def test_block_and_chain(spark):
    block = [event(1 + 3 * a + b, 10 + a * 0.25, 40 + b * 0.25, 0, 9) for a in range(3) for b in range(3)]
    got = cluster_events(frame(spark, block))
    assert got.events.first()["n_pixels"] == 9 and got.footprint.count() == 9
    chain = [event(i + 1, 10 + i * 1.25, 40, i * 3, i * 3 + 5) for i in range(30)]
    assert len(groups(cluster_events(frame(spark, chain)))) == 1


def test_equal_peaks_take_the_first_member(spark):
    got = cluster_events(frame(spark, [event(2, 10, 40, 4, 9, 2.0), event(1, 10.25, 40, 0, 8, 2.0)]))
    assert got.events.first()["date_peak"] == day(0)


def test_random_events_against_brute_force(spark):
    rng = np.random.default_rng(11)
    for step, n, span in ((0.25, 400, 12.0), (0.0625, 300, 6.0), (0.75, 300, 15.0)):
        rows = []
        for i in range(n):
            lon, lat = (round(float(v), 4) for v in rng.integers(0, int(span / step), 2) * step - span / 2)
            a = int(rng.integers(0, 300))
            rows.append(event(i + 1, lon, lat, a, a + int(rng.integers(4, 30)), step=step))
        want = clusters_by_brute_force([(r[1], r[11], r[12], r[2], r[3]) for r in rows])
        got = groups(cluster_events(frame(spark, rows)))
        assert {frozenset(g) for g in got.values()} == want
        first = [min(got[k]) for k in sorted(got)]
        assert first == sorted(first)


def test_many_events_in_one_place(spark):
    rows = [event(i + 1, 10, 40, i % 50 * 20, i % 50 * 20 + 9) for i in range(1000)]
    assert sorted(len(g) for g in groups(cluster_events(frame(spark, rows))).values()) == [20] * 50


def test_order_of_clusters(spark):
    rows = [event(1, 10, 40, 0, 9), event(2, 20, 40, 5, 9, category=3), event(3, 30, 40, 1, 9), event(4, 30.25, 40, 1, 9)]
    got = [(r["category"], r["n_pixels"], r["date_start"]) for r in by_severity(cluster_events(frame(spark, rows)).events).collect()]
    assert got == [(3, 1, day(5)), (1, 2, day(1)), (1, 1, day(0))]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)] + [(500, i) for i in range(501, 560)]
    nodes = sorted({v for e in edges for v in e} | {999})
    got = connected_components(
        spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(v,) for v in nodes], "node long"))
    label = {r["node"]: r["component"] for r in got.collect()}
    assert label == {v: 0 if v <= 40 else 100 if v <= 102 else 500 if v < 900 else 999 for v in nodes}


def test_rounds_grow_with_the_logarithm_of_a_path(spark, monkeypatch):
    """A path whose numbers rise along it is the slowest for steps of a fixed length."""
    written = []
    monkeypatch.setattr(components, "materialise", lambda df, label: written.append(label) or materialise(df, label))
    for n in (60, 600):
        written.clear()
        path = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        found = connected_components(path, spark.range(n + 1).withColumnRenamed("id", "node"))
        assert found.where("component = 0").count() == n + 1 and len(written) < 12


def test_numbering(spark):
    keys = spark.createDataFrame([(int(k),) for k in np.random.default_rng(0).permutation(500) * 7], "k long")
    got = {r["k"]: r["n"] for r in number_by_key(keys, "k", "n", block=100).collect()}
    assert got == {k * 7: k + 1 for k in range(500)}
    cells = spark.createDataFrame([(a, b, n) for a in (2, 0, 5) for b in (1, 0) for n in (1, 2)], "a int, b int, n int")
    rows = sorted((r["seq"], r["a"], r["b"], r["n"]) for r in number_by_cell(cells, "a", "b", "n", "seq").collect())
    assert [r[0] for r in rows] == list(range(1, 13)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


def stages(spark):
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    found = spark.sparkContext._jsc.sc().statusStore().stageList(
        jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [found.apply(k) for k in range(found.size())]


def rows_read(spark, after):
    """Per stage later than ``after`` that reads shuffled rows: those of its largest task and of all its tasks."""
    store, out = spark.sparkContext._jsc.sc().statusStore(), []
    for stage in stages(spark):
        if stage.stageId() > after and stage.numCompleteTasks():
            tasks = store.taskList(stage.stageId(), stage.attemptId(), 10_000)
            metrics = [tasks.apply(i).taskMetrics() for i in range(tasks.size())]
            read = [m.get().shuffleReadMetrics().recordsRead() for m in metrics if m.isDefined()]
            if sum(read):
                out.append((max(read), sum(read)))
    return out


def test_a_star_of_a_million_leaves(spark):
    """Every leaf asks for the hub; no task gets them all."""
    n = 1_000_000
    leaves = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(2 * n, 2 * n + 20).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    nodes = spark.range(0, n + 1).union(spark.range(2 * n, 2 * n + 21)).withColumnRenamed("id", "node")
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    after = max([s.stageId() for s in stages(spark)], default=-1)
    try:
        found = connected_components(leaves.union(chain), nodes, hot_rows=25_000)
        got = {r["component"]: r["count"] for r in found.groupBy("component").count().collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == {0: n + 1, 2 * n: 21}
    large = [most / total for most, total in rows_read(spark, after) if total > n / 2]
    assert len(large) > 5 and max(large) < 0.25  # of 16 tasks
