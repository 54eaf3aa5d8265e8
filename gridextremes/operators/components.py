"""Connected components of a graph given as two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .skew import HOT_ROWS, hot_join, keyed_join


def connected_components(edges: DataFrame, nodes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(node, component)``; ``edges`` has ``a, b``, ``nodes`` has ``node``.

    Each round lets every node point at its smallest neighbour, follows the
    pointers to their ends, and contracts the edges onto these. The smallest
    node of a component is its label. Following doubles its reach each time, so
    a path takes as many steps as the logarithm of its length. An end that no
    node points at has an edge to a smaller end in the next round, so two rounds
    at least halve the nodes that still have an edge. The minimum per node is
    combined map-side; every round, and every few steps of it, end in a written
    table, so the lineage stays short.

    All joins look up one row per node, but many rows may ask for the same one: the
    leaves of a hub point at it, and so do the nodes of a finished component. A
    key with more than ``hot_rows`` rows is dealt over salts (see ``hot_join``); a
    table with no more rows than that cannot have one and is joined plainly.
    """

    def look_up(asking: DataFrame, answers: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
        if rows <= hot_rows:
            return keyed_join(asking, answers, key, how)
        # Counting keys reads the table again, so a chain of look-ups is cut by a written copy each.
        return materialise(hot_join(asking, answers, [key], how, hot_rows), "looked_up")

    def doubled(up: DataFrame, rows: int, moved: str | None = None) -> DataFrame:
        """Every pointer replaced by the pointer of its target; ``moved`` tells if that is another one."""
        target = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
        return look_up(up, target, "up", rows, "left").select(
            "node", F.coalesce("far", "up").alias("up"), *([(F.col("far") != F.col("up")).alias(moved)] if moved else []))

    live = materialise(
        edges.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    hops: list[DataFrame] = []
    while n_edges := live.count():
        both = live.select(F.explode(F.array(
            F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
            F.struct(F.col("b").alias("node"), F.col("a").alias("other")),
        )).alias("e")).select("e.*")
        up = both.groupBy("node").agg(F.min("other").alias("low")).select(
            "node", F.least("node", "low").alias("up")
        )
        hop = materialise(up, "up")
        while True:
            # A pointer that the second step leaves alone leads to an end.
            near = doubled(hop, 2 * n_edges)
            hop = materialise(doubled(near, 2 * n_edges, "moved"), "hop")
            if hop.where("moved").isEmpty():
                break
            hop = hop.drop("moved")
        hop = hop.drop("moved")
        hops.append(hop)
        one_end = look_up(live, hop.withColumnsRenamed({"node": "a", "up": "ua"}), "a", n_edges)
        ends = look_up(one_end, hop.withColumnsRenamed({"node": "b", "up": "ub"}), "b", n_edges)
        live = materialise(
            ends.where(F.col("ua") != F.col("ub"))
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
            .distinct(),
            "edges",
        )
    found = nodes.select("node", F.col("node").alias("component"))
    n_nodes = nodes.count() if len(hops) > 1 else 0
    for k, hop in enumerate(hops):
        step = hop.withColumnsRenamed({"node": "component", "up": "next"})
        # Before the first step every node is its own component.
        found = look_up(found, step, "component", n_nodes if k else 0, "left").select(
            "node", F.coalesce("next", "component").alias("component")
        )
        if k % 4 == 3:
            found = materialise(found, "components")
    return found
