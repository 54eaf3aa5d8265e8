"""Small per-event helpers: closing outline segments to rings, and WKB bytes."""

from __future__ import annotations

import struct
from collections import defaultdict

Vertex = tuple[int, int]


def trace_rings(segments: list[tuple[int, int, int, int]]) -> list[list[Vertex]]:
    """Closed rings from directed segments that have the inside on their left.

    Where two rings touch in a corner the path turns left and so stays with its
    cell; a ring that still passes a corner twice is split there.
    """
    leaving = defaultdict(list)
    for x0, y0, x1, y1 in segments:
        leaving[x0, y0].append((x1, y1))
    rings = []
    for start in sorted(leaving):
        while leaving[start]:
            path, here = [start], leaving[start].pop()
            while here != start:
                before, ways = path[-1], leaving[here]
                path.append(here)
                heading = (here[0] - before[0], here[1] - before[1])
                ways.sort(key=lambda to: heading[0] * (to[1] - here[1]) - heading[1] * (to[0] - here[0]))
                here = ways.pop()
            rings.extend(_simple_loops(path))
    return rings


def _simple_loops(path: list[Vertex]) -> list[list[Vertex]]:
    loops, stack, place = [], [], {}
    for v in path:
        if v in place:
            at = place[v]
            loops.append(stack[at:])
            for gone in stack[at + 1:]:
                del place[gone]
            del stack[at + 1:]
        else:
            place[v] = len(stack)
            stack.append(v)
    loops.append(stack)
    return loops


def double_area(ring: list[Vertex]) -> int:
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]))


def _holds(ring: list[Vertex], x: float, y: float) -> bool:
    inside = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        if (y0 > y) != (y1 > y) and x < x0:  # outlines only have upright and level edges
            inside = not inside
    return inside


def _from_first(ring: list[Vertex]) -> list[Vertex]:
    """The ring from its smallest corner on."""
    at = ring.index(min(ring))
    return ring[at:] + ring[:at]


def assemble_polygons(segments: list[tuple[int, int, int, int]]) -> list[list[list[Vertex]]]:
    """Polygons as lists of rings, the outer ring first; rings are not closed.

    A ring begins at its smallest corner (x, then y); polygons, and the holes of
    each, are in the order of these corners.
    """
    rings = [_from_first(r) for r in trace_rings(segments)]
    outer = sorted((r for r in rings if double_area(r) > 0), key=double_area)
    polygons = [[r] for r in outer]
    for hole in sorted(r for r in rings if double_area(r) < 0):
        # A point just right of the hole's leftmost edge, inside the hole.
        (x0, y0), (_, y1) = min(
            zip(hole, hole[1:] + hole[:1]), key=lambda e: (e[0][0] + e[1][0], e[0][1])
        )
        x, y = x0 + 0.25, (y0 + y1) / 2
        next(p for p in polygons if _holds(p[0], x, y)).append(hole)
    return sorted(polygons)


def point_wkb(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)


def polygons_wkb(polygons) -> bytes:
    """Polygon, or MultiPolygon for several; rings are closed sequences of (x, y)."""
    bodies = []
    for rings in polygons:
        body = struct.pack("<BII", 1, 3, len(rings))
        for ring in rings:
            body += struct.pack("<I", len(ring))
            body += b"".join(struct.pack("<dd", p["x"], p["y"]) for p in ring)
        bodies.append(body)
    if len(bodies) == 1:
        return bodies[0]
    return struct.pack("<BII", 1, 6, len(bodies)) + b"".join(bodies)
