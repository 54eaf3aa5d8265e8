"""Small inputs, and plain single-series code to check the Spark operators against."""

from datetime import date, timedelta

import numpy as np

from gridextremes.schemas import CUBE

START = date(2022, 6, 1)


def day(i, start=START):
    return start + timedelta(days=i)


def cube_of(spark, series, start=START):
    """``series``: {(lat, lon): list of values or None}."""
    rows = [
        (day(i, start), float(lat), float(lon), None if v is None else float(v), "nrt")
        for (lat, lon), values in series.items() for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, CUBE)


def flat_clim(spark, cells, seas=20.0, thresh=23.0):
    rows = [(float(a), float(b), d, seas, thresh) for a, b in cells for d in range(1, 367)]
    return spark.createDataFrame(rows, "lat double, lon double, doy int, seas double, thresh double")


def spike(n, *blocks, base=20.0, high=25.0):
    values = [base] * n
    for lo, hi in blocks:
        values[lo:hi + 1] = [high] * (hi - lo + 1)
    return values


def events_of_series(days, sst, seas, thresh, min_duration=5, max_gap=2):
    """Events of one series as (start, end, peak, rows, max, mean, sum)."""
    hot = [s is not None and t is not None and s > t for s, t in zip(sst, thresh)]
    runs, at = [], None
    for i, h in enumerate([*hot, False]):
        if h and at is None:
            at = i
        elif not h and at is not None:
            runs.append((at, i - 1))
            at = None
    joined = []
    for a, b in (r for r in runs if r[1] - r[0] + 1 >= min_duration):
        if joined and (days[a] - days[joined[-1][1]]).days - 1 <= max_gap:
            joined[-1] = (joined[-1][0], b)
        else:
            joined.append((a, b))
    out = []
    for a, b in joined:
        rel = [sst[i] - seas[i] if sst[i] is not None else np.nan for i in range(a, b + 1)]
        peak = int(np.nanargmax(rel))
        out.append((
            days[a], days[b], days[a + peak], b - a + 1,
            round(float(np.nanmax(rel)), 6), round(float(np.nanmean(rel)), 6), round(float(np.nansum(rel)), 6),
        ))
    return out


def clusters_by_brute_force(events, distance=1.5):
    """Sets of event numbers; ``events``: (seq, lon, lat, start, end)."""
    parent = {e[0]: e[0] for e in events}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(events):
        for b in events[i + 1:]:
            near = ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 < distance
            if near and a[3] <= b[4] and b[3] <= a[4]:
                parent[root(a[0])] = root(b[0])
    groups = {}
    for e in events:
        groups.setdefault(root(e[0]), set()).add(e[0])
    return {frozenset(g) for g in groups.values()}
