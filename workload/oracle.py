"""SQL for DuckDB that gives the same results, written independently of the Spark code."""

from __future__ import annotations

CELLS = """
dims AS (SELECT CAST(ceil(sqrt(max(s_suppkey) + 1)) AS BIGINT) AS w FROM supplier),
cells AS (
  SELECT k, r, c, 34e0 + step * r AS lat, 4e0 + step * c AS lon, step
  FROM (SELECT s_suppkey AS k, s_suppkey // w AS r, s_suppkey % w AS c,
               0.75e0 / pow(2e0, greatest(0e0, ceil(log2(w * 0.75e0 / 36e0)))) AS step
        FROM supplier, dims)
),
days AS (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS dt
  FROM (SELECT min(date_trunc('day', l_shipdate)) AS lo, max(date_trunc('day', l_shipdate)) AS hi
        FROM lineitem)
)"""

CUBE = CELLS + """,
obs AS (
  SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS dt, sum(l_quantity) AS s, count(*) AS n
  FROM lineitem GROUP BY 1, 2
),
trail AS (
  SELECT c.k, c.lat, c.lon, d.dt,
         sum(coalesce(o.s, 0e0)) OVER t AS sw, sum(coalesce(o.n, 0)) OVER t AS nw
  FROM cells c CROSS JOIN days d LEFT JOIN obs o ON o.k = c.k AND o.dt = d.dt
  WINDOW t AS (PARTITION BY c.k ORDER BY d.dt ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)
),
cube AS (
  SELECT dt, lat, lon, dayofyear(dt) AS doy,
         CASE WHEN nw = 0 OR (date_diff('day', DATE '1995-01-01', dt) + k) % 97 = 0 THEN NULL
              ELSE 15e0 + 10e0 * (1e0 - abs(dayofyear(dt) - 213) / 213e0)
                   + 0.1e0 * (sw / nw - 25.5e0) END AS sst
  FROM trail
)"""

POOLED = CUBE + """,
pool AS (
  SELECT lat, lon, CAST((doy - 1 + o + 366) % 366 + 1 AS INTEGER) AS doy,
         avg(sst) AS seas, quantile_cont(sst, 0.9) AS thresh
  FROM cube, (SELECT unnest(generate_series(-5, 5)) AS o)
  WHERE sst IS NOT NULL
  GROUP BY 1, 2, 3
),
pooled AS (
  SELECT c.lat, c.lon, CAST(d AS INTEGER) AS doy, seas, thresh
  FROM cells c CROSS JOIN (SELECT unnest(generate_series(1, 366)) AS d)
  LEFT JOIN pool p ON p.lat = c.lat AND p.lon = c.lon AND p.doy = d
)"""

CLIM = POOLED + """,
clim AS (
  SELECT lat, lon, doy, round(avg(seas), 6) AS seas, round(avg(thresh), 6) AS thresh
  FROM (SELECT lat, lon, CAST((doy - 1 + o + 366) % 366 + 1 AS INTEGER) AS doy, seas, thresh
        FROM pooled, (SELECT unnest(generate_series(-15, 15)) AS o))
  GROUP BY 1, 2, 3
)"""


def detection(cube: str = "cube", prefix: str = "") -> str:
    """Events of a cube, as ``{prefix}events``."""
    p = prefix
    return f""",
{p}series AS (
  SELECT c.lat, c.lon, c.dt, c.sst, m.seas, m.thresh, c.sst - m.seas AS rel,
         coalesce(c.sst > m.thresh, FALSE) AS hot,
         row_number() OVER (PARTITION BY c.lat, c.lon ORDER BY c.dt) AS pos
  FROM {cube} c JOIN clim m ON m.lat = c.lat AND m.lon = c.lon AND m.doy = dayofyear(c.dt)
),
{p}runs AS (
  SELECT lat, lon, min(pos) AS p0, max(pos) AS p1, min(dt) AS d0, max(dt) AS d1
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY lat, lon ORDER BY dt) AS island
        FROM {p}series WHERE hot)
  GROUP BY lat, lon, island HAVING count(*) >= 5
),
{p}joined AS (
  SELECT lat, lon, event_no, min(p0) AS p0, max(p1) AS p1
  FROM (SELECT *, sum(CASE WHEN gap BETWEEN 0 AND 2 THEN 0 ELSE 1 END)
                  OVER (PARTITION BY lat, lon ORDER BY p0) AS event_no
        FROM (SELECT *, date_diff('day', lag(d1) OVER (PARTITION BY lat, lon ORDER BY p0), d0) - 1 AS gap
              FROM {p}runs))
  GROUP BY lat, lon, event_no
),
{p}stats AS (
  SELECT j.lat, j.lon, j.event_no, min(s.dt) AS date_start, max(s.dt) AS date_end,
         CAST(count(*) AS INTEGER) AS duration_days, max(rel) AS i_max, avg(rel) AS i_mean, sum(rel) AS i_cum
  FROM {p}joined j JOIN {p}series s
    ON s.lat = j.lat AND s.lon = j.lon AND s.pos BETWEEN j.p0 AND j.p1
  GROUP BY 1, 2, 3
),
{p}peaks AS (
  SELECT t.lat, t.lon, t.event_no, s.dt AS date_peak, s.seas, s.thresh
  FROM {p}stats t JOIN {p}series s
    ON s.lat = t.lat AND s.lon = t.lon AND s.dt BETWEEN t.date_start AND t.date_end AND s.rel = t.i_max
  QUALIFY row_number() OVER (PARTITION BY t.lat, t.lon, t.event_no ORDER BY s.dt) = 1
),
{p}graded AS (
  SELECT t.*, p.date_peak,
         CAST(CASE WHEN thresh <= seas THEN 1
                   WHEN thresh IS NOT NULL THEN least(5, greatest(1, floor((seas + i_max - seas) / (thresh - seas)))) END AS INTEGER) AS category
  FROM {p}stats t JOIN {p}peaks p USING (lat, lon, event_no)
),
{p}events AS (
  SELECT row_number() OVER (ORDER BY lat, lon, date_start) AS event_seq,
         printf('mhw-%06d', row_number() OVER (ORDER BY lat, lon, date_start)) AS event_id,
         date_start, date_end, date_peak, duration_days,
         round(i_max, 3) AS intensity_max, round(i_mean, 3) AS intensity_mean,
         round(i_cum, 3) AS intensity_cumulative, category,
         ['I Moderate', 'II Strong', 'III Severe', 'IV Extreme', 'V Super-Extreme'][category] AS category_name,
         round(lon, 4) AS centroid_lon, round(lat, 4) AS centroid_lat, lat, lon
  FROM {p}graded
)"""


def clustering(events: str = "events", prefix: str = "") -> str:
    """Clusters of events, as ``{prefix}members`` and ``{prefix}clusters``."""
    p = prefix
    return f""",
{p}near AS (
  SELECT a.event_seq AS a, b.event_seq AS b
  FROM {events} a JOIN {events} b
    ON a.date_start <= b.date_end AND b.date_start <= a.date_end
   AND sqrt((a.centroid_lon - b.centroid_lon) * (a.centroid_lon - b.centroid_lon)
          + (a.centroid_lat - b.centroid_lat) * (a.centroid_lat - b.centroid_lat)) < 1.5e0
),
{p}reach AS (
  SELECT event_seq AS a, event_seq AS b FROM {events}
  UNION
  SELECT r.a, n.b FROM {p}reach r JOIN {p}near n ON n.a = r.b
),
{p}members AS (
  SELECT e.*, first_seq FROM {events} e
  JOIN (SELECT a, min(b) AS first_seq FROM {p}reach GROUP BY a) ON a = e.event_seq
),
{p}halves AS (SELECT min(step) / 2 AS h FROM cells),
{p}rolled AS (
  SELECT first_seq, min(date_start) AS date_start, max(date_end) AS date_end,
         max(duration_days) AS duration_days, max(intensity_max) AS intensity_max,
         max(intensity_mean) AS intensity_mean, max(intensity_cumulative) AS intensity_cumulative,
         max(category) AS category, CAST(count(*) AS INTEGER) AS n_pixels,
         min(lon - h) AS x0, min(lat - h) AS y0, max(lon + h) AS x1, max(lat + h) AS y1
  FROM {p}members, {p}halves GROUP BY first_seq
),
{p}anchors AS (
  SELECT first_seq, date_peak FROM {p}members
  QUALIFY row_number() OVER (PARTITION BY first_seq ORDER BY intensity_max DESC, event_seq) = 1
),
{p}clusters AS (
  SELECT row_number() OVER (ORDER BY r.first_seq) AS event_seq,
         printf('mhw-cluster-%04d', row_number() OVER (ORDER BY r.first_seq)) AS event_id,
         r.first_seq, date_start, date_end, a.date_peak, duration_days, intensity_max, intensity_mean,
         intensity_cumulative, category,
         ['I Moderate', 'II Strong', 'III Severe', 'IV Extreme', 'V Super-Extreme'][category] AS category_name,
         round((x0 + x1) / 2, 4) AS centroid_lon, round((y0 + y1) / 2, 4) AS centroid_lat,
         x0, y0, x1, y1, n_pixels, CASE WHEN n_pixels = 1 THEN 'Point' ELSE 'Polygon' END AS geom_type
  FROM {p}rolled r JOIN {p}anchors a ON a.first_seq = r.first_seq
)"""


EVENTS = CLIM + detection()
CLUSTERS = EVENTS + clustering()


def sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select.strip()}"

# --- places ------------------------------------------------------------------------

PLACES = """,
side AS (SELECT any_value(w) * min(step) / 0.75e0 AS m FROM cells, dims),
rects AS (
  SELECT 'mpa' AS kind, 'mpa-' || n_nationkey AS feature_id, upper(n_name) AS code,
         3.625e0 + (n_nationkey * 7) % CAST(floor(m * 4) AS BIGINT) * 0.1875e0 AS x0,
         33.625e0 + (n_nationkey * 11 + 3) % CAST(floor(m * 4) AS BIGINT) * 0.1875e0 AS y0, 0.65625e0 AS w, 0.46875e0 AS h
  FROM nation, side
  UNION ALL
  SELECT 'seagrass', 'bed-' || p_partkey, NULL,
         3.625e0 + (p_partkey * 29) % CAST(floor(m * 12) AS BIGINT) * 0.0625e0,
         33.625e0 + (p_partkey * 31 + 5) % CAST(floor(m * 12) AS BIGINT) * 0.0625e0, 0.25e0, 0.1875e0
  FROM part, side
),
spots AS (
  SELECT 'aquaculture' AS kind, 'site-' || s_suppkey AS feature_id,
         3.625e0 + (s_suppkey * 37) % CAST(floor(m * 4) AS BIGINT) * 0.1875e0 AS x,
         33.625e0 + (s_suppkey * 53 + 1) % CAST(floor(m * 4) AS BIGINT) * 0.1875e0 AS y
  FROM supplier, side
),
farms AS (
  SELECT 'farm-' || c_custkey AS id, 3.625e0 + (c_custkey * 31) % CAST(floor(m * 48) AS BIGINT) * 0.015625e0 AS lon,
         33.625e0 + (c_custkey * 47 + 7) % CAST(floor(m * 48) AS BIGINT) * 0.015625e0 AS lat
  FROM customer, side
),
class_cells AS (
  SELECT 3.625e0 + (p_partkey * 13) % CAST(floor(m * 8) AS BIGINT) * 0.09375e0 AS lon,
         33.625e0 + (p_partkey * 17 + 2) % CAST(floor(m * 8) AS BIGINT) * 0.09375e0 AS lat,
         ['rock', 'sand', 'mud', 'biogenic'][p_size % 4 + 1] AS class, p_retailprice / 1000 AS rate
  FROM part, side
),
coast AS (
  SELECT 3.625e0 + (o_orderkey * 19) % CAST(floor(m * 48) AS BIGINT) * 0.015625e0 AS lon,
         33.625e0 + (o_orderkey * 23 + 5) % CAST(floor(m * 48) AS BIGINT) * 0.015625e0 AS lat,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'eroding' WHEN '2-HIGH' THEN 'accreting'
              ELSE 'stable' END AS class,
         o_totalprice / 100000 AS length_km
  FROM orders, side
)"""


def hits(events: str, members: str, prefix: str = "") -> str:
    """Event against overlay, from the boxes of the member cells, as ``{prefix}hits``."""
    p = prefix
    return f""",
{p}boxes AS (
  SELECT DISTINCT event_id, is_point, clon, clat, clon - h AS cx0, clat - h AS cy0, clon + h AS cx1, clat + h AS cy1
  FROM {members}, (SELECT min(step) / 2 AS h FROM cells)
),
{p}pieces AS (
  SELECT event_id, kind, feature_id, code, is_point,
         greatest(0e0, least(x0 + w, cx1) - greatest(x0, cx0)) * greatest(0e0, least(y0 + h, cy1) - greatest(y0, cy0)) AS a,
         (least(y0 + h, cy1) + greatest(y0, cy0)) / 2 AS mid
  FROM {p}boxes, rects
  WHERE CASE WHEN is_point THEN clon BETWEEN x0 AND x0 + w AND clat BETWEEN y0 AND y0 + h
             ELSE cx0 <= x0 + w AND x0 <= cx1 AND cy0 <= y0 + h AND y0 <= cy1 END
),
{p}rect_hits AS (
  SELECT event_id, kind, feature_id, code,
         CASE WHEN NOT is_point AND sum(a) > 0
              THEN sum(a) * 111.32e0 * 111.32e0 * cos(radians(sum(a * mid) / sum(a))) ELSE 0e0 END AS km2
  FROM {p}pieces GROUP BY event_id, kind, feature_id, code, is_point
),
{p}spot_hits AS (
  SELECT DISTINCT event_id, kind, feature_id FROM {p}boxes, spots
  WHERE CASE WHEN is_point THEN x = clon AND y = clat
             ELSE x BETWEEN cx0 AND cx1 AND y BETWEEN cy0 AND cy1 END
),
{p}impact AS (
  SELECT e.event_id, e.category, e.category_name,
         CAST(coalesce(s.n, 0) AS INTEGER) AS n_aquaculture_sites,
         round(coalesce(r.mpa, 0e0), 2) AS mpa_area_km2, round(coalesce(r.bed, 0e0), 2) AS seagrass_area_km2,
         coalesce(r.n_mpa, 0) AS n_mpa, coalesce(r.n_bed, 0) AS n_bed
  FROM {events} e
  LEFT JOIN (SELECT event_id, count(*) AS n FROM {p}spot_hits GROUP BY 1) s ON s.event_id = e.event_id
  LEFT JOIN (SELECT event_id, sum(km2) FILTER (WHERE kind = 'mpa') AS mpa, sum(km2) FILTER (WHERE kind = 'seagrass') AS bed,
                    count(*) FILTER (WHERE kind = 'mpa') AS n_mpa, count(*) FILTER (WHERE kind = 'seagrass') AS n_bed
             FROM {p}rect_hits GROUP BY 1) r ON r.event_id = e.event_id
)"""


FOOTPRINT = """,
covered AS (
  SELECT c.event_id, c.geom_type = 'Point' AS is_point, m.lon AS clon, m.lat AS clat
  FROM members m JOIN clusters c ON c.first_seq = m.first_seq
)"""
IMPACT = CLUSTERS + PLACES + FOOTPRINT + hits("clusters", "covered")
RAW_IMPACT = EVENTS + PLACES + """,
single AS (SELECT event_id, FALSE AS is_point, lon AS clon, lat AS clat FROM events)""" + hits("events", "single")

EVENT_COLUMNS = (
    "event_id, date_start, date_end, date_peak, duration_days, intensity_max, intensity_mean, "
    "intensity_cumulative, category, category_name, centroid_lon, centroid_lat"
)
CLUSTER_COLUMNS = EVENT_COLUMNS + ", n_pixels, geom_type"

WINDOWED = CLIM + """,
cut AS (SELECT * FROM cube WHERE dt BETWEEN DATE '1998-05-01' AND DATE '1999-04-30')""" + detection("cut")

SLAB = CELLS + """,
slab AS (
  SELECT CAST(l_shipdate AS DATE) AS dt, lat AS nav_lat, lon AS nav_lon, l_linenumber * 0.5e0 AS depth,
         l_quantity + 273.15e0 AS thetao
  FROM lineitem JOIN cells ON k = l_suppkey
),
surface AS (
  SELECT * FROM slab
  WHERE depth = (SELECT depth FROM slab ORDER BY abs(depth - 1.02e0), depth DESC LIMIT 1)
)"""

DERIVED = CUBE + """,
plain AS (
  SELECT lat, lon, doy, round(avg(sst), 6) AS seas, round(quantile_cont(sst, 0.9), 6) AS thresh FROM cube GROUP BY 1, 2, 3
),
derived AS (
  SELECT c.dt, c.lat, c.lon, c.sst, seas, thresh,
         CASE WHEN c.sst >= thresh THEN 1 ELSE 0 END AS flag,
         CASE WHEN c.sst IS NULL OR NOT c.sst >= thresh THEN 0
              WHEN NOT thresh > seas THEN 5
              ELSE least(5, greatest(1, CAST(floor((c.sst - seas) / (thresh - seas)) AS INTEGER))) END AS cat
  FROM cube c JOIN plain p ON p.lat = c.lat AND p.lon = c.lon AND p.doy = c.doy
)"""

ANOMALY = CLIM + """,
field AS (
  SELECT c.dt, c.lat, c.lon, c.sst - m.seas AS anomaly,
         CAST(round((c.lat - 34e0) / step) AS INTEGER) AS ilat, CAST(round((c.lon - 4e0) / step) AS INTEGER) AS ilon
  FROM cube c JOIN clim m ON m.lat = c.lat AND m.lon = c.lon AND m.doy = dayofyear(c.dt),
       (SELECT min(step) AS step FROM cells)
  WHERE c.dt = DATE '1998-07-15'
),
shape AS (
  SELECT CAST(max(r) + 1 AS INTEGER) AS n_lat, CAST(max(c) + 1 AS INTEGER) AS n_lon FROM cells
)"""

MASK = """,
land AS (
  SELECT CAST(c_custkey * 7 % n_lat AS INTEGER) AS ilat,
         CAST((c_custkey % n_lat) * (c_custkey % n_lat) % n_lon AS INTEGER) AS ilon
  FROM customer, shape
),
grown AS (
  SELECT DISTINCT ilat + dy AS ilat, ilon + dx AS ilon
  FROM land, shape, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(dy, dx)
  WHERE ilat + dy BETWEEN 0 AND n_lat - 1 AND ilon + dx BETWEEN 0 AND n_lon - 1
)"""

COMPOUND = CUBE + """,
disc AS (
  SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS dt, sum(l_discount) AS s, count(*) AS n
  FROM lineitem GROUP BY 1, 2
),
salt AS (
  SELECT c.lat, c.lon, d.dt, sum(coalesce(o.s, 0e0)) OVER t AS sw, sum(coalesce(o.n, 0)) OVER t AS nw
  FROM cells c CROSS JOIN days d LEFT JOIN disc o ON o.k = c.k AND o.dt = d.dt
  WINDOW t AS (PARTITION BY c.k ORDER BY d.dt ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)
),
both_vars AS (
  SELECT c.lat, c.lon, c.sst, 38e0 - 10e0 * (round(s.sw, 2) / s.nw - 0.05e0) AS sal
  FROM cube c JOIN salt s ON s.lat = c.lat AND s.lon = c.lon AND s.dt = c.dt
  WHERE c.sst IS NOT NULL AND s.nw > 0
),
limits AS (
  SELECT lat, lon, quantile_cont(sst, 0.9) AS hi, quantile_cont(sal, 0.1) AS lo FROM both_vars GROUP BY 1, 2
),
per_cell AS (
  SELECT b.lat, b.lon, count(*) FILTER (WHERE sst > hi) AS hot_days, count(*) FILTER (WHERE sal < lo) AS fresh_days,
         count(*) FILTER (WHERE sst > hi AND sal < lo) AS compound_days
  FROM both_vars b JOIN limits l ON l.lat = b.lat AND l.lon = b.lon GROUP BY 1, 2
)"""

LINKS = EVENTS + """,
tiled AS (
  SELECT *, CAST(floor(centroid_lon / (1.5e0 * 0.7e0)) AS INTEGER) AS tx,
            CAST(floor(centroid_lat / (1.5e0 * 0.7e0)) AS INTEGER) AS ty FROM events
)"""

ELLIPSES = CLUSTERS + PLACES + """,
ellipses AS (
  SELECT event_id, centroid_lon AS lon, centroid_lat AS lat, 0.3e0 + 0.05e0 * n_pixels AS sx, 0.3e0 AS sy FROM clusters
),
inside AS (
  SELECT event_id, class, rate FROM ellipses e JOIN class_cells c
    ON ((c.lon - e.lon) / sx) * ((c.lon - e.lon) / sx) + ((c.lat - e.lat) / sy) * ((c.lat - e.lat) / sy) <= 1
)"""

BUFFER = CLUSTERS + PLACES + """,
near_coast AS (
  SELECT event_id, class, length_km
  FROM clusters e, coast s, (SELECT avg(lat) AS mean_lat FROM coast)
  WHERE sqrt(((s.lon - centroid_lon) * cos(radians((centroid_lat + mean_lat) / 2)) * 111e0)
           * ((s.lon - centroid_lon) * cos(radians((centroid_lat + mean_lat) / 2)) * 111e0)
           + ((s.lat - centroid_lat) * 111e0) * ((s.lat - centroid_lat) * 111e0)) <= 50
),
buffered AS (
  SELECT c.event_id, round(coalesce(total, 0e0), 2) AS near_km, round(coalesce(ero, 0e0), 2) AS eroding_km,
         round(CASE WHEN total > 0 THEN ero / total ELSE 0e0 END, 3) AS eroding_fraction
  FROM clusters c LEFT JOIN (
    SELECT event_id, sum(length_km) AS total, sum(CASE WHEN class = 'eroding' THEN length_km ELSE 0e0 END) AS ero
    FROM near_coast GROUP BY 1) n ON n.event_id = c.event_id
)"""

SIDES = CLUSTERS + FOOTPRINT + """,
foot AS (
  SELECT DISTINCT event_id, CAST(round((clat - 34e0) / step) AS INTEGER) AS r, CAST(round((clon - 4e0) / step) AS INTEGER) AS c
  FROM covered, (SELECT min(step) AS step FROM cells)
),
sides AS (
  SELECT event_id, side, ilon, ilat, CAST(sum(sign) AS INTEGER) AS sign FROM (
    SELECT event_id, 'h' AS side, c AS ilon, r AS ilat, 1 AS sign FROM foot
    UNION ALL SELECT event_id, 'h', c, r + 1, -1 FROM foot
    UNION ALL SELECT event_id, 'v', c, r, -1 FROM foot
    UNION ALL SELECT event_id, 'v', c + 1, r, 1 FROM foot)
  GROUP BY 1, 2, 3, 4 HAVING sum(sign) <> 0
)"""

# Unit sides are directed with the inside on their left; ways are 0 east, 1 north, 2 west, 3 south. At a corner the path
# turns left, goes on, or turns right, whichever comes first; where it would pass a corner twice it turns right.
RINGS = SIDES + """,
edges AS (
  SELECT event_id, x0, y0, x0 + dx AS x1, y0 + dy AS y1, way, (x0 * 100000 + y0) * 4 + way AS s
  FROM (SELECT event_id, CASE WHEN side = 'h' AND sign < 0 THEN ilon + 1 ELSE ilon END AS x0,
               CASE WHEN side = 'v' AND sign < 0 THEN ilat + 1 ELSE ilat END AS y0,
               CASE WHEN side = 'h' THEN sign ELSE 0 END AS dx, CASE WHEN side = 'v' THEN sign ELSE 0 END AS dy,
               CASE WHEN side = 'h' THEN 1 - sign ELSE 2 - sign END AS way FROM sides)
),
options AS (
  SELECT a.event_id, a.s, a.x1, a.y1, b.s AS t, (b.way - a.way + 5) % 4 AS turn, count(*) OVER (PARTITION BY a.event_id, a.s) AS n
  FROM edges a JOIN edges b ON b.event_id = a.event_id AND b.x0 = a.x1 AND b.y0 = a.y1
),
left_turns AS (SELECT event_id, s, arg_max(t, turn) AS t FROM options GROUP BY 1, 2),
reached AS (
  SELECT event_id, s, s AS t FROM edges UNION
  SELECT r.event_id, r.s, n.t FROM reached r JOIN left_turns n ON n.event_id = r.event_id AND n.s = r.t
),
first_rings AS (SELECT event_id, s, min(t) AS ring FROM reached GROUP BY 1, 2),
twice AS (
  SELECT o.event_id, x1, y1 FROM options o JOIN first_rings f ON f.event_id = o.event_id AND f.s = o.s
  WHERE n = 2 GROUP BY 1, 2, 3 HAVING min(ring) = max(ring)
),
turns AS (
  SELECT o.event_id, o.s, CASE WHEN any_value(w.x1) IS NULL THEN arg_max(t, turn) ELSE arg_min(t, turn) END AS t
  FROM options o LEFT JOIN twice w ON w.event_id = o.event_id AND w.x1 = o.x1 AND w.y1 = o.y1 GROUP BY 1, 2
),
walk AS (
  SELECT event_id, s AS start, s, 0 AS pos FROM edges UNION ALL
  SELECT w.event_id, start, n.t, pos + 1 FROM walk w JOIN turns n ON n.event_id = w.event_id AND n.s = w.s WHERE n.t <> start
),
on_ring AS (
  SELECT e.*, w.start AS ring, pos, e.way <> lag(e.way, 1, -1) OVER (PARTITION BY w.event_id, w.start ORDER BY pos) AS corner
  FROM walk w JOIN (SELECT event_id, start FROM walk GROUP BY 1, 2 HAVING min(s) = start) f ON f.event_id = w.event_id AND f.start = w.start
  JOIN edges e ON e.event_id = w.event_id AND e.s = w.s
),
hang AS (
  SELECT event_id, r, c, r AS r2, c AS c2 FROM foot UNION
  SELECT h.event_id, h.r, h.c, f.r, f.c FROM hang h JOIN foot f ON f.event_id = h.event_id AND abs(f.r - h.r2) + abs(f.c - h.c2) = 1
),
regions AS (SELECT event_id, r, c, min(r2 * 100000 + c2) AS region FROM hang GROUP BY 1, 2, 3),
rings AS (
  SELECT o.event_id, ring, sum(x0 * y1 - x1 * y0) < 0 AS is_hole, count(*) FILTER (corner) + 1 AS n_points,
         min(x0 - CASE WHEN way IN (1, 2) THEN 1 ELSE 0 END) FILTER (pos = 0) AS c,
         min(y0 - CASE WHEN way IN (2, 3) THEN 1 ELSE 0 END) FILTER (pos = 0) AS r,
         '[' || string_agg(p, ',' ORDER BY pos) FILTER (corner) || ',' || min(p) FILTER (pos = 0) || ']' AS ring_text
  FROM (SELECT *, '[' || round(4e0 + (x0 - 0.5e0) * step, 4) || ',' || round(34e0 + (y0 - 0.5e0) * step, 4) || ']' AS p
        FROM on_ring, (SELECT min(step) AS step FROM cells)) o
  GROUP BY 1, 2
),
polys AS (
  SELECT g.event_id, region, min(ring) FILTER (NOT is_hole) AS first, count(*) AS n_rings, sum(n_points) AS n_points,
         '[' || string_agg(ring_text, ',' ORDER BY is_hole, ring) || ']' AS poly_text
  FROM rings g JOIN regions q ON q.event_id = g.event_id AND q.r = g.r AND q.c = g.c GROUP BY 1, 2
),
outlines AS (
  SELECT event_id, count(*) AS n_polygons, sum(n_rings) AS n_rings, sum(n_points) AS n_points,
         CASE WHEN count(*) > 1 THEN '[' ELSE '' END || string_agg(poly_text, ',' ORDER BY first) || CASE WHEN count(*) > 1 THEN ']' ELSE '' END AS coordinates
  FROM polys GROUP BY 1
),
shaped AS (
  SELECT c.event_id, c.date_start, c.date_end, c.date_peak, c.category, c.n_pixels, centroid_lon, centroid_lat,
         CASE WHEN geom_type = 'Point' THEN 'Point' WHEN n_polygons > 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS shape,
         CASE WHEN geom_type = 'Point' THEN '[' || centroid_lon || ',' || centroid_lat || ']' ELSE coordinates END AS coordinates,
         CASE WHEN geom_type = 'Point' THEN 21 ELSE 9 + CASE WHEN n_polygons > 1 THEN 9 * n_polygons ELSE 0 END + 4 * n_rings + 16 * n_points END AS wkb_bytes
  FROM clusters c LEFT JOIN outlines o ON o.event_id = c.event_id
)"""
WKB_HEAD = "CASE shape WHEN 'Point' THEN '0101000000' WHEN 'Polygon' THEN '0103000000' ELSE '0106000000' END"


def bucket(key: str, extra: str = "", source: str = "") -> str:
    return sql(source or IMPACT, f"""
SELECT {key} AS key, count(*) AS count, round(greatest(0e0, max(intensity_max)), 3) AS intensity_max,
       round(avg(intensity_max), 3) AS intensity_mean, CAST(sum(n_pixels) AS BIGINT) AS n_pixels_total,
       CAST(sum(n_aquaculture_sites) AS BIGINT) AS aquaculture_sites,
       round(sum(mpa_area_km2), 2) AS mpa_area_km2, round(sum(seagrass_area_km2), 2) AS seagrass_area_km2{extra}
FROM (SELECT c.*, i.n_aquaculture_sites, i.mpa_area_km2, i.seagrass_area_km2
      FROM clusters c JOIN impact i ON i.event_id = c.event_id) GROUP BY 1""")


COUNTRY = """CASE
  WHEN centroid_lat BETWEEN 30 AND 36.5 AND centroid_lon BETWEEN 32 AND 36.5 THEN 'EG'
  WHEN centroid_lat BETWEEN 30 AND 35 AND centroid_lon BETWEEN 19 AND 32 THEN 'LY'
  WHEN centroid_lat BETWEEN 30 AND 38 AND centroid_lon BETWEEN 7 AND 19 THEN 'TN'
  WHEN centroid_lat BETWEEN 30 AND 38 AND centroid_lon BETWEEN -2 AND 7 THEN 'DZ'
  WHEN centroid_lat BETWEEN 30 AND 36 AND centroid_lon BETWEEN -7 AND -2 THEN 'MA'
  WHEN centroid_lat BETWEEN 35 AND 39 AND centroid_lon BETWEEN -2 AND 9 THEN 'ES'
  WHEN centroid_lat BETWEEN 41 AND 43 AND centroid_lon BETWEEN 0 AND 5 THEN 'FR'
  WHEN centroid_lat BETWEEN 36 AND 46 AND centroid_lon BETWEEN 5 AND 19 THEN 'IT'
  WHEN centroid_lat BETWEEN 40 AND 46 AND centroid_lon BETWEEN 13 AND 21 THEN 'HR'
  WHEN centroid_lat BETWEEN 34 AND 42 AND centroid_lon BETWEEN 19 AND 28 THEN 'GR'
  WHEN centroid_lat BETWEEN 35 AND 37 AND centroid_lon BETWEEN 32 AND 36 THEN 'CY'
  WHEN centroid_lat BETWEEN 36 AND 42 AND centroid_lon BETWEEN 26 AND 36 THEN 'TR'
  ELSE '??' END"""

KIND_SUMS = """CAST(sum(n_aquaculture_sites) AS BIGINT) AS aquaculture, CAST(sum(n_mpa) AS BIGINT) AS mpa,
       CAST(sum(n_bed) AS BIGINT) AS seagrass"""


def shares(classes: list[str], rate: bool = False, score: str = "") -> str:
    label = "CASE WHEN rate < 1 THEN 'low' WHEN rate < 2 THEN 'medium' ELSE 'high' END" if rate else "class"
    cols = ",\n       ".join(
        f"coalesce(round(count(i.event_id) FILTER (WHERE {label} = '{c}') / nullif(CAST(count(i.event_id) AS DOUBLE), 0), 3), 0e0) AS share_{c}"
        for c in classes)
    inner = f"""
SELECT e.event_id, count(i.event_id) AS cells, {cols},
       coalesce(round(avg(rate), 2), 0e0) AS mean_rate
FROM ellipses e LEFT JOIN inside i ON i.event_id = e.event_id GROUP BY 1"""
    return sql(ELLIPSES, f"SELECT *{score} FROM ({inner})")


def site(source: str, extra: str) -> str:
    """Clusters at the site, from the raw events whose cell lies in the padded box."""
    return sql(source + PLACES + """,
site AS (SELECT * FROM rects WHERE code = 'NATION_7'),
around AS (
  SELECT e.* FROM events e, site
  WHERE centroid_lon BETWEEN x0 - 0.5e0 AND x0 + w + 0.5e0 AND centroid_lat BETWEEN y0 - 0.5e0 AND y0 + h + 0.5e0
)""" + clustering("around") + FOOTPRINT + hits("clusters", "covered"), f"""
SELECT {CLUSTER_COLUMNS}{extra} FROM clusters
WHERE event_id IN (SELECT event_id FROM rect_hits WHERE code = 'NATION_7')""")


WINDOWED_IMPACT = WINDOWED + clustering() + PLACES + FOOTPRINT + hits("clusters", "covered")

EXPOSED = """,
reached AS (
  SELECT DISTINCT f.id, c.event_id, c.date_start
  FROM farms f, covered v JOIN clusters c ON c.event_id = v.event_id, (SELECT min(step) / 2 AS s FROM cells)
  WHERE CASE WHEN v.is_point
             THEN sqrt((f.lon - clon) * (f.lon - clon) + (f.lat - clat) * (f.lat - clat)) < 0.07e0
             ELSE f.lon BETWEEN clon - s AND clon + s AND f.lat BETWEEN clat - s AND clat + s END)"""
FARM_ROWS = """
SELECT f.id, f.lon, f.lat, CAST(count(event_id) AS INTEGER) AS n_events,
       coalesce(string_agg(event_id, ',' ORDER BY date_start, event_id), '') AS event_ids
FROM farms f LEFT JOIN reached r ON r.id = f.id GROUP BY 1, 2, 3"""

ORACLE: dict[str, str] = {
    "cube_extent": sql(CUBE, """
SELECT min(dt) AS first_day, max(dt) AS last_day, count(DISTINCT dt) AS n_days,
       min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM cube"""),
    "cube_year_coverage": sql(CUBE, """
SELECT CAST(year(dt) AS INTEGER) AS year, min(dt) AS first_day, max(dt) AS last_day FROM cube GROUP BY 1"""),
    "cube_scan": sql(CUBE, """
SELECT dt, lat, lon, round(sst, 6) AS sst FROM cube
WHERE dt BETWEEN DATE '1998-05-01' AND DATE '1999-04-30' AND lon BETWEEN 4 AND 8.5 AND lat BETWEEN 34 AND 40"""),
    "year_items": sql(CUBE, """
SELECT 'sst-grid-' || year AS id, 'sst-grid' AS collection, year, d0 || 'T00:00:00Z' AS start_datetime,
       d1 || 'T23:59:59Z' AS end_datetime, '1991-2020' AS climatology, x0, y0, x1, y1,
       'events?start=' || d0 || '&end=' || d1 AS events_href, 'anomaly?date=' || d0 AS anomaly_href
FROM (SELECT CAST(year(dt) AS INTEGER) AS year, strftime(min(dt), '%Y-%m-%d') AS d0, strftime(max(dt), '%Y-%m-%d') AS d1
      FROM cube GROUP BY 1),
     (SELECT min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM cube)"""),
    "distinct_years": sql(CUBE, "SELECT DISTINCT CAST(year(dt) AS INTEGER) AS year FROM cube"),
    "missing_days": sql(SLAB, """
SELECT dt FROM (SELECT CAST(unnest(generate_series(DATE '1994-12-20', DATE '2001-11-20', INTERVAL 1 DAY)) AS DATE) AS dt)
WHERE dt NOT IN (SELECT dt FROM surface)"""),
    "missing_ranges": sql(CUBE, """
SELECT * FROM (
  SELECT DATE '1994-12-20' AS "start", least(DATE '2001-11-20', min(dt) - 1) AS "end" FROM cube
  UNION ALL SELECT greatest(DATE '1994-12-20', max(dt) + 1), DATE '2001-11-20' FROM cube)
WHERE "start" <= "end" """),
    "warm_window": sql(CUBE, """
SELECT min(dt) <= DATE '2001-11-06' - 90 AND max(dt) >= DATE '2001-11-06' - 2 AS covered FROM cube"""),
    "surface_level": sql(SLAB, "SELECT dt, nav_lat, nav_lon, round(thetao, 6) AS thetao FROM surface"),
    "to_celsius": sql(SLAB, """
SELECT dt, nav_lat AS lat, nav_lon AS lon, round(thetao - 273.15e0, 6) AS sst FROM surface"""),
    "product_routing": """
SELECT CASE WHEN d > DATE '2001-06-01' THEN 'forecast' WHEN d + 30 < DATE '2001-06-01' - 365 THEN 'reanalysis'
            ELSE 'nrt' END AS product, count(*) AS n
FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY 1""",
    "slab_merge": sql(CUBE + SLAB[len(CELLS):], """
SELECT CAST(year(dt) AS INTEGER) AS year, count(*) AS n, count(DISTINCT dt) AS n_days, round(sum(sst), 2) AS total
FROM (SELECT dt, sst FROM cube WHERE dt <= DATE '2000-12-31'
      UNION ALL
      SELECT dt, min(thetao - 273.15e0) FROM surface
      WHERE dt NOT IN (SELECT dt FROM cube WHERE dt <= DATE '2000-12-31')
      GROUP BY dt, nav_lat, nav_lon) GROUP BY 1"""),
    "backfilled_years": sql(CUBE, """
SELECT CAST(year(dt) AS INTEGER) AS year, count(*) AS n, round(sum(sst), 2) AS total FROM cube WHERE year(dt) IN (1996, 1998) GROUP BY 1"""),
    "refresh_freshness": sql(CUBE, """
SELECT min(dt) AS cube_start, max(dt) AS cube_end, any_value(t) AS last_success,
       CASE WHEN any_value(age) < 6 THEN 'fresh' WHEN any_value(age) < 24 THEN 'good' WHEN any_value(age) < 72 THEN 'stale'
            WHEN any_value(age) IS NULL THEN 'unknown' ELSE 'very_stale' END AS bucket
FROM cube, (SELECT t, date_diff('hour', CAST(t AS TIMESTAMP), TIMESTAMP '2001-11-09 12:00:00') AS age
            FROM (SELECT CAST(max(o_orderdate) AS DATE) AS t FROM orders WHERE o_orderstatus = 'F'))"""),
    "nearest_day": sql(CUBE, """
SELECT dt, lat, lon, round(sst, 6) AS sst FROM cube
WHERE dt = (SELECT dt FROM days ORDER BY abs(date_diff('day', DATE '2002-03-01', dt)), dt DESC LIMIT 1)"""),
    "decimated_cells": sql(CELLS, """
SELECT lat, lon FROM cells, (SELECT min(r) AS r0, min(c) AS c0, greatest(1, CAST(ceil(sqrt(
         (max(r) - min(r) + 1) * (max(c) - min(c) + 1) / 25e0)) AS BIGINT)) AS stride FROM cells)
WHERE (r - r0) % stride = 0 AND (c - c0) % stride = 0"""),
    "clim_stored": sql(CLIM, "SELECT *, 1995 AS clim_start FROM clim"),
    "derived_stored": sql(DERIVED, """
SELECT CAST(year(dt) AS INTEGER) AS year, flag AS mhw_flag, cat AS mhw_category, count(*) AS n FROM derived GROUP BY 1, 2, 3"""),
    "event_collection": sql(WINDOWED + """,
boxed AS (SELECT * FROM events WHERE centroid_lon BETWEEN 4.75 AND 10 AND centroid_lat BETWEEN 34.75 AND 40)"""
                            + clustering("boxed"), f"""
SELECT {CLUSTER_COLUMNS}, (SELECT count(*) FROM clusters) AS "numberMatched",
       (SELECT CASE WHEN count(*) > 30 THEN 30 END FROM clusters) AS next, 0 AS prev
FROM clusters ORDER BY event_seq LIMIT 20 OFFSET 10"""),
    "events_csv": sql(IMPACT, """
SELECT c.event_id, date_start, c.n_pixels, n_aquaculture_sites, mpa_area_km2, seagrass_area_km2
FROM clusters c JOIN impact i ON i.event_id = c.event_id"""),
    "events_geoparquet": sql(RINGS, f"""
SELECT event_id, date_start, date_end, date_peak, n_pixels, CAST(wkb_bytes AS INTEGER) AS wkb_bytes, {WKB_HEAD} AS wkb_head FROM shaped"""),
    "feature_lines": sql(RINGS, "SELECT event_id, shape AS geom_type, coordinates, category, n_pixels FROM shaped"),
    "geo_events": sql(RINGS, f"SELECT event_id, n_pixels, CAST(wkb_bytes AS INTEGER) AS wkb_bytes, {WKB_HEAD} AS wkb_head FROM shaped"),
    "overlay_geojson": sql(CELLS + PLACES, """
SELECT feature_id, 'Polygon' AS geom_type, x0 AS xmin, y0 AS ymin, x0 + w AS xmax, y0 + h AS ymax,
       CASE WHEN kind = 'mpa' THEN 5 ELSE 1 END AS n_props FROM rects"""),
    "clim_pooled": sql(POOLED, "SELECT lat, lon, doy, round(seas, 6) AS seas, round(thresh, 6) AS thresh FROM pooled"),
    "clim_smoothed": sql(CLIM, "SELECT * FROM clim"),
    "clim_year_range": sql(
        POOLED.replace("WHERE sst IS NOT NULL", "WHERE sst IS NOT NULL AND year(dt) BETWEEN 1996 AND 1999"),
        "SELECT lat, lon, doy, round(seas, 6) AS seas, round(thresh, 6) AS thresh FROM pooled"),
    "clim_plain_doy": sql(CUBE, """
SELECT lat, lon, CAST(doy AS INTEGER) AS doy, round(avg(sst), 6) AS seas, round(quantile_cont(sst, 0.9), 6) AS thresh
FROM cube GROUP BY 1, 2, 3"""),
    "clim_bbox": sql(CLIM, "SELECT * FROM clim WHERE lon BETWEEN 4.75 AND 7 AND lat BETWEEN 34.75 AND 37"),
    "nearest_align": sql(CLIM, """
SELECT t.lat, t.lon, doy, seas, thresh
FROM (SELECT DISTINCT lat + 0.25e0 AS lat, lon - 0.375e0 AS lon FROM cells) t
JOIN (SELECT a AS lat, arg_min(b, abs(a - b) - b / 1e6) AS nlat
      FROM (SELECT DISTINCT lat + 0.25e0 AS a FROM cells), (SELECT DISTINCT lat AS b FROM cells) GROUP BY 1) y ON y.lat = t.lat
JOIN (SELECT a AS lon, arg_min(b, abs(a - b) - b / 1e6) AS nlon
      FROM (SELECT DISTINCT lon - 0.375e0 AS a FROM cells), (SELECT DISTINCT lon AS b FROM cells) GROUP BY 1) x ON x.lon = t.lon
JOIN clim m ON m.lat = nlat AND m.lon = nlon"""),
    "clim_quality": sql(CLIM, """,
jumps AS (SELECT max(step) AS jump FROM (SELECT lat, lon, abs(seas - lag(seas) OVER (PARTITION BY lat, lon ORDER BY doy)) AS step
                                         FROM clim) GROUP BY lat, lon),
f AS (SELECT count(*) AS n, count(seas) AS ns, count(thresh) AS nt, min(seas) AS s0, max(seas) AS s1, min(thresh) AS t0,
             max(thresh) AS t1, count(*) FILTER (WHERE thresh < seas) AS below,
             count(*) FILTER (WHERE seas IS NOT NULL AND thresh IS NOT NULL) AS valid, count(DISTINCT doy) AS n_doy,
             (SELECT quantile_cont(jump, 0.99) FROM jumps) AS p99 FROM clim)
SELECT "check", level, value FROM (
  SELECT unnest([
    {'check': 'required variables', 'level': 'ok', 'value': CAST(NULL AS DOUBLE)},
    {'check': 'seas type', 'level': 'ok', 'value': NULL}, {'check': 'thresh type', 'level': 'ok', 'value': NULL},
    {'check': 'units', 'level': 'ok', 'value': NULL},
    {'check': 'seas lowest', 'level': 'ok', 'value': round(s0, 2)}, {'check': 'seas highest', 'level': 'ok', 'value': round(s1, 2)},
    {'check': 'thresh lowest', 'level': 'ok', 'value': round(t0, 2)}, {'check': 'thresh highest', 'level': 'ok', 'value': round(t1, 2)},
    {'check': 'required attributes', 'level': 'ok', 'value': 0}, {'check': 'schema version', 'level': 'ok', 'value': NULL},
    {'check': 'year order', 'level': 'ok', 'value': 7}, {'check': 'year span', 'level': 'warn', 'value': 7},
    {'check': 'created_utc', 'level': 'ok', 'value': NULL}, {'check': 'bbox', 'level': 'ok', 'value': NULL},
    {'check': 'dayofyear length', 'level': CASE WHEN n_doy = 366 THEN 'ok' ELSE 'error' END, 'value': n_doy},
    {'check': 'null share seas', 'level': CASE WHEN 100 * (n - ns) / n > 90 THEN 'error' WHEN 100 * (n - ns) / n > 30 THEN 'warn' ELSE 'ok' END,
     'value': round(100e0 * (n - ns) / n, 2)},
    {'check': 'seas range', 'level': CASE WHEN s0 IS NULL OR s0 < -20 OR s1 > 60 THEN 'error' WHEN s0 < -5 OR s1 > 40 THEN 'warn' ELSE 'ok' END,
     'value': round(s1 - s0, 2)},
    {'check': 'null share thresh', 'level': CASE WHEN 100 * (n - nt) / n > 90 THEN 'error' WHEN 100 * (n - nt) / n > 30 THEN 'warn' ELSE 'ok' END,
     'value': round(100e0 * (n - nt) / n, 2)},
    {'check': 'thresh range', 'level': CASE WHEN t0 IS NULL OR t0 < -20 OR t1 > 60 THEN 'error' WHEN t0 < -3 OR t1 > 45 THEN 'warn' ELSE 'ok' END,
     'value': round(t1 - t0, 2)},
    {'check': 'thresh >= seas', 'level': CASE WHEN valid = 0 THEN 'warn' WHEN 100e0 * below / valid > 25 THEN 'error'
                                              WHEN 100e0 * below / valid > 5 THEN 'warn' ELSE 'ok' END,
     'value': round(100e0 * below / nullif(valid, 0), 2)},
    {'check': 'doy continuity p99', 'level': CASE WHEN p99 IS NULL THEN 'warn' WHEN p99 >= 1 THEN 'error' WHEN p99 >= 0.5 THEN 'warn' ELSE 'ok' END,
     'value': round(p99, 3)}], recursive := true) FROM f)""").replace(")\n,\njumps", "),\njumps"),
    "clim_fingerprint": sql(CLIM + """,
hashed AS (
  SELECT md5(concat_ws('|', CAST(round(lat * 1000000) AS BIGINT), CAST(round(lon * 1000000) AS BIGINT), doy,
                       coalesce(CAST(CAST(round(seas * 1000000) AS BIGINT) AS VARCHAR), ''),
                       coalesce(CAST(CAST(round(thresh * 1000000) AS BIGINT) AS VARCHAR), ''))) AS h FROM clim
),
parts AS (SELECT count(*) AS n, """ + ", ".join(f"sum(CAST('0x' || substr(h, {1 + 8 * k}, 8) AS BIGINT)) AS s{k}" for k in range(4)) + """ FROM hashed)""", """
SELECT sha256(concat_ws('|', n, s0, s1, s2, s3, '{"bbox":[4.0,34.0,36.0,66.0],"clim_end":2001,"clim_start":1995,"pctile":90.0,"schema_version":"1",' ||
              '"smooth_width":31,"units":"degC","window_half_width":5}')) AS fingerprint FROM parts"""),
    "clim_light_check": sql(CLIM, """
SELECT unnest([{'check': 'schema version', 'ok': TRUE}, {'check': 'required attributes', 'ok': TRUE},
               {'check': 'dayofyear length', 'ok': count(DISTINCT doy) = 366},
               {'check': 'seas null share', 'ok': count(seas) > count(*) * 0.5},
               {'check': 'thresh null share', 'ok': count(thresh) > count(*) * 0.5}], recursive := true) FROM clim"""),
    "anomaly_day": sql(ANOMALY, """
SELECT dt, lat, lon, round(anomaly, 6) AS anomaly, round(least(1e0, greatest(0e0, CASE WHEN anomaly IS NOT NULL
       THEN (anomaly + 5) / 10 END)) + CASE WHEN anomaly IS NULL THEN NULL ELSE 0 END, 6) AS colour FROM field"""),
    "anomaly_csv": sql(ANOMALY, """
SELECT printf('%.6f', lat) AS latitude, printf('%.6f', lon) AS longitude,
       CASE WHEN anomaly IS NULL THEN '' ELSE printf('%.4f', anomaly) END AS "anomaly_degC" FROM field"""),
    "derived_cube": sql(DERIVED, """
SELECT dt, lat, lon, round(CAST(CAST(sst AS FLOAT) AS DOUBLE), 3) AS sst, round(CAST(CAST(seas AS FLOAT) AS DOUBLE), 3) AS climatology,
       round(CAST(CAST(thresh AS FLOAT) AS DOUBLE), 3) AS threshold_90p, round(CAST(CAST(sst - seas AS FLOAT) AS DOUBLE), 3) AS anomaly,
       flag AS mhw_flag, cat AS mhw_category FROM derived"""),
    "derived_cube_counts": sql(DERIVED, """
SELECT CAST(year(dt) AS INTEGER) AS year, flag AS mhw_flag, cat AS mhw_category, count(*) AS n FROM derived GROUP BY 1, 2, 3"""),
    "regrid_bilinear": sql(CUBE, """,
targets AS (SELECT lat + 0.25e0 AS lat, lon + 0.375e0 AS lon FROM cells),
ya AS (SELECT a.lat AS y, max(b.lat) AS lo FROM (SELECT DISTINCT lat FROM targets) a JOIN (SELECT DISTINCT lat FROM cells) b ON b.lat < a.lat GROUP BY 1),
yb AS (SELECT a.lat AS y, min(b.lat) AS hi FROM (SELECT DISTINCT lat FROM targets) a JOIN (SELECT DISTINCT lat FROM cells) b ON b.lat >= a.lat GROUP BY 1),
xa AS (SELECT a.lon AS x, max(b.lon) AS lo FROM (SELECT DISTINCT lon FROM targets) a JOIN (SELECT DISTINCT lon FROM cells) b ON b.lon < a.lon GROUP BY 1),
xb AS (SELECT a.lon AS x, min(b.lon) AS hi FROM (SELECT DISTINCT lon FROM targets) a JOIN (SELECT DISTINCT lon FROM cells) b ON b.lon >= a.lon GROUP BY 1),
corners AS (
  SELECT t.lat, t.lon, ya.lo AS y0, yb.hi AS y1, xa.lo AS x0, xb.hi AS x1,
         (t.lat - ya.lo) / (yb.hi - ya.lo) AS v, (t.lon - xa.lo) / (xb.hi - xa.lo) AS u
  FROM targets t LEFT JOIN ya ON ya.y = t.lat LEFT JOIN yb ON yb.y = t.lat LEFT JOIN xa ON xa.x = t.lon LEFT JOIN xb ON xb.x = t.lon
),
filled AS (
  SELECT k.lat, k.lon, d.dt, (a.sst * (1 - v) * (1 - u) + b.sst * (1 - v) * u + c.sst * v * (1 - u) + e.sst * v * u) AS sst
  FROM corners k CROSS JOIN days d
  LEFT JOIN cube a ON a.dt = d.dt AND a.lat = y0 AND a.lon = x0 LEFT JOIN cube b ON b.dt = d.dt AND b.lat = y0 AND b.lon = x1
  LEFT JOIN cube c ON c.dt = d.dt AND c.lat = y1 AND c.lon = x0 LEFT JOIN cube e ON e.dt = d.dt AND e.lat = y1 AND e.lon = x1
)
SELECT lat, lon, count(*) AS n, count(sst) AS known, round(avg(sst), 5) AS mean FROM filled GROUP BY 1, 2""").replace(")\n,\ntargets", "),\ntargets"),
    "upsample_bilinear": sql(ANOMALY, """,
ov AS (SELECT unnest(generate_series(0, CAST(n_lat * 4 - 1 AS BIGINT))) AS o FROM shape),
oh AS (SELECT unnest(generate_series(0, CAST(n_lon * 4 - 1 AS BIGINT))) AS o FROM shape),
rv AS (SELECT o, least(n_lat - 1e0, greatest(0e0, (o + 0.5e0) / 4 - 0.5e0)) AS s FROM ov, shape),
rh AS (SELECT o, least(n_lon - 1e0, greatest(0e0, (o + 0.5e0) / 4 - 0.5e0)) AS s FROM oh, shape)
SELECT CAST(rv.o AS INTEGER) AS row, CAST(rh.o AS INTEGER) AS col,
       round(sum(coalesce(anomaly, 0e0) * (1 - abs(rv.s - ilat)) * (1 - abs(rh.s - ilon))), 5) AS value,
       coalesce(bool_or(anomaly IS NULL) FILTER (WHERE ilat = rv.o // 4 AND ilon = rh.o // 4), TRUE) AS missing
FROM rv, rh, field WHERE abs(rv.s - ilat) < 1 AND abs(rh.s - ilon) < 1 GROUP BY 1, 2""").replace(")\n,\nov", "),\nov"),
    "mask_grow": sql(ANOMALY + MASK, "SELECT ilat, ilon FROM grown"),
    "masked_anomaly": sql(ANOMALY + MASK, """
SELECT ilat, ilon, round(anomaly, 6) AS anomaly FROM field f
WHERE NOT EXISTS (SELECT 1 FROM grown g WHERE g.ilat = f.ilat AND g.ilon = f.ilon)"""),
    "events_raw": sql(EVENTS, f"SELECT {EVENT_COLUMNS} FROM events"),
    "events_self_baseline": sql(EVENTS, f"SELECT {EVENT_COLUMNS} FROM events"),
    "events_window": sql(WINDOWED, f"SELECT {EVENT_COLUMNS} FROM events"),
    "events_other_grid": sql(WINDOWED, f"SELECT {EVENT_COLUMNS} FROM events"),
    "events_default_window": sql(CLIM + """,
cut AS (SELECT * FROM cube WHERE dt >= (SELECT max(dt) - 30 FROM cube))""" + detection("cut"), f"SELECT {EVENT_COLUMNS} FROM events"),
    "events_filtered": sql(EVENTS, f"""
SELECT {EVENT_COLUMNS} FROM events WHERE date_end >= DATE '1998-05-01' AND date_start <= DATE '1999-04-30'
  AND centroid_lon BETWEEN 4.75 AND 8.5 AND centroid_lat BETWEEN 34.75 AND 38.5 AND category >= 2"""),
    "events_topk": sql(EVENTS, f"SELECT {EVENT_COLUMNS} FROM events ORDER BY intensity_max DESC, event_seq LIMIT 20"),
    "events_ranked": sql(EVENTS, "SELECT event_id, intensity_max FROM events"),
    "events_page": sql(EVENTS, """
SELECT event_id, date_start, count(*) OVER () AS "numberMatched" FROM events
WHERE centroid_lon BETWEEN 4.75 AND 10 AND centroid_lat BETWEEN 34.75 AND 40 ORDER BY event_seq LIMIT 50 OFFSET 100"""),
    "cube_page": sql(CUBE, """
SELECT dt, lat, lon, round(sst, 6) AS sst, count(*) OVER () AS "numberMatched" FROM cube ORDER BY dt, lat, lon LIMIT 200 OFFSET 12345"""),
    "event_lookup": sql(EVENTS, f"SELECT {EVENT_COLUMNS} FROM events WHERE event_id = 'mhw-000007'"),
    "severe_count": sql(EVENTS, "SELECT count(*) FILTER (WHERE category >= 3) AS n_severe FROM events"),
    "event_links": sql(LINKS, """
SELECT tx, ty, ux, uy, count(DISTINCT day) AS n_days FROM (
  SELECT a.tx, a.ty, b.tx AS ux, b.ty AS uy, a.date_start AS day
  FROM tiled a JOIN tiled b ON a.date_start BETWEEN b.date_start AND b.date_end
   AND sqrt((a.centroid_lon - b.centroid_lon) * (a.centroid_lon - b.centroid_lon)
          + (a.centroid_lat - b.centroid_lat) * (a.centroid_lat - b.centroid_lat)) < 1.5e0
  WHERE a.tx <> b.tx OR a.ty <> b.ty) GROUP BY 1, 2, 3, 4"""),
    "event_clusters": sql(CLUSTERS, f"SELECT {CLUSTER_COLUMNS} FROM clusters"),
    "cluster_members": sql(CLUSTERS, """
SELECT m.event_id, c.event_id AS cluster_id FROM members m JOIN clusters c ON c.first_seq = m.first_seq"""),
    "clusters_window": sql(WINDOWED + """,
boxed AS (SELECT * FROM events WHERE centroid_lon BETWEEN 4.75 AND 10 AND centroid_lat BETWEEN 34.75 AND 40)"""
                           + clustering("boxed"), f"SELECT {CLUSTER_COLUMNS} FROM clusters"),
    "outline_edges": sql(SIDES, "SELECT * FROM sides"),
    "outline_lengths": sql(SIDES, """,
straight AS (
  SELECT event_id, side, across, sign, count(*) AS n FROM (
    SELECT *, pos - row_number() OVER (PARTITION BY event_id, side, across, sign ORDER BY pos) AS island
    FROM (SELECT *, CASE WHEN side = 'h' THEN ilon ELSE ilat END AS pos, CASE WHEN side = 'h' THEN ilat ELSE ilon END AS across FROM sides))
  GROUP BY event_id, side, across, sign, island)
SELECT event_id, count(*) AS n_corners, CAST(sum(n) AS BIGINT) AS n_sides FROM straight GROUP BY 1""").replace(")\n,\nstraight", "),\nstraight"),
    "cluster_polygons": sql(RINGS, """
SELECT c.event_id, CASE WHEN geom_type = 'Point' THEN 0 ELSE CAST(n_polygons AS INTEGER) END AS n_polygons,
       CASE WHEN geom_type = 'Point' THEN 0 ELSE CAST(n_rings AS INTEGER) END AS n_rings,
       CASE WHEN geom_type = 'Point' THEN 0e0 ELSE CAST(n AS DOUBLE) END AS n_cells
FROM clusters c JOIN outlines o ON o.event_id = c.event_id
JOIN (SELECT event_id, count(*) AS n FROM foot GROUP BY 1) f ON f.event_id = c.event_id"""),
    "feature_lines_raw": sql(EVENTS, """
SELECT event_id, 'Polygon' AS geom_type, strftime(date_start, '%Y-%m-%d') AS date_start, category, 5 AS n_points,
       round(lon - h, 4) AS x, round(lat - h, 4) AS y FROM events, (SELECT min(step) / 2 AS h FROM cells)"""),
    "bubbles": sql(CLUSTERS, "SELECT event_id, centroid_lon AS x, centroid_lat AS y FROM clusters"),
    "bubbles_from_rings": sql(RINGS, """,
corners AS (
  SELECT o.event_id, o.ring, x0, y0, pos FROM on_ring o JOIN rings g ON g.event_id = o.event_id AND g.ring = o.ring AND NOT g.is_hole WHERE corner
  UNION ALL SELECT o.event_id, o.ring, x0, y0, -1 FROM on_ring o JOIN rings g ON g.event_id = o.event_id AND g.ring = o.ring AND NOT g.is_hole WHERE pos = 0
),
means AS (
  SELECT event_id, ring, count(*) AS n, avg(round(4e0 + (x0 - 0.5e0) * step, 4)) AS x, avg(round(34e0 + (y0 - 0.5e0) * step, 4)) AS y
  FROM corners, (SELECT min(step) AS step FROM cells) GROUP BY 1, 2
)
SELECT m.event_id, round(x, 6) AS x, round(y, 6) AS y FROM means m JOIN clusters c ON c.event_id = m.event_id AND c.geom_type <> 'Point'
QUALIFY row_number() OVER (PARTITION BY m.event_id ORDER BY n DESC, ring) = 1""").replace(")\n,\ncorners", "),\ncorners"),
    "agg_year": bucket("CAST(year(date_start) AS VARCHAR)"),
    "agg_category": bucket("CAST(category AS VARCHAR)", ", any_value(category_name) AS category_name"),
    "agg_country": bucket(COUNTRY),
    "agg_mpa": bucket("CASE WHEN mpa_area_km2 > 0 THEN 'events_touching_mpa' ELSE 'events_not_touching_mpa' END"),
    "category_histogram": sql(EVENTS, """
SELECT CAST(k AS INTEGER) AS category, ['I Moderate', 'II Strong', 'III Severe', 'IV Extreme', 'V Super-Extreme'][k] AS category_name,
       count(event_id) AS n
FROM (SELECT unnest(generate_series(1, 5)) AS k) LEFT JOIN events ON category = k GROUP BY k"""),
    "event_density": sql(EVENTS, "SELECT lat, lon, count(*) AS n_events FROM events GROUP BY 1, 2"),
    "intensity_histogram": sql(EVENTS, """
SELECT category, CAST(least(18, floor(intensity_max / (top / 19))) + 1 AS INTEGER) AS bin,
       round(least(18, floor(intensity_max / (top / 19))) * top / 19, 6) AS bin_from, count(*) AS n
FROM events, (SELECT max(intensity_max) + 0.5e0 AS top FROM events) WHERE intensity_max >= 0 GROUP BY 1, 2, 3"""),
    "impact_points": sql(IMPACT, "SELECT event_id, kind, count(*) AS n FROM spot_hits GROUP BY 1, 2"),
    "impact_area": sql(IMPACT, "SELECT event_id, kind, feature_id, round(km2, 4) AS km2 FROM rect_hits"),
    "impact_events": sql(IMPACT, """
SELECT c.event_id, c.n_pixels, n_aquaculture_sites, mpa_area_km2, seagrass_area_km2
FROM clusters c JOIN impact i ON i.event_id = c.event_id"""),
    "impact_raw": sql(RAW_IMPACT, "SELECT event_id, n_aquaculture_sites, mpa_area_km2, seagrass_area_km2 FROM impact"),
    "impact_totals": sql(IMPACT, f"SELECT count(*) AS n_events, {KIND_SUMS} FROM impact"),
    "impact_by_category": sql(IMPACT, f"SELECT category_name, count(*) AS n_events, {KIND_SUMS} FROM impact GROUP BY 1"),
    "impact_details": sql(IMPACT, """
SELECT c.event_id, k.kind, count(h.feature_id) AS n, coalesce(string_agg(name, ',' ORDER BY name), '') AS names
FROM clusters c CROSS JOIN (VALUES ('aquaculture'), ('mpa'), ('seagrass')) AS k(kind) LEFT JOIN (
  SELECT event_id, kind, feature_id, coalesce(code, p_name) AS name FROM rect_hits LEFT JOIN part ON feature_id = 'bed-' || p_partkey
  UNION ALL
  SELECT event_id, kind, feature_id, s_name FROM spot_hits JOIN supplier ON feature_id = 'site-' || s_suppkey) h
  ON h.event_id = c.event_id AND h.kind = k.kind GROUP BY 1, 2"""),
    "cover_area": sql(CELLS + PLACES, """
SELECT kind, feature_id, ilat, ilon, round(dx * dy, 9) AS area, round(dx * dy * mid, 9) AS moment, holds_centre
FROM (SELECT kind, feature_id, r AS ilat, c AS ilon,
             greatest(0e0, least(x0 + w, lon + s) - greatest(x0, lon - s)) AS dx,
             greatest(0e0, least(y0 + h, lat + s) - greatest(y0, lat - s)) AS dy,
             (least(y0 + h, lat + s) + greatest(y0, lat - s)) / 2 AS mid,
             lon BETWEEN x0 AND x0 + w AND lat BETWEEN y0 AND y0 + h AS holds_centre
      FROM (SELECT kind, feature_id, x0, y0, w, h FROM rects UNION ALL SELECT kind, feature_id, x, y, 0e0, 0e0 FROM spots),
           (SELECT CAST(rr AS INTEGER) AS r, CAST(cc AS INTEGER) AS c, 34e0 + rr * step AS lat, 4e0 + cc * step AS lon, step / 2 AS s
                   FROM (SELECT DISTINCT r AS rr FROM cells), (SELECT DISTINCT c AS cc FROM cells), (SELECT min(step) AS step FROM cells))
      WHERE lon - s <= x0 + w AND x0 <= lon + s AND lat - s <= y0 + h AND y0 <= lat + s)"""),
    "overlay_bbox": sql(CELLS + PLACES, """
SELECT kind, feature_id FROM (SELECT kind, feature_id, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM rects
                              UNION ALL SELECT kind, feature_id, x, y, x, y FROM spots)
WHERE x1 >= 4.75 AND x0 <= 7 AND y1 >= 34.75 AND y0 <= 37"""),
    "site_attributes": """
SELECT 'mpa-' || n_nationkey AS feature_id, upper(n_name) AS site_code, n_name AS site_name,
       CAST(n_regionkey AS VARCHAR) AS member_state, 'B' AS site_type, 1250.5e0 AS area_ha,
       CAST(NULL AS TIMESTAMP) AS release_date FROM nation""",
    "farm_exposure": sql(CLUSTERS + PLACES + FOOTPRINT + EXPOSED, FARM_ROWS),
    "expose_farms_window": sql(WINDOWED + clustering() + PLACES + FOOTPRINT + EXPOSED, FARM_ROWS),
    "agg_country_window": bucket(COUNTRY, source=WINDOWED_IMPACT),
    "detect_report_totals": sql(WINDOWED + PLACES + """,
single AS (SELECT event_id, FALSE AS is_point, lon AS clon, lat AS clat FROM events)""" + hits("events", "single"),
                                f"SELECT count(*) AS n_events, {KIND_SUMS} FROM impact"),
    "recent_events": sql(CLIM + """,
cut AS (SELECT * FROM cube WHERE dt BETWEEN DATE '2001-11-05' - 60 AND DATE '2001-11-05')""" + detection("cut"),
                         f"SELECT {EVENT_COLUMNS} FROM events"),
    "site_events": site(EVENTS, ""),
    "site_report": site(WINDOWED, """, 'NATION_7' AS site_code, (SELECT n_name FROM nation WHERE n_nationkey = 7) AS site_name,
       (SELECT CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey = 7) AS member_state, 'B' AS site_type, 1250.5e0 AS area_ha,
       DATE '1998-05-01' AS window_start, DATE '1999-04-30' AS window_end, count(*) OVER () AS n_events"""),
    "point_series": sql(CLIM, """
SELECT c.dt, round(c.lat, 4) AS lat, round(c.lon, 4) AS lon, round(sst, 3) AS sst, round(seas, 3) AS seas, round(thresh, 3) AS thresh
FROM cube c JOIN clim m ON m.lat = c.lat AND m.lon = c.lon AND m.doy = dayofyear(c.dt)
WHERE c.dt BETWEEN DATE '1998-05-01' AND DATE '1999-04-30'
  AND c.lat = (SELECT lat FROM cells ORDER BY abs(lat - 34.4e0) LIMIT 1) AND c.lon = (SELECT lon FROM cells ORDER BY abs(lon - 5.1e0) LIMIT 1)"""),
    "event_series": sql(EVENTS, """
SELECT c.dt, round(c.lat, 4) AS lat, round(c.lon, 4) AS lon, round(c.sst, 3) AS sst, round(seas, 3) AS seas, round(thresh, 3) AS thresh
FROM cube c JOIN clim m ON m.lat = c.lat AND m.lon = c.lon AND m.doy = dayofyear(c.dt), events e
WHERE e.event_id = 'mhw-000007' AND c.dt BETWEEN e.date_start - 30 AND e.date_end + 30 AND c.lat = 34e0 AND c.lon = 4e0"""),
    "compound_cells": sql(COMPOUND, "SELECT * FROM per_cell"),
    "compound_totals": sql(COMPOUND, """
SELECT CAST(sum(hot_days) AS BIGINT) AS hot_pixel_days, CAST(sum(fresh_days) AS BIGINT) AS fresh_pixel_days,
       CAST(sum(compound_days) AS BIGINT) AS compound_pixel_days,
       coalesce(round(100e0 * sum(compound_days) / nullif(sum(hot_days), 0), 2), 0e0) AS compound_share_of_heat,
       count(*) FILTER (WHERE compound_days > 0) AS compound_affected_pixels, max(compound_days) AS longest_run_days FROM per_cell"""),
    "compound_classes": sql(COMPOUND, """
SELECT lo, hi, count(compound_days) AS count FROM (VALUES (1, 5), (6, 10), (11, 20), (21, 40)) AS b(lo, hi)
LEFT JOIN per_cell ON compound_days BETWEEN lo AND hi GROUP BY 1, 2"""),
    "ellipse_class_shares": shares(["low", "medium", "high"], rate=True),
    "vulnerability_score": shares(
        ["rock", "sand", "mud", "biogenic"],
        score=", round(share_rock * 0.7e0 + share_sand * 0.3e0 + share_mud * 0.1e0 + share_biogenic * 1e0, 3) AS score"),
    "basin_shares": sql(CELLS + PLACES, "SELECT " + ", ".join(
        f"round(count(*) FILTER (WHERE class = '{c}') / CAST(count(*) AS DOUBLE), 3) AS share_{c}"
        for c in ("rock", "sand", "mud", "biogenic")) + " FROM class_cells"),
    "rate_range": sql(CELLS + PLACES, """
SELECT round(min(rate), 2) AS rate_min, round(max(rate), 2) AS rate_max, round(quantile_cont(rate, 0.5), 2) AS rate_median FROM class_cells"""),
    "coast_buffer": sql(BUFFER, "SELECT * FROM buffered"),
    "coast_summary": sql(BUFFER, """
SELECT count(*) AS n_events, round(avg(eroding_fraction), 3) AS mean_eroding_fraction,
       round(max(eroding_fraction), 3) AS max_eroding_fraction, count(*) FILTER (WHERE eroding_fraction >= 0.3) AS events_above_30pct
FROM buffered"""),
    "coast_totals": sql(CELLS + PLACES, """
SELECT round(sum(length_km), 1) AS coast_total_km, round(sum(length_km) FILTER (WHERE class = 'eroding'), 1) AS coast_eroding_km,
       round(100e0 * sum(length_km) FILTER (WHERE class = 'eroding') / sum(length_km), 1) AS coast_eroding_pct FROM coast"""),
    # A day is taken once it lies 8 days before the last one seen. An event is over when the first day on which a
    # run could still begin, the first of an open run or the day after the last one taken, is over 2 days behind it.
    "stream_closed_events": sql(CLIM + """,
cut AS (SELECT * FROM cube WHERE dt <= (SELECT max(dt) - 8 FROM cube))""" + detection("cut") + """,
tails AS (SELECT lat, lon, coalesce(max(dt) FILTER (WHERE NOT hot) + 1, min(dt)) AS earliest FROM series GROUP BY 1, 2)""", """
SELECT e.lat, e.lon, date_start, date_end, date_peak, duration_days, intensity_max, intensity_mean, intensity_cumulative, category, category_name
FROM events e JOIN tails t ON t.lat = e.lat AND t.lon = e.lon WHERE date_diff('day', date_end, earliest) - 1 > 2"""),
}
# One day or one cell is picked from tables that are made once, so that no planner moves the pick into the statistics.
for _name in ("anomaly_day", "anomaly_csv", "point_series", "event_series"):
    for _table in ("cube", "pooled", "clim", "events"):
        ORACLE[_name] = ORACLE[_name].replace(f"\n{_table} AS (", f"\n{_table} AS MATERIALIZED (")
ORACLE["append_twice"] = ORACLE["stream_append"] = ORACLE["slab_merge"]
