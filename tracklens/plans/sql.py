"""Reference formulations in plain SQL, written the direct way so they test the Spark plans."""

REPORTS = """reports AS (
 SELECT 'AP1' AS airport_id, concat('S', event_id % 3) AS source_file_id,
  CAST(CAST(ts AS DATE) AS VARCHAR) AS source_day,
  concat('A', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS aircraft_id, epoch_us(ts) AS timestamp_us,
  CAST(40.7765833333 AS DOUBLE) + CAST((event_id*7919 + user_id*31) % 2001 - 1000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lat_deg,
  CAST(-79.9510833333 AS DOUBLE) + CAST((event_id*104729 + user_id*17) % 2601 - 1300 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lon_deg,
  CAST(500 + (event_id*31 + user_id*101) % 1200 AS DOUBLE) AS altitude_m,
  CAST(40 + event_id % 50 AS DOUBLE) AS speed_mps, radians(CAST((event_id*37) % 360 AS DOUBLE)) AS heading_rad,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS age_s, event_id
 FROM events)"""

LINES = """lines AS (
 SELECT l_orderkey AS k1, CAST(l_linenumber AS BIGINT) AS k2,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_orderkey % 50 - 20 + CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 5 ELSE 0 END AS DOUBLE) END AS age_s,
  CAST(l_orderkey % 180 - 90 + CASE WHEN l_partkey % 4 = 0 THEN l_suppkey % 7 ELSE 0 END AS DOUBLE) AS lat_deg,
  CAST(l_orderkey % 360 - 180 AS DOUBLE) AS lon_deg,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_linenumber * 100 AS DOUBLE) END AS altitude_m,
  CAST(l_orderkey % 90 AS DOUBLE) AS speed_mps,
  CASE WHEN l_orderkey % 5 = 0 THEN l_returnflag ELSE 'T' END AS tail,
  l_partkey AS s1, l_suppkey AS s2, l_quantity AS s3, l_extendedprice AS s4
 FROM lineitem)"""

STEP, STALE, HISTORY = 600_000_000, 1_800_000_000, 12
HORIZONS = (1_800_000_000, 7_200_000_000, 18_000_000_000)
SCALE_S = 60_000_000

TICKS = REPORTS + f""", bounds AS (
 SELECT airport_id, source_day, min(timestamp_us) AS t0, max(timestamp_us) AS t1 FROM reports GROUP BY ALL),
grid AS (
 SELECT airport_id, source_day, t0, t1, unnest(range(0, (t1 - t0) // {STEP} + 1)) AS k FROM bounds),
ticks AS (
 SELECT g.airport_id, g.source_day, g.k, g.t0, g.t1, g.t0 + g.k * {STEP} AS t, r.aircraft_id, r.timestamp_us, r.source_file_id,
  r.lat_deg, r.lon_deg, r.altitude_m, r.speed_mps, r.heading_rad
 FROM grid g JOIN reports r ON r.airport_id = g.airport_id AND r.source_day = g.source_day
  AND r.timestamp_us <= g.t0 + g.k * {STEP} AND r.timestamp_us >= g.t0 + g.k * {STEP} - {STALE}
 QUALIFY row_number() OVER (PARTITION BY g.airport_id, g.source_day, g.k, r.aircraft_id
  ORDER BY r.timestamp_us DESC, r.source_file_id DESC) = 1)"""


def hav(a: str, b: str) -> str:
    return (
        f"(2.0 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians({b}.lat_deg) - radians({a}.lat_deg)) / 2), 2)"
        f" + cos(radians({a}.lat_deg)) * cos(radians({b}.lat_deg)) * pow(sin(radians({b}.lon_deg - {a}.lon_deg) / 2), 2)))))"
    )


PAIRS = TICKS + f""", pairs AS (
 SELECT a.airport_id, a.source_day, a.k, a.t, a.aircraft_id AS a_id, b.aircraft_id AS b_id,
  least(a.timestamp_us, b.timestamp_us) AS older_us, {hav('a', 'b')} AS h_m, abs(a.altitude_m - b.altitude_m) AS v_m
 FROM ticks a JOIN ticks b ON a.airport_id = b.airport_id AND a.source_day = b.source_day AND a.k = b.k
  AND a.aircraft_id < b.aircraft_id),
act AS (SELECT * FROM pairs WHERE h_m < 9260.0 AND v_m < 304.8)"""

SCENES = f""", counts AS (
 SELECT airport_id, source_day, k, any_value(t) AS t, any_value(t1) AS t1, count(*) AS n_aircraft FROM ticks GROUP BY ALL),
scenes AS (
 SELECT airport_id, source_day, k AS c, t AS cutoff_us, n_aircraft FROM counts
 WHERE k >= {HISTORY - 1} AND t <= t1 - {max(HORIZONS)} AND n_aircraft >= 3),
hz AS (SELECT unnest([{', '.join(str(h) for h in HORIZONS)}]) AS horizon_us)"""

# Every cutoff looks at every later tick of its horizon, as the definition says.
TARGETS = PAIRS + SCENES + f""", seen AS (
 SELECT s.airport_id, s.source_day, s.c, p.k, p.a_id, p.b_id FROM scenes s JOIN act p
  ON p.airport_id = s.airport_id AND p.source_day = s.source_day AND p.k > s.c
  AND p.k <= s.c + {max(HORIZONS) // STEP} AND p.older_us > s.cutoff_us),
started AS (
 SELECT x.airport_id, x.source_day, x.c, x.k,
  count(*) FILTER (WHERE y.k IS NULL) AS legacy,
  count(*) FILTER (WHERE y.k IS NULL AND z.k IS NULL) AS onset
 FROM seen x
 LEFT JOIN seen y ON y.airport_id = x.airport_id AND y.source_day = x.source_day AND y.c = x.c AND y.a_id = x.a_id
  AND y.b_id = x.b_id AND y.k = x.k - 1
 LEFT JOIN act z ON x.k = x.c + 1 AND z.airport_id = x.airport_id AND z.source_day = x.source_day AND z.k = x.c
  AND z.a_id = x.a_id AND z.b_id = x.b_id
 GROUP BY ALL),
now_active AS (SELECT airport_id, source_day, k, count(*) AS n FROM act GROUP BY ALL),
events_h AS (
 SELECT s.airport_id, s.source_day, s.c, hz.horizon_us, coalesce(sum(legacy), 0) AS legacy, coalesce(sum(onset), 0) AS onset
 FROM scenes s CROSS JOIN hz LEFT JOIN started e ON e.airport_id = s.airport_id AND e.source_day = s.source_day
  AND e.c = s.c AND e.k <= s.c + hz.horizon_us // {STEP} GROUP BY ALL),
seps AS (
 SELECT s.airport_id, s.source_day, s.c, hz.horizon_us, min(p.h_m) AS h_m, min(p.v_m) AS v_m
 FROM scenes s CROSS JOIN hz JOIN pairs p ON p.airport_id = s.airport_id AND p.source_day = s.source_day AND p.k > s.c
  AND p.k <= s.c + hz.horizon_us // {STEP} AND p.older_us > s.cutoff_us GROUP BY ALL),
targets AS (
 SELECT s.airport_id, s.source_day, s.c AS k, s.cutoff_us, s.n_aircraft, e.horizon_us, e.horizon_us // {SCALE_S} AS horizon_s,
  coalesce(n.n, 0) AS cutoff_active, e.legacy AS legacy_events, e.onset AS onset_events, m.h_m, m.v_m
 FROM scenes s JOIN events_h e ON e.airport_id = s.airport_id AND e.source_day = s.source_day AND e.c = s.c
 LEFT JOIN now_active n ON n.airport_id = s.airport_id AND n.source_day = s.source_day AND n.k = s.c
 LEFT JOIN seps m ON m.airport_id = s.airport_id AND m.source_day = s.source_day AND m.c = s.c AND m.horizon_us = e.horizon_us)"""
