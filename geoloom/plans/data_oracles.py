"""DuckDB statements for the queries of `data_queries` that SQL can express."""

_NUMBER = r"[-+]?[0-9]*\.?[0-9]+"
_HAVERSINE = (
    "2*6371000.0*asin(least(1.0, sqrt(pow(sin(radians(p.lat-s.lat)/2),2)"
    "+cos(radians(s.lat))*cos(radians(p.lat))*pow(sin(radians(p.lon-s.lon)/2),2))))"
)

P4_FOUND = rf"""
WITH s AS (SELECT feed_id, stop_id, min(stop_lat) AS lat, min(stop_lon) AS lon FROM gtfs_stops GROUP BY ALL),
g AS (SELECT id, min(centroid) AS centroid, min(CASE WHEN geom_type = 'area' THEN geom END) AS geom FROM geo_places GROUP BY id),
p AS (
  SELECT id, TRY_CAST(regexp_extract(centroid, 'POINT *\( *({_NUMBER}) +({_NUMBER})', 1) AS DOUBLE) AS lon,
         TRY_CAST(regexp_extract(centroid, 'POINT *\( *({_NUMBER}) +({_NUMBER})', 2) AS DOUBLE) AS lat FROM g),
r AS (
  SELECT id, ring_no, ring FROM (
    SELECT id, unnest(regexp_extract_all(geom, '\(([^()]+)\)', 1)) AS ring,
           generate_subscripts(regexp_extract_all(geom, '\(([^()]+)\)', 1), 1) AS ring_no FROM g WHERE geom LIKE '%POLYGON%(%')),
xy AS (
  SELECT id, ring_no, generate_subscripts(regexp_extract_all(ring, '({_NUMBER}) +({_NUMBER})', 1), 1) AS k,
         unnest(regexp_extract_all(ring, '({_NUMBER}) +({_NUMBER})', 1))::DOUBLE AS x,
         unnest(regexp_extract_all(ring, '({_NUMBER}) +({_NUMBER})', 2))::DOUBLE AS y FROM r),
e AS (
  SELECT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM xy a JOIN xy b ON a.id = b.id AND a.ring_no = b.ring_no AND b.k = a.k + 1),
inner_ AS (
  SELECT s.feed_id, s.stop_id, e.id FROM s JOIN e ON (e.y1 > s.lat) <> (e.y2 > s.lat)
   AND s.lon < (e.x2-e.x1)*(s.lat-e.y1)/(e.y2-e.y1)+e.x1
  GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT 'near' AS rel, s.feed_id, s.stop_id, p.id AS place_id FROM s JOIN p
  ON p.lat BETWEEN s.lat - 0.001 AND s.lat + 0.001 AND {_HAVERSINE} <= 80
UNION ALL SELECT 'inside', feed_id, stop_id, id FROM inner_
"""

_LINKS = r"""
links AS (
  SELECT tab, scope, node_id, min(parent_id) AS parent_id FROM (
    SELECT 'gtfs_stops' AS tab, feed_id AS scope, stop_id AS node_id,
           nullif(regexp_replace(parent_station, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'), '') AS parent_id
    FROM gtfs_stops WHERE feed_id IS NOT NULL AND stop_id IS NOT NULL
    UNION ALL
    SELECT 'boundary_catalog', '', id, nullif(regexp_replace(parent, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'), '')
    FROM boundary_catalog WHERE id IS NOT NULL) GROUP BY ALL),
up AS (
  SELECT tab, scope, node_id, node_id AS cur, 0 AS depth, [node_id] AS path FROM links
  UNION ALL
  SELECT u.tab, u.scope, u.node_id, l.parent_id, u.depth + 1, list_append(u.path, l.parent_id)
  FROM up u JOIN links l ON l.tab = u.tab AND l.scope = u.scope AND l.node_id = u.cur
  JOIN links p ON p.tab = u.tab AND p.scope = u.scope AND p.node_id = l.parent_id
  WHERE NOT list_contains(u.path, l.parent_id)),
last_ AS (SELECT tab, scope, node_id, max_by(cur, depth) AS cur, max(depth) AS depth, max_by(path, depth) AS path FROM up GROUP BY ALL),
solved AS (
  SELECT x.tab, x.scope, x.node_id, l.parent_id, p.node_id IS NOT NULL AS endless, x.cur, x.depth, x.path
  FROM last_ x JOIN links l USING (tab, scope, node_id)
  JOIN links c ON c.tab = x.tab AND c.scope = x.scope AND c.node_id = x.cur
  LEFT JOIN links p ON p.tab = x.tab AND p.scope = x.scope AND p.node_id = c.parent_id)
"""

P6_FOUND = f"""
WITH RECURSIVE {_LINKS}
SELECT tab, scope, node_id, CASE WHEN endless THEN '-' ELSE cur END AS root_id,
       CASE WHEN endless THEN -1 ELSE depth END AS depth
FROM solved WHERE parent_id IS NOT NULL
"""

P6_PATHS = f"""
WITH RECURSIVE {_LINKS}
SELECT tab, scope, node_id, CASE WHEN endless THEN '-' ELSE cur END AS root_id,
       CASE WHEN endless THEN -1 ELSE depth END AS depth,
       CASE WHEN endless THEN '' ELSE array_to_string(list_reverse(path), ' > ') END AS path
FROM solved
"""

P6_DESCENDANTS = f"""
WITH RECURSIVE {_LINKS},
pieces AS (SELECT tab, scope, node_id, unnest(path) AS ancestor_id, generate_subscripts(path, 1) - 1 AS distance FROM solved WHERE NOT endless)
SELECT tab, scope, ancestor_id, node_id, distance::INTEGER AS distance FROM pieces WHERE distance > 0
"""

_TOTALS = """
counters AS (
  SELECT user_id, api_key_id, day, endpoint, max(row(updated_at, coalesce(requests, 0), coalesce(credits, 0))) AS v
  FROM accounts_usage WHERE user_id IS NOT NULL AND day IS NOT NULL GROUP BY 1, 2, 3, 4),
daily AS (SELECT user_id, day, sum(v[2])::BIGINT AS requests, sum(v[3])::BIGINT AS credits FROM counters GROUP BY 1, 2),
grid AS (
  SELECT user_id, d::DATE AS day FROM (SELECT DISTINCT user_id FROM daily),
  generate_series(DATE '2025-01-01', DATE '2025-06-30', INTERVAL 1 DAY) AS t(d)),
filled AS (
  SELECT user_id, day, coalesce(requests, 0) AS requests, coalesce(credits, 0) AS credits
  FROM grid LEFT JOIN daily USING (user_id, day)),
totals AS (
  SELECT user_id, day,
    sum(requests) OVER w7 AS requests_7, sum(requests) OVER w30 AS requests_30,
    sum(credits) OVER w7 AS credits_7, sum(credits) OVER w30 AS credits_30
  FROM filled WINDOW
    w7 AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
    w30 AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""

P7_FOUND = f"""
WITH {_TOTALS}
SELECT user_id, strftime(day, '%Y-%m-%d') AS day FROM totals
WHERE day >= DATE '2025-02-01' AND credits_7 > 0 AND 10 * credits_7 > 7 * credits_30 AND requests_30 >= 200
"""

P7_TOTALS = f"""
WITH {_TOTALS}
SELECT user_id, strftime(day, '%Y-%m-%d') AS day,
  requests_7::BIGINT AS requests_7, requests_30::BIGINT AS requests_30, credits_7::BIGINT AS credits_7, credits_30::BIGINT AS credits_30,
  round(requests_7 / 7.0::DOUBLE, 4) AS avg_requests_7, round(requests_30 / 30.0::DOUBLE, 4) AS avg_requests_30,
  round(credits_7 / 7.0::DOUBLE, 4) AS avg_credits_7, round(credits_30 / 30.0::DOUBLE, 4) AS avg_credits_30
FROM totals WHERE day >= DATE '2025-02-01'
"""

ORACLES = {
    "p4_found": P4_FOUND, "p6_found": P6_FOUND, "p6_paths": P6_PATHS, "p6_descendants": P6_DESCENDANTS,
    "p7_found": P7_FOUND, "p7_totals": P7_TOTALS,
}
