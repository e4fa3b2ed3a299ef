"""Queries of public transport. Stops are the table's own; trips, calls and live rows are read from orders, lineitem and
events by fixed arithmetic, which the SQL repeats."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions import tags as tag
from geoloom.functions.geo import haversine_m, point_of
from geoloom.functions.polyline import polyline_points
from geoloom.operators import transit as t
from geoloom.plans.places import P, places
from geoloom.plans.search import HAV, LAT, LON
from geoloom.operators.search import contains
from geoloom.util import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def stops(spark, sf_dir):
    return t.clean_stops(table(spark, sf_dir, "gtfs_stops"))


S = """s AS (SELECT feed_id, stop_id, min(nullif(trim(stop_name, ' '), '')) AS stop_name, min(stop_lat) AS lat, min(stop_lon) AS lon, coalesce(max(location_type), 0) AS location_type,
  min(nullif(trim(parent_station, ' '), '')) AS parent_station, coalesce(max(wheelchair_boarding), 0) AS wheelchair_boarding
  FROM gtfs_stops WHERE feed_id IS NOT NULL AND stop_id IS NOT NULL AND stop_lat IS NOT NULL AND stop_lon IS NOT NULL GROUP BY 1, 2)"""


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"2*6371000.0*asin(least(1.0, sqrt(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2))))"


@query(f"WITH {S} SELECT * FROM s")
def stop_parse(spark, sf_dir):
    return stops(spark, sf_dir)


@query(f"WITH {S} SELECT feed_id, stop_id, stop_name, round({HAV}, 1) AS distance_m FROM s WHERE {HAV} <= 1000 ORDER BY round({HAV}, 6), feed_id, stop_id LIMIT 20")
def nearby_stops(spark, sf_dir):
    d = haversine_m("lat", "lon", LAT, LON)
    out = stops(spark, sf_dir).where(t.planar_order(LAT, LON) < 0.05).where(d <= 1000).withColumn("d", F.round(d, 6)).orderBy("d", "feed_id", "stop_id").limit(20)
    return out.select("feed_id", "stop_id", "stop_name", F.round("d", 1).alias("distance_m"))


@query(f"""WITH {S}, f AS (SELECT * FROM s WHERE location_type = 0) SELECT a.feed_id AS feed_a, a.stop_id AS stop_a, b.feed_id AS feed_b, b.stop_id AS stop_b, round({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 1) AS distance_m
FROM f a JOIN f b ON (a.feed_id, a.stop_id) < (b.feed_id, b.stop_id) AND b.lat BETWEEN a.lat - 0.006 AND a.lat + 0.006 AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 500""")
def transfer_pairs(spark, sf_dir):
    out = t.transfer_pairs(stops(spark, sf_dir))
    return out.select(F.col("a.feed_id").alias("feed_a"), F.col("a.stop_id").alias("stop_a"), F.col("b.feed_id").alias("feed_b"), F.col("b.stop_id").alias("stop_b"), F.round("distance_m", 1).alias("distance_m"))


def _anchors(spark, sf_dir):
    """Ways in: bus stops and station places rank as the anchors' kinds."""
    at, g = point_of("centroid"), F.col("tags")
    rank = F.when(g["railway"] == "station", 0).when(g["public_transport"].isNotNull(), 1).when(g["highway"] == "bus_stop", 2)
    return places(spark, sf_dir).select("id", at["lat"].alias("lat"), at["lon"].alias("lon"), rank.alias("rank")).where("rank is not null and lat is not null")


A = "a AS (SELECT id, lat, lon, CASE WHEN tags['railway'] = 'station' THEN 0 WHEN tags['public_transport'] IS NOT NULL THEN 1 ELSE 2 END AS rank FROM p WHERE lat IS NOT NULL AND (tags['railway'] = 'station' OR tags['public_transport'] IS NOT NULL OR tags['highway'] = 'bus_stop'))"


@query(f"""WITH {P}, {S}, {A} SELECT s.feed_id, s.stop_id, a.id, round({hav('s.lat', 's.lon', 'a.lat', 'a.lon')}, 1) AS distance_m FROM s JOIN a ON s.location_type = 1 AND a.lat BETWEEN s.lat - 0.003 AND s.lat + 0.003 AND {hav('s.lat', 's.lon', 'a.lat', 'a.lon')} <= 250""")
def station_entrances(spark, sf_dir):
    points = stops(spark, sf_dir).where("location_type = 1").select(F.struct("feed_id", "stop_id").alias("key"), "lat", "lon")
    out = t.near_join(points, _anchors(spark, sf_dir), 250.0)
    return out.select(F.col("a.feed_id").alias("feed_id"), F.col("a.stop_id").alias("stop_id"), F.col("b").alias("id"), F.round("distance_m", 1).alias("distance_m"))


@query(f"""WITH {P}, {S}, {A}, d AS (SELECT s.feed_id, s.stop_id, a.id, a.rank, round({hav('s.lat', 's.lon', 'a.lat', 'a.lon')}, 3) AS d FROM s JOIN a ON s.location_type = 0 AND a.lat BETWEEN s.lat - 0.003 AND s.lat + 0.003 AND {hav('s.lat', 's.lon', 'a.lat', 'a.lon')} <= 250)
SELECT feed_id, stop_id, id, rank, round(d, 1) AS distance_m FROM d QUALIFY row_number() OVER (PARTITION BY feed_id, stop_id ORDER BY d, rank, id) = 1""")
def nearest_anchor(spark, sf_dir):
    points = stops(spark, sf_dir).where("location_type = 0").select(F.struct("feed_id", "stop_id").alias("key"), "lat", "lon")
    out = t.nearest_anchor(points, _anchors(spark, sf_dir))
    return out.select(F.col("a.feed_id").alias("feed_id"), F.col("a.stop_id").alias("stop_id"), F.col("b").alias("id"), "rank", F.round("distance_m", 1).alias("distance_m"))


_SEG = "greatest(0.0, least(1.0, CASE WHEN (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) = 0 THEN 0.0 ELSE ((s.lon-x1)*(x2-x1)+(s.lat-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) END))"


@query(rf"""WITH {P}, {S}, b AS (SELECT id, geom FROM p WHERE geom_type = 'area' AND (tags['building'] = 'train_station' OR tags['public_transport'] = 'station' OR tags['railway'] = 'station') AND geom LIKE '%POLYGON%'),
r AS (SELECT id, unnest(regexp_extract_all(geom, '\(([^()]+)\)', 1)) AS ring, generate_subscripts(regexp_extract_all(geom, '\(([^()]+)\)', 1), 1) AS k FROM b),
v AS (SELECT id, k, unnest(regexp_extract_all(ring, '([-0-9.]+) +([-0-9.]+)', 1))::DOUBLE AS x, unnest(regexp_extract_all(ring, '([-0-9.]+) +([-0-9.]+)', 2))::DOUBLE AS y, generate_subscripts(regexp_extract_all(ring, '([-0-9.]+) +([-0-9.]+)', 1), 1) AS i FROM r),
e AS (SELECT a.id, a.x AS x1, a.y AS y1, c.x AS x2, c.y AS y2 FROM v a JOIN v c ON a.id = c.id AND a.k = c.k AND c.i = a.i + 1),
m AS (SELECT s.feed_id, s.stop_id, e.id, count(*) FILTER (WHERE (y1 > s.lat) <> (y2 > s.lat) AND s.lon < (x2-x1)*(s.lat-y1)/(CASE WHEN y2 = y1 THEN 1 ELSE y2-y1 END)+x1) % 2 = 1 AS inside,
  min({hav('s.lat', 's.lon', f'(y1+{_SEG}*(y2-y1))', f'(x1+{_SEG}*(x2-x1))')}) AS d FROM s JOIN e ON s.location_type = 1 GROUP BY ALL)
SELECT feed_id, stop_id, id, inside, round(d, 1) AS side_m FROM m WHERE inside OR d <= 100""")
def station_buildings(spark, sf_dir):
    """Stations and the station areas that contain them or lie within 100 m: by cells of the areas' grown boxes."""
    g = F.col("tags")
    is_ = (g["building"] == "train_station") | (g["public_transport"] == "station") | (g["railway"] == "station")
    areas = places(spark, sf_dir).where((F.col("geom_type") == "area") & is_ & F.col("geom").rlike("(?i)POLYGON")).select("id", "geom")
    xs, ys = (F.regexp_extract_all("geom", F.lit(r"([-0-9.]+) +([-0-9.]+)"), F.lit(k)).cast("array<double>") for k in (1, 2))
    d, size = 0.0012, 0.01
    boxed = areas.select("id", "geom", (F.array_min(xs) - d).alias("w"), (F.array_max(xs) + d).alias("e"), (F.array_min(ys) - d).alias("s"), (F.array_max(ys) + d).alias("n"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    boxed = boxed.select("*", cells("w", "e").alias("cx")).select("*", cells("s", "n").alias("cy"))
    points = stops(spark, sf_dir).where("location_type = 1").select("feed_id", "stop_id", "lat", "lon", F.floor(F.col("lon") / size).alias("cx"), F.floor(F.col("lat") / size).alias("cy"))
    both = points.join(boxed, ["cx", "cy"]).where("lon between w and e and lat between s and n")
    both = both.withColumns({"inside": contains("geom", F.col("lat"), F.col("lon")), "side": t.region_distance_m("geom", "lat", "lon")})
    return both.where((F.col("inside")) | (F.col("side") <= 100)).select("feed_id", "stop_id", "id", "inside", F.round("side", 1).alias("side_m"))


@query(f"""WITH {P}, pf AS (SELECT lat, lon FROM p WHERE tags['public_transport'] = 'platform' OR tags['railway'] = 'platform'),
c AS (SELECT id, name, coalesce(tags['wheelchair'], '') AS wheelchair, tags['highway'] AS h, tags['railway'] AS rw, lat, lon, round({HAV}, 3) AS d FROM p WHERE lat BETWEEN {LAT}-3000/111000.0 AND {LAT}+3000/111000.0 AND lon BETWEEN {LON}-3000/111000.0 AND {LON}+3000/111000.0),
x AS (SELECT id, name, wheelchair, rw AS access_type, d, 1 AS tier FROM c WHERE rw IN ('subway_entrance', 'train_station_entrance')
 UNION ALL SELECT id, name, wheelchair, 'railway_crossing', d, 4 FROM c WHERE rw = 'crossing'
 UNION ALL SELECT id, name, wheelchair, 'highway_crossing', d, 5 FROM c WHERE h = 'crossing' AND lat BETWEEN {LAT}-1200/111000.0 AND {LAT}+1200/111000.0 AND lon BETWEEN {LON}-1200/111000.0 AND {LON}+1200/111000.0
   AND EXISTS (SELECT 1 FROM pf WHERE abs(pf.lat - c.lat) <= 0.001 AND abs(pf.lon - c.lon) <= 0.001))
SELECT id, name, wheelchair, access_type, tier, round(d, 1) AS distance_m FROM x ORDER BY tier, d, id LIMIT 1""")
def entrance_tiers(spark, sf_dir):
    at = point_of("centroid")
    df = places(spark, sf_dir).withColumns({"lat": at["lat"], "lon": at["lon"]})
    return t.nearest_entrance(df, LAT, LON, 3000.0).select("id", "name", "wheelchair", "access_type", "tier", F.round("distance_m", 1).alias("distance_m"))


def trips(spark, sf_dir):
    o = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trip_id"), (o % 50).cast("string").alias("route_id"), (F.col("o_orderkey") % 2).alias("direction_id"),
        F.concat(F.lit("sh"), (F.col("o_orderkey") * 7 % 5).cast("string")).alias("shape_id"), F.when(o % 50 < 10, 1).when(o % 50 < 30, F.col("o_orderkey") % 3).otherwise(0).alias("bikes_allowed"),
    )


def calls(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("stop_id"), F.struct("l_suppkey", "l_partkey", "l_quantity").alias("tie"),
        F.expr("l_suppkey div 2").alias("station"), F.col("l_shipdate").cast("timestamp").alias("scheduled"),
    )


T = "t AS (SELECT o_orderkey AS trip_id, (o_custkey % 50)::VARCHAR AS route_id, o_orderkey % 2 AS direction_id, 'sh' || (o_orderkey * 7 % 5) AS shape_id, CASE WHEN o_custkey % 50 < 10 THEN 1 WHEN o_custkey % 50 < 30 THEN o_orderkey % 3 ELSE 0 END AS bikes_allowed FROM orders)"
C = "c AS (SELECT l_orderkey AS trip_id, l_linenumber AS seq, l_suppkey AS stop_id, l_partkey, l_quantity, l_suppkey // 2 AS station, l_shipdate AS scheduled FROM lineitem)"


@query(f"WITH {T}, {C} SELECT DISTINCT stop_id, route_id FROM t JOIN c USING (trip_id)")
def stop_routes(spark, sf_dir):
    return t.stop_times_of(trips(spark, sf_dir).select("trip_id", "route_id"), calls(spark, sf_dir).select("trip_id", "stop_id")).select("stop_id", "route_id").distinct()


_PATTERNS = f"""{T}, {C}, o AS (SELECT t.trip_id, route_id, direction_id, list(station ORDER BY seq, stop_id, l_partkey, l_quantity) AS l FROM t JOIN c USING (trip_id) GROUP BY ALL),
pat AS (SELECT DISTINCT route_id, direction_id, ',' || array_to_string(list_filter(l, lambda x, i: i = 1 OR l[i - 1] <> x), ',') || ',' AS stop_seq FROM o)"""


def _patterns(spark, sf_dir):
    joined = t.stop_times_of(trips(spark, sf_dir).select("trip_id", "route_id", "direction_id"), calls(spark, sf_dir))
    return t.trip_patterns(joined)


@query(f"WITH {_PATTERNS} SELECT * FROM pat")
def trip_patterns(spark, sf_dir):
    return _patterns(spark, sf_dir)


@query(f"WITH {_PATTERNS} SELECT DISTINCT route_id, direction_id FROM pat WHERE contains(stop_seq, ',3,')")
def stop_sequence_match(spark, sf_dir):
    return _patterns(spark, sf_dir).where(F.col("stop_seq").contains(",3,")).select("route_id", "direction_id").distinct()


@query(f"WITH {T} SELECT route_id, shape_id, n FROM (SELECT route_id, shape_id, count(*) AS n, min(trip_id) AS f FROM t GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY n DESC, f) = 1")
def route_canonical_shape(spark, sf_dir):
    return t.canonical_shape(trips(spark, sf_dir).withColumn("seen", F.col("trip_id")))


@query(f"WITH {T} SELECT route_id, CASE WHEN count(*) FILTER (WHERE bikes_allowed = 1) = 0 THEN 0 WHEN count(*) FILTER (WHERE bikes_allowed = 1) = count(*) THEN 2 ELSE 1 END AS bikes FROM t GROUP BY 1")
def bikes_allowed(spark, sf_dir):
    return t.bikes_allowed(trips(spark, sf_dir))


@query("""WITH st AS (SELECT s_suppkey AS stop, s_suppkey // 2 AS station FROM supplier), tr AS (SELECT s_suppkey AS a, (s_suppkey * 7 + 1) % 50 AS b FROM supplier),
l AS (SELECT a, b FROM tr UNION ALL SELECT b, a FROM tr), h AS (SELECT x.station, y.station AS far FROM st x JOIN l ON x.stop = l.a JOIN st y ON y.stop = l.b),
r AS (SELECT station, station AS far FROM st UNION SELECT * FROM h) SELECT DISTINCT x.stop, m.stop AS member FROM st x JOIN r USING (station) JOIN st m ON m.station = r.far""")
def station_complex(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("stop"), F.expr("s_suppkey div 2").alias("station"))
    links = s.select(F.col("stop").alias("a"), ((F.col("stop") * 7 + 1) % 50).alias("b"))
    return t.station_complex(s, links)


@query(f"""WITH {S}, ty AS (SELECT feed_id, stop_id, min(CASE WHEN location_type = 1 THEN 1 ELSE 3 END) AS route_type FROM gtfs_stops GROUP BY 1, 2),
n AS (SELECT s.*, route_type, round({HAV}, 3) AS d FROM s LEFT JOIN ty USING (feed_id, stop_id) WHERE round({HAV}, 3) <= 2000), o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY stop_name ORDER BY d, feed_id, stop_id) = 1)
SELECT feed_id, stop_id, stop_name, route_type, round(d, 1) AS distance_m FROM o ORDER BY coalesce(route_type, 3) = 3, d, feed_id, stop_id LIMIT 12""")
def boarding_stations(spark, sf_dir):
    types = table(spark, sf_dir, "gtfs_stops").select("feed_id", "stop_id", F.when(F.col("location_type") == 1, 1).otherwise(3).alias("route_type"))
    out = t.boarding_stations(stops(spark, sf_dir), types, LAT, LON, 2000.0, 12)
    return out.select("feed_id", "stop_id", "stop_name", "route_type", F.round("distance_m", 1).alias("distance_m"))


@query(f"""WITH {T}, {C}, d AS (SELECT stop_id, route_id, trip_id, scheduled, CASE WHEN trip_id % 3 = 0 THEN scheduled + INTERVAL (trip_id % 900 - 300) SECOND END AS actual FROM t JOIN c USING (trip_id)),
k AS (SELECT *, coalesce(actual, scheduled) AS departure FROM d WHERE coalesce(actual, scheduled) >= TIMESTAMP '1999-01-01')
SELECT stop_id, trip_id, route_id, departure::VARCHAR AS departure, CASE WHEN actual IS NOT NULL THEN epoch(actual)::BIGINT - epoch(scheduled)::BIGINT END AS delay_s, row_number() OVER (PARTITION BY stop_id ORDER BY departure, route_id, trip_id)::INTEGER AS pos FROM k QUALIFY pos <= 5""")
def departures_board(spark, sf_dir):
    rows = t.stop_times_of(trips(spark, sf_dir).select("trip_id", "route_id"), calls(spark, sf_dir).select("trip_id", "stop_id", "scheduled"))
    actual = F.when(F.col("trip_id") % 3 == 0, F.timestamp_micros(F.unix_micros("scheduled") + (F.col("trip_id") % 900 - 300) * 1_000_000))
    out = t.departures(rows.withColumn("actual", actual), F.to_timestamp(F.lit("1999-01-01 00:00:00")), 5)
    return out.select("stop_id", "trip_id", "route_id", F.date_format("departure", "yyyy-MM-dd HH:mm:ss").alias("departure"), "delay_s", "pos")


_LINE = [(-55.32, 25.08), (-55.30, 25.10), (-55.28, 25.10), (-55.27, 25.12)]


def _along_sql() -> str:
    parts, done = [], "0.0"
    for k, (a, b) in enumerate(zip(_LINE, _LINE[1:])):
        dx, dy = b[0] - a[0], b[1] - a[1]
        u = f"greatest(0.0, least(1.0, ((lon-({a[0]!r}))*({dx!r})+(lat-({a[1]!r}))*({dy!r}))/{dx * dx + dy * dy!r}))"
        size = hav(repr(a[1]), f"({a[0]!r})", repr(b[1]), f"({b[0]!r})")
        parts.append(f"SELECT feed_id, stop_id, {k} AS k, {hav('lat', 'lon', f'({a[1]!r}+{u}*({dy!r}))', f'({a[0]!r}+{u}*({dx!r}))')} AS d, {done} + {u} * {size} AS pos_m FROM s")
        done = f"{done} + {size}"
    return " UNION ALL ".join(parts)


@query(f"WITH {S}, g AS ({_along_sql()}) SELECT feed_id, stop_id, round(min_by(pos_m, d), 1) AS along_m FROM g GROUP BY 1, 2")
def route_detail_projection(spark, sf_dir):
    """Where along a line each stop projects to."""
    line = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in _LINE])
    return stops(spark, sf_dir).select("feed_id", "stop_id", F.round(t.along_line(F.col("lat"), F.col("lon"), line), 1).alias("along_m"))


@query(f"""WITH {S}, o AS (SELECT feed_id || '/' || stop_id AS id, round({HAV}, 3) AS d FROM s WHERE {HAV} <= 1500 ORDER BY 2, 1 LIMIT 4),
e AS (SELECT feed_id || '/' || stop_id AS id, round({HAV.replace(str(LAT), '25.11').replace(str(LON), '-55.31')}, 3) AS d FROM s WHERE {HAV.replace(str(LAT), '25.11').replace(str(LON), '-55.31')} <= 1500 ORDER BY 2, 1 LIMIT 4)
SELECT o.id AS origin, e.id AS destination FROM o, e WHERE o.id <> e.id ORDER BY o.d + e.d, 1, 2 LIMIT 12""")
def od_pairs(spark, sf_dir):
    """Up to four origins by up to four destinations: bounded by the limits, so the pairing is of 16 rows at most."""
    named = stops(spark, sf_dir).withColumn("id", F.concat_ws("/", "feed_id", "stop_id"))

    def ends(lat, lon, name):
        d = F.round(haversine_m("lat", "lon", lat, lon), 3)
        return named.withColumn("d", d).where(haversine_m("lat", "lon", lat, lon) <= 1500).orderBy("d", "id").limit(4).select(F.col("id").alias(name), F.col("d").alias(f"d_{name}"), F.lit(1).alias("one"))

    pairs = ends(LAT, LON, "origin").join(ends(25.11, -55.31, "destination"), "one").where("origin <> destination")
    return pairs.orderBy(F.col("d_origin") + F.col("d_destination"), "origin", "destination").limit(12).select("origin", "destination")


def _positions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").alias("vehicle_id"), F.col("ts").cast("timestamp").alias("ts"), (F.lit(25.0) + F.floor(F.col("value")) % 20 / 100).alias("lat"), (F.lit(-55.0) - F.floor(F.col("value") * 3) % 20 / 100).alias("lon"), "event_type",
    )


V = "v AS (SELECT event_id, user_id AS vehicle_id, ts, 25.0::DOUBLE + floor(value) % 20 / 100 AS lat, -55.0::DOUBLE - floor(value * 3) % 20 / 100 AS lon, event_type FROM events)"


@query(f"""WITH {V}, l AS (SELECT *, lag(lat) OVER w AS pa, lag(lon) OVER w AS po, lag(ts) OVER w AS pt FROM v WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, event_id)),
k AS (SELECT *, epoch_us(ts) - epoch_us(pt) <= 7200 * 1000000::BIGINT AND (lat <> pa OR lon <> po) AS ok FROM l)
SELECT event_id, vehicle_id, round(lat, 4) AS lat, round(lon, 4) AS lon, CASE WHEN ok THEN round(pa, 4) END AS prev_lat, CASE WHEN ok THEN round(po, 4) END AS prev_lon FROM k""")
def vehicle_prev_position(spark, sf_dir):
    out = t.previous_positions(_positions(spark, sf_dir), ttl_s=7200)
    return out.select("event_id", "vehicle_id", *[F.round(c, 4).alias(c) for c in ("lat", "lon", "prev_lat", "prev_lon")])


@query(f"""WITH {V}, ve AS (SELECT event_id, 'f' || (vehicle_id % 3) AS feed_id, event_id % 200 AS trip_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 60)::VARCHAR END AS route_id FROM v),
tr AS (SELECT o_orderkey AS trip_id, (o_custkey % 50)::VARCHAR AS route_id FROM orders),
ro AS (SELECT DISTINCT 'f' || (o_custkey % 2) AS feed_id, (o_custkey % 50)::VARCHAR AS route_id, CASE WHEN o_custkey % 50 < 45 THEN 'Line ' || (o_custkey % 50) || ' f' || (o_custkey % 2) ELSE '' END AS route_name FROM orders),
x AS (SELECT event_id, feed_id, coalesce(ve.route_id, tr.route_id) AS route_id FROM ve LEFT JOIN tr USING (trip_id))
SELECT event_id, x.feed_id, x.route_id, coalesce(nullif(r.route_name, ''), (SELECT min_by(route_name, feed_id) FROM ro WHERE ro.route_id = x.route_id AND route_name <> '')) AS route_name FROM x LEFT JOIN ro r ON r.feed_id = x.feed_id AND r.route_id = x.route_id""")
def vehicle_route_enrich(spark, sf_dir):
    v = _positions(spark, sf_dir).select("event_id", F.concat(F.lit("f"), F.col("vehicle_id") % 3).alias("feed_id"), (F.col("event_id") % 200).alias("trip_id"), F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 60).cast("string")).alias("route_id"))
    o = F.col("o_custkey")
    routes = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("f"), o % 2).alias("feed_id"), (o % 50).cast("string").alias("route_id"), F.when(o % 50 < 45, F.concat(F.lit("Line "), o % 50, F.lit(" f"), o % 2)).otherwise("").alias("route_name")
    ).distinct()
    return t.enrich_vehicles(v, trips(spark, sf_dir).select("trip_id", "route_id"), routes).select("event_id", "feed_id", "route_id", "route_name")


@query(f"WITH {C}, u AS (SELECT trip_id, seq, min(stop_id) AS stop_id, min(scheduled) AS arrival FROM c GROUP BY 1, 2) SELECT trip_id, stop_id, arrival::VARCHAR AS arrival FROM u WHERE arrival > TIMESTAMP '1999-01-01' QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY seq) = 1")
def vehicle_next_stop(spark, sf_dir):
    updates = calls(spark, sf_dir).groupBy("trip_id", "seq").agg(F.min("stop_id").alias("stop_id"), F.min("scheduled").alias("arrival"))
    out = t.next_stops(updates, F.to_timestamp(F.lit("1999-01-01 00:00:00")))
    return out.select("trip_id", "stop_id", F.date_format("arrival", "yyyy-MM-dd HH:mm:ss").alias("arrival"))


@query(f"""WITH {C}, k AS (SELECT trip_id, epoch(scheduled)::BIGINT AS s, 25 + (stop_id * 104729 % 1000) / 1000.0::DOUBLE AS lat, -56 + (stop_id * 7919 % 1000) / 1000.0::DOUBLE AS lon, row_number() OVER (PARTITION BY trip_id ORDER BY scheduled, seq, stop_id, l_partkey, l_quantity) AS i FROM c),
n AS (SELECT 915148800 + 43200 AS now), a AS (SELECT trip_id, max(i) FILTER (WHERE s <= now) AS li, min(i) FILTER (WHERE s > now) AS ni, count(*) AS cnt, min(s) AS s0 FROM k, n GROUP BY 1)
SELECT a.trip_id, round(CASE WHEN cnt >= 2 AND li IS NOT NULL AND ni IS NOT NULL THEN l.lat + (r.lat - l.lat) * ((now - l.s) / (r.s - l.s)::DOUBLE) END, 9) AS lat, round(CASE WHEN cnt >= 2 AND li IS NOT NULL AND ni IS NOT NULL THEN l.lon + (r.lon - l.lon) * ((now - l.s) / (r.s - l.s)::DOUBLE) END, 9) AS lon
FROM a CROSS JOIN n LEFT JOIN k l ON l.trip_id = a.trip_id AND l.i = li LEFT JOIN k r ON r.trip_id = a.trip_id AND r.i = ni""")
def interpolate_positions(spark, sf_dir):
    s = F.unix_seconds("scheduled")
    c = calls(spark, sf_dir).select("trip_id", s.alias("s"), "seq", "stop_id", "tie", (F.lit(25) + (F.col("stop_id") * 104729 % 1000) / 1000.0).alias("lat"), (F.lit(-56) + (F.col("stop_id") * 7919 % 1000) / 1000.0).alias("lon"))
    listed = c.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("s", "seq", "tie", "lat", "lon"))).alias("l"))  # the calls of one trip
    listed = listed.select("trip_id", F.transform("l", lambda x: F.struct(x["lat"].cast("double").alias("lat"), x["lon"].cast("double").alias("lon"), x["s"].alias("arrival"), x["s"].alias("departure"))).alias("calls"))
    return t.interpolate(listed, F.lit(915148800 + 43200)).select("trip_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("""WITH st AS (SELECT s_suppkey AS station_id, s_nationkey AS system_id, s_suppkey % 12 AS total, s_suppkey % 4 AS electric, 25 + (s_suppkey * 104729 % 1000) / 10000.0::DOUBLE AS lat, -55.3 + (s_suppkey * 7919 % 1000) / 10000.0::DOUBLE AS lon FROM supplier)
SELECT station_id, n_name AS system, greatest(0, total - electric) AS bikes, electric AS ebikes, s_suppkey_renting AS renting FROM (SELECT *, station_id % 5 <> 0 AS s_suppkey_renting FROM st) JOIN nation ON n_nationkey = system_id WHERE lat BETWEEN 25.0 AND 25.08 AND lon BETWEEN -55.3 AND -55.22""")
def gbfs_nearby(spark, sf_dir):
    k = F.col("s_suppkey")
    status = table(spark, sf_dir, "supplier").select(
        k.alias("station_id"), F.col("s_nationkey").alias("n_nationkey"), (k % 12).alias("num_bikes_available"), F.lit(None).cast("bigint").alias("num_ebikes_available"),
        F.array(F.struct(F.lit("electric_bike").alias("vehicle_type_id"), (k % 4).alias("count"))).alias("types"), F.when(k % 5 == 0, F.lit(False)).alias("is_renting"),
        (F.lit(25) + (k * 104729 % 1000) / 10000.0).cast("double").alias("lat"), (F.lit(-55.3) + (k * 7919 % 1000) / 10000.0).cast("double").alias("lon"),
    )
    box = status.where(F.col("lat").between(25.0, 25.08) & F.col("lon").between(-55.3, -55.22)).join(table(spark, sf_dir, "nation"), "n_nationkey")
    return t.available(box).select("station_id", F.col("n_name").alias("system"), "bikes", "ebikes", "renting")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CASE WHEN floor(p_size * 1.609344::DOUBLE + 0.5) BETWEEN 10 AND 150 THEN floor(p_size * 1.609344::DOUBLE + 0.5) END ELSE CASE WHEN p_size BETWEEN 10 AND 150 THEN p_size END END::DOUBLE AS kph,
floor(p_size / (CASE WHEN p_size % 2 = 0 THEN 1000 ELSE 2000 END)::DOUBLE * 100 + 0.5) / 100 AS tons, floor((p_size * 0.3048::DOUBLE + 6 * 0.0254::DOUBLE) * 100 + 0.5) / 100 AS metres, p_size % 5 - 2 < 0 AS underground FROM part""")
def tag_measures(spark, sf_dir):
    """Speeds, weights, lengths and levels read from texts made of each part's size."""
    n = F.col("p_size").cast("string")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(n, F.when(F.col("p_size") % 3 == 0, " mph").otherwise("")).alias("speed"), F.concat(n, F.when(F.col("p_size") % 2 == 0, " kg").otherwise(" lbs")).alias("weight"),
        F.concat(n, F.lit("'6\"")).alias("length"), F.concat((F.col("p_size") % 5 - 2).cast("string"), F.lit(";3")).alias("level"),
    )
    return rows.select("p_partkey", tag.speed_kph("speed").alias("kph"), tag.weight_t("weight").alias("tons"), tag.measure_m("length").alias("metres"), tag.is_underground("level").alias("underground"))


@query()
def polyline_decode(spark, sf_dir):
    """Encoded lines decoded in Arrow batches (the tests hold the round trip)."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("_c`|@_c`|@_seK_seK").alias("line"))
    return rows.select("s_suppkey", F.to_json(polyline_points("line")).alias("points"))


@query("""WITH pt AS (SELECT l_orderkey AS line_id, l_quantity AS ele, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS i FROM lineitem),
d AS (SELECT line_id, ele, coalesce(ele - lag(ele) OVER (PARTITION BY line_id ORDER BY i), 0) AS d FROM pt) SELECT line_id, round(sum(greatest(d, 0)), 1) AS gain, round(sum(greatest(-d, 0)), 1) AS loss, round(min(ele), 1) AS low, round(max(ele), 1) AS high FROM d GROUP BY 1""")
def elevation_stats(spark, sf_dir):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    pts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line_id"), F.col("l_quantity").alias("ele"), F.row_number().over(w).alias("i"))
    return t.elevation_stats(pts, "line_id", "i")


@query(f"""WITH {V}, c AS (SELECT vehicle_id, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts, event_id) AS i, lat, lon FROM v), d AS (SELECT *, coalesce({hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) AS step FROM c WINDOW w AS (PARTITION BY vehicle_id ORDER BY i))
SELECT vehicle_id, i, round(sum(step) OVER (PARTITION BY vehicle_id ORDER BY i), 0) AS along_m FROM d""")
def cumulative_distance(spark, sf_dir):
    w = W.partitionBy("vehicle_id").orderBy("ts", "event_id")
    pts = _positions(spark, sf_dir).withColumn("i", F.row_number().over(w).cast("long")).select("vehicle_id", "i", "lat", "lon")
    return t.cumulative_m(pts, "vehicle_id", "i").select("vehicle_id", "i", F.round("along_m", 0).alias("along_m"))


@query("""WITH g AS (SELECT l_orderkey AS line_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS i, l_returnflag AS surface, l_linestatus AS road FROM lineitem),
n AS (SELECT *, CASE WHEN lag(i) OVER w IS NOT NULL AND lag(surface) OVER w IS NOT DISTINCT FROM surface AND lag(road) OVER w IS NOT DISTINCT FROM road THEN 0 ELSE 1 END AS new FROM g WINDOW w AS (PARTITION BY line_id ORDER BY i)),
r AS (SELECT *, sum(new) OVER (PARTITION BY line_id ORDER BY i) AS run FROM n) SELECT line_id, surface, road, min(i)::BIGINT AS start_i, max(i + 1)::BIGINT AS end_i FROM r GROUP BY line_id, run, surface, road""")
def segment_merge(spark, sf_dir):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    i = F.row_number().over(w).cast("long")
    seg = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line_id"), i.alias("start_i"), (i + 1).alias("end_i"), F.col("l_returnflag").alias("surface"), F.col("l_linestatus").alias("road"))
    return t.merge_runs(seg, "line_id", "start_i", "end_i", ["surface", "road"])


@query("""WITH d AS (SELECT DISTINCT l_orderkey % 500 AS line_id, l_returnflag AS kind, l_partkey % 20 AS f, l_partkey % 20 + 1 + l_suppkey % 7 AS t, l_linenumber AS value FROM lineitem), b AS (SELECT line_id, f AS i FROM d UNION SELECT line_id, t FROM d),
r AS (SELECT line_id, i, lead(i) OVER (PARTITION BY line_id ORDER BY i) AS j FROM b QUALIFY j IS NOT NULL) SELECT line_id, i AS from_i, j AS to_i, kind, value FROM r JOIN d USING (line_id) WHERE f <= i AND t >= j""")
def breakpoints_cover(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    d = li.select((F.col("l_orderkey") % 500).alias("line_id"), F.col("l_returnflag").alias("kind"), (F.col("l_partkey") % 20).alias("from_i"), (F.col("l_partkey") % 20 + 1 + F.col("l_suppkey") % 7).alias("to_i"), F.col("l_linenumber").alias("value")).distinct()
    return t.cover_breakpoints(d, "line_id")


_BUDGET = "r AS (SELECT feed_id || '/' || stop_id AS id, lat, lon, 900 - (ascii(stop_name) * 13 % 600) AS remaining FROM s WHERE stop_name IS NOT NULL)"


def _budget(spark, sf_dir):
    return stops(spark, sf_dir).where("stop_name is not null").select(F.concat_ws("/", "feed_id", "stop_id").alias("id"), "lat", "lon", (900 - F.ascii("stop_name") * 13 % 600).alias("remaining"))


@query(f"WITH {S}, {_BUDGET} SELECT id, remaining FROM r QUALIFY row_number() OVER (PARTITION BY floor(lat / 0.002::DOUBLE + 0.5), floor(lon / 0.002::DOUBLE + 0.5) ORDER BY remaining DESC, id) = 1")
def grid_dedupe(spark, sf_dir):
    return t.grid_dedupe(_budget(spark, sf_dir), 0.002).select("id", "remaining")


@query(f"""WITH {S}, {_BUDGET}, z AS (SELECT k, 0.0005::DOUBLE * pow(2, k) AS c FROM range(6) x(k)), n AS (SELECT k, c, count(DISTINCT (floor(lat / c + 0.5), floor(lon / c + 0.5))) AS cells FROM r, z GROUP BY 1, 2)
SELECT c AS cell_deg, cells FROM n WHERE cells <= 400 OR k = 5 ORDER BY k LIMIT 1""")
def grid_coarsen(spark, sf_dir):
    return t.coarsest_cell(_budget(spark, sf_dir), 400)


@query(f"""WITH {S}, {_BUDGET}, q AS (SELECT lat, lon, remaining * 1.25::DOUBLE AS m FROM r),
ce AS (SELECT DISTINCT y, x FROM (SELECT floor(lat / 0.002::DOUBLE + 0.5) + dy AS y, floor(lon / 0.002::DOUBLE + 0.5) + dx AS x, lat, lon, m FROM (SELECT *, unnest(range(-k, k + 1)) AS dx FROM (SELECT *, ceil(m / 111000 / greatest(0.01, cos(radians(lat))) / 0.002)::BIGINT + 1 AS k FROM q)), range(-8, 9) a(dy)) WHERE {hav('lat', 'lon', 'y * 0.002', 'x * 0.002')} <= m) SELECT y::BIGINT AS y, x::BIGINT AS x FROM ce""")
def isochrone_cells(spark, sf_dir):
    """What can be walked to from the stops with the time they have left."""
    return t.reach_cells(_budget(spark, sf_dir), 0.002).select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
