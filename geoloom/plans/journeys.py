"""Queries of completion, semantic search, live views, complexes, outlines and text sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import tags as tag
from geoloom.operators import journeys as j
from geoloom.operators import search as s
from geoloom.operators import transit as t
from geoloom.plans.places import P, places, similarity_sql, stored_places
from geoloom.plans.search import DEG, HAV, LAT, LON, Q
from geoloom.plans.transit import _BUDGET, C, S, T, V, _budget, calls, hav, stops, trips
from geoloom.plans.usage import C as COUNTERS
from geoloom.plans.usage import counters
from geoloom.sources import feeds, gtfs
from geoloom.sources.sinks import write_transfers
from geoloom.util import scratch, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _shown(rows):
    return rows.select("id", "name", "priority", F.round("text_rank", 6).alias("text_rank"), F.round("distance_m", 1).alias("distance_m"))


PREFIX = "market ha"


def _rank_sql(hits: str, most: int) -> str:
    """From layers `m` (id, r, pr, pos) to the ranked page."""
    return f"""g AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY pr, pos) = 1), {hits} t AS (SELECT * FROM g ORDER BY pr, pos LIMIT {most}),
z AS (SELECT t.id, x.name, t.pr, t.pos, t.r, {HAV.replace('lat', 'x.lat').replace('lon', 'x.lon')} AS d FROM t JOIN x USING (id))
SELECT id, name, pr AS priority, round(r, 6) AS text_rank, round(d, 1) AS distance_m FROM z
ORDER BY pr = 1 DESC, CASE WHEN pr = 1 THEN pos END, round(r / (1 + coalesce(nullif(d, 0.0), 100000.0) / 50000.0), 9) DESC, id LIMIT 20"""


def _words_sql(text: str, prefix: bool) -> tuple[str, str]:
    words = text.split()
    sim = {w: similarity_sql("name", f"'{w}'") for w in [*words, text]}
    best = f"greatest({', '.join(sim[w] for w in words)})" if len(words) > 1 else sim[words[0]]
    cover = " + ".join(f"CASE WHEN {sim[w]} > 0.3 OR list_contains(ts, '{w}') THEN 1 ELSE 0 END" for w in words)
    all_ = [f"list_contains(ts, '{w}')" for w in (words[:-1] if prefix else words)] + ([f"len(list_filter(ts, lambda x: starts_with(x, '{words[-1]}'))) > 0"] if prefix else [])
    return f"x AS (SELECT *, coalesce({sim[text]}, 0.0) AS whole, coalesce({best}, 0.0) AS best, {cover} AS cover, {DEG} AS deg, {' AND '.join(all_)} AS hit FROM q)", f"1.5::DOUBLE * greatest(whole, best, {0.5 if len(words) > 1 else 0.0}::DOUBLE) * demote"


_X, _R = _words_sql(PREFIX, True)
_D = 50_000 / 111_000


@query(f"""WITH {Q}, {_X}, m AS (SELECT id, {_R} AS r, 3 AS pr, row_number() OVER (ORDER BY deg, id) AS pos FROM x WHERE hit AND lat BETWEEN {LAT} - {_D}::DOUBLE AND {LAT} + {_D}::DOUBLE AND lon BETWEEN {LON} - {_D}::DOUBLE AND {LON} + {_D}::DOUBLE QUALIFY pos <= 200), {_rank_sql('', 200)}""")
def autocomplete(spark, sf_dir):
    """What a half-typed text completes to around a point: a pool of near ones, ranked and trimmed."""
    return _shown(s.search(stored_places(spark, sf_dir), s.Request(query=PREFIX, lat=LAT, lon=LON, autocomplete=True)))


_FAR = (-45.0, 100.0)  # nothing is there


@query(f"""WITH {Q}, {_X}, m AS (SELECT id, {_R} AS r, 3 AS pr, row_number() OVER (ORDER BY round({_R} / (1 + coalesce(deg, 0.0) / 0.45::DOUBLE), 9) DESC, id) AS pos FROM x WHERE hit QUALIFY pos <= 20
UNION ALL SELECT id, best * (0.3::DOUBLE + 0.7::DOUBLE * cover / 2) * demote, 4, row_number() OVER (ORDER BY round(whole, 9) DESC, id) AS pos FROM x WHERE name IS NOT NULL AND whole >= 0.3 QUALIFY pos <= 20), {_rank_sql('', 200)}""".replace(str(LAT), f"({_FAR[0]})").replace(str(LON), f"({_FAR[1]})"))
def autocomplete_retry(spark, sf_dir):
    """Nothing near answers, so the whole table is asked."""
    return _shown(s.search(stored_places(spark, sf_dir), s.Request(query=PREFIX, lat=_FAR[0], lon=_FAR[1], autocomplete=True)))


_VEC = "list_transform(range(64), lambda k: (((k * 37 + 11) % 64) - 31.5)::DOUBLE)"


@query(f"""WITH {Q}, x AS (SELECT *, CASE WHEN len(embedding) = 64 AND list_sum(list_transform(embedding, lambda v: abs(v))) > 0 THEN list_cosine_similarity(embedding::DOUBLE[], {_VEC}) END AS c FROM q),
m AS (SELECT id, c AS r, 5 AS pr, row_number() OVER (ORDER BY round(c, 9) DESC, id) AS pos FROM x WHERE c IS NOT NULL QUALIFY pos <= 20), {_rank_sql('', 20)}""")
def semantic_fill(spark, sf_dir):
    """A text that no name holds: the places nearest to the query's vector fill the page."""
    vector = [float((k * 37 + 11) % 64) - 31.5 for k in range(64)]
    return _shown(s.search(stored_places(spark, sf_dir), s.Request(query="qqqqqq xxzzxx", lat=LAT, lon=LON, vector=vector)))


_MEMBERS = "mb AS (SELECT osm_id % 700 AS relation_id, osm_type AS member_type, osm_id AS member_ref FROM p WHERE tags['public_transport'] IS NOT NULL OR tags['railway'] IS NOT NULL OR tags['highway'] IS NOT NULL OR tags['entrance'] IS NOT NULL OR osm_id % 9 = 0)"
_NEAR = f"lat BETWEEN {LAT} - 2 AND {LAT} + 2 AND lon BETWEEN {LON} - 2 AND {LON} + 2"


@query(f"""WITH {P}, {_MEMBERS}, ar AS (SELECT DISTINCT relation_id FROM mb JOIN p ON osm_type = member_type AND osm_id = member_ref WHERE {_NEAR} AND (tags['public_transport'] IN ('platform', 'stop_position', 'station') OR tags['railway'] IN ('platform', 'station', 'halt', 'stop'))),
lk AS (SELECT DISTINCT member_type, member_ref FROM mb SEMI JOIN ar USING (relation_id))
SELECT id, name, coalesce(tags['railway'], CASE WHEN tags['highway'] = 'elevator' THEN 'elevator' ELSE 'entrance' END) AS access_type, 0 AS tier, round({HAV}, 1) AS distance_m
FROM p JOIN lk ON osm_type = member_type AND osm_id = member_ref WHERE coalesce(tags['railway'] IN ('subway_entrance', 'train_station_entrance'), FALSE) OR tags['entrance'] IS NOT NULL OR coalesce(tags['highway'] = 'elevator', FALSE) OR osm_id % 9 = 0""")
def stop_area_doors(spark, sf_dir):
    """Ways in of the stop areas around a point; the areas' members, and some of the ways in, are made from the places'
    ids, as the table has none."""
    df = stored_places(spark, sf_dir)
    g = F.col("tags")
    door = F.map_concat(F.map_filter(g, lambda k, v: k != "entrance"), F.create_map(F.lit("entrance"), F.lit("main")))
    df = df.withColumn("tags", F.when(F.col("osm_id") % 9 == 0, door).otherwise(g))
    members = df.where(g["public_transport"].isNotNull() | g["railway"].isNotNull() | g["highway"].isNotNull() | g["entrance"].isNotNull()).select(
        (F.col("osm_id") % 700).alias("relation_id"), F.col("osm_type").alias("member_type"), F.col("osm_id").alias("member_ref")
    )
    return j.stop_area_entrances(df, members, LAT, LON, 2.0).select("id", "name", "access_type", "tier", F.round("distance_m", 1).alias("distance_m"))


@query(f"""WITH {T}, {C}, st AS (SELECT s_suppkey AS stop, s_suppkey // 2 AS station FROM supplier), tr AS (SELECT s_suppkey AS a, (s_suppkey * 7 + 1) % 50 AS b FROM supplier),
l AS (SELECT a, b FROM tr UNION ALL SELECT b, a FROM tr), h AS (SELECT x.station, y.station AS far FROM st x JOIN l ON x.stop = l.a JOIN st y ON y.stop = l.b),
r AS (SELECT station, station AS far FROM st UNION SELECT * FROM h), mb AS (SELECT DISTINCT x.stop, m.stop AS member FROM st x JOIN r USING (station) JOIN st m ON m.station = r.far),
sr AS (SELECT DISTINCT stop_id AS member, route_id FROM t JOIN c USING (trip_id)), rt AS (SELECT route_id, route_id::INTEGER % 4 AS route_type FROM t GROUP BY 1)
SELECT DISTINCT stop, route_id, route_type FROM mb JOIN sr USING (member) JOIN rt USING (route_id)""")
def station_routes(spark, sf_dir):
    """All routes at a stop's complex: its members' routes, once each."""
    st = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("stop"), F.expr("s_suppkey div 2").alias("station"))
    links = st.select(F.col("stop").alias("a"), ((F.col("stop") * 7 + 1) % 50).alias("b"))
    served = t.stop_times_of(trips(spark, sf_dir).select("trip_id", "route_id"), calls(spark, sf_dir).select("trip_id", "stop_id")).select(F.col("stop_id").alias("member"), "route_id").distinct()
    kinds = trips(spark, sf_dir).select("route_id").distinct().withColumn("route_type", F.col("route_id").cast("int") % 4)
    return j.complex_routes(t.station_complex(st, links), served, kinds).select("stop", "route_id", "route_type")


@query(f"""WITH {S}, f AS (SELECT * FROM s WHERE location_type = 0), d AS (SELECT a.feed_id || '/' || a.stop_id AS x, b.feed_id || '/' || b.stop_id AS y, round({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS d
FROM f a JOIN f b ON (a.feed_id, a.stop_id) < (b.feed_id, b.stop_id) AND b.lat BETWEEN a.lat - 0.006 AND a.lat + 0.006 AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 500),
w AS (SELECT x, y, d FROM d UNION ALL SELECT y, x, d FROM d) SELECT x AS from_stop_id, y AS to_stop_id, 2 AS transfer_type, greatest(60, ceil(d / 1.25::DOUBLE))::INTEGER AS min_transfer_time FROM w""")
def transfers_text(spark, sf_dir):
    """Transfers both ways, written as a feed's text file and read from it again."""
    name = lambda c: F.concat_ws("/", f"{c}.feed_id", f"{c}.stop_id")
    links = j.transfer_links(t.transfer_pairs(stops(spark, sf_dir))).select(name("from").alias("from_stop_id"), name("to").alias("to_stop_id"), "min_transfer_time")
    folder = scratch(spark, "feed")
    write_transfers(links, f"{folder}/transfers.txt")
    return gtfs.transfers(gtfs.read_file(spark, folder, "transfers"))


@query(f"WITH {S} SELECT stop_id, stop_name, lat AS stop_lat, lon AS stop_lon, location_type, parent_station, wheelchair_boarding FROM (SELECT feed_id || '/' || stop_id AS stop_id, * EXCLUDE (stop_id) FROM s)")
def stops_text(spark, sf_dir):
    """The stops written as a feed's text file, with quoted names, and read from it again."""
    rows = stops(spark, sf_dir).select(
        F.concat_ws("/", "feed_id", "stop_id").alias("stop_id"), "stop_name", F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon"), "location_type", "parent_station", "wheelchair_boarding"
    )
    folder = scratch(spark, "feed")
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(f"{folder}/stops.txt")
    return gtfs.stops(gtfs.read_file(spark, folder, "stops")).drop("stop_code", "platform_code")


@query(f"WITH {T} SELECT trip_id::VARCHAR AS trip_id, route_id, direction_id::INTEGER AS direction_id, shape_id, bikes_allowed::INTEGER AS bikes_allowed FROM t")
def trips_text(spark, sf_dir):
    folder = scratch(spark, "feed")
    trips(spark, sf_dir).write.option("header", True).csv(f"{folder}/trips.txt")
    return gtfs.trips(gtfs.read_file(spark, folder, "trips"))


@query(f"""WITH {T}, pt AS (SELECT DISTINCT shape_id, (trip_id % 97)::INTEGER AS seq FROM t), o AS (SELECT shape_id, string_agg(printf('%.1f,%.1f', -55 - seq / 10.0, 25 + seq / 10.0), ' ' ORDER BY seq) AS line FROM pt GROUP BY 1) SELECT shape_id, line FROM o""")
def shapes_text(spark, sf_dir):
    """Shapes whose points stand in no order in the file."""
    pt = trips(spark, sf_dir).select("shape_id", (F.col("trip_id") % 97).alias("shape_pt_sequence")).distinct()
    n = F.col("shape_pt_sequence") / 10
    folder = scratch(spark, "feed")
    pt.select("shape_id", (25 + n).alias("shape_pt_lat"), (-55 - n).alias("shape_pt_lon"), "shape_pt_sequence").write.option("header", True).csv(f"{folder}/shapes.txt")
    line = gtfs.shapes(gtfs.read_file(spark, folder, "shapes"))
    return line.select("shape_id", F.array_join(F.transform("coordinates", lambda p: F.format_string("%.1f,%.1f", p[0], p[1])), " ").alias("line"))


@query(f"WITH {V}, fd AS (SELECT user_id % 7 AS feed_id, max(epoch(ts)::BIGINT) AS feed_ts FROM events GROUP BY 1) SELECT event_id, vehicle_id % 7 AS feed_id, event_type AS route_id, feed_ts FROM v JOIN fd ON fd.feed_id = vehicle_id % 7 WHERE lat BETWEEN 25.05 AND 25.15 AND lon BETWEEN -55.15 AND -55.02 AND event_type = 'purchase'")
def vehicles_in_view(spark, sf_dir):
    """Live positions of one route in a box, with the time of their feed."""
    e = table(spark, sf_dir, "events").withColumn("feed_id", F.col("user_id") % 7)
    v = e.select("event_id", "feed_id", F.col("event_type").alias("route_id"), (F.lit(25.0) + F.floor("value") % 20 / 100).alias("lat"), (F.lit(-55.0) - F.floor(F.col("value") * 3) % 20 / 100).alias("lon"))
    stamps = e.select("feed_id", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("feed_ts"))
    return j.live_in_view(v, stamps, 25.05, -55.15, 25.15, -55.02, "purchase").select("event_id", "feed_id", "route_id", "feed_ts")


@query("""WITH r AS (SELECT l_orderkey AS request_id, (l_quantity * 60)::BIGINT AS duration_s, l_suppkey % 9 AS signature, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS pos FROM lineitem),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY request_id, signature ORDER BY duration_s, pos) = 1) SELECT request_id, duration_s, signature, row_number() OVER (PARTITION BY request_id ORDER BY duration_s, pos)::INTEGER AS place FROM o QUALIFY place <= 5""")
def itineraries(spark, sf_dir):
    """The five shortest different itineraries of each request."""
    from pyspark.sql import Window as W

    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), (F.col("l_quantity") * 60).cast("long").alias("duration_s"), (F.col("l_suppkey") % 9).alias("signature"), pos.alias("pos"))
    return j.rank_itineraries(rows, 5).select("request_id", "duration_s", "signature", "place")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN TRUE ELSE p_size % 3 = 1 AND p_partkey < 0 END AS buckets, least(greatest(p_size * 60 * 1.25::DOUBLE, 500), 2500) AS radius_m FROM part""")
def request_shapes(spark, sf_dir):
    """Which lists of durations one bucketed search serves, and how far their stops may be."""
    n = F.col("p_size") * 60
    rows = table(spark, sf_dir, "part").select("p_partkey", n.alias("n"), F.when(F.col("p_size") % 3 == 0, F.array(n, 2 * n, 3 * n)).when(F.col("p_size") % 3 == 1, F.array(n, 2 * n + 5)).otherwise(F.array(n)).alias("d"))
    return rows.select("p_partkey", j.in_equal_steps(F.col("d")).alias("buckets"), j.access_radius_m(F.col("n")).alias("radius_m"))


@query(f"""WITH {COUNTERS}, u AS (SELECT user_id, count(DISTINCT endpoint) > 1 AS active FROM c GROUP BY 1), us AS (SELECT user_id, sum(credits)::BIGINT AS credits FROM c WHERE day >= DATE '2025-06-01' GROUP BY 1),
sg AS (SELECT user_id, count(*) AS signals FROM c WHERE rejected > 5 GROUP BY 1) SELECT user_id, coalesce(credits, 0)::BIGINT AS credits, coalesce(signals, 0) AS signals FROM u LEFT JOIN us USING (user_id) LEFT JOIN sg USING (user_id) WHERE active""")
def users_report(spark, sf_dir):
    """Active users with what they used lately and what was signalled, each summed up before it is joined."""
    c = counters(spark, sf_dir)
    users = c.groupBy("user_id").agg(F.countDistinct("endpoint").alias("n")).where("n > 1").select("user_id")
    used = c.where("day >= date'2025-06-01'").groupBy("user_id").agg(F.sum("credits").alias("credits"))
    signals = c.where("rejected > 5").groupBy("user_id").agg(F.count("*").alias("signals"))
    return users.join(used, "user_id", "left").join(signals, "user_id", "left").select("user_id", F.coalesce("credits", F.lit(0)).alias("credits"), F.coalesce("signals", F.lit(0)).alias("signals"))


@query("SELECT count(*) AS n, TRUE AS fresh FROM geo_places")
def enrichment_state(spark, sf_dir):
    """Whether what was derived from the places still holds: same version, and about as many rows."""
    rows = table(spark, sf_dir, "geo_places")
    marker = rows.agg(F.current_timestamp().alias("completed_at"), (F.count("*") * 1.05).cast("long").alias("row_count"), F.lit(2).alias("version"))
    return j.is_fresh(marker, rows, 2)


_CELLS = f"""q AS (SELECT left(id, 4) AS area, lat, lon, remaining * 1.25::DOUBLE AS m FROM r),
ce AS (SELECT DISTINCT area, y, x FROM (SELECT area, floor(lat / 0.002::DOUBLE + 0.5) + dy AS y, floor(lon / 0.002::DOUBLE + 0.5) + dx AS x, lat, lon, m FROM (SELECT *, unnest(range(-k, k + 1)) AS dx FROM (SELECT *, ceil(m / 111000 / greatest(0.01, cos(radians(lat))) / 0.002)::BIGINT + 1 AS k FROM q)), range(-8, 9) a(dy)) WHERE {hav('lat', 'lon', 'y * 0.002', 'x * 0.002')} <= m)"""


@query(f"""WITH {S}, {_BUDGET}, {_CELLS}, e AS (SELECT area, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM ce n WHERE n.area = ce.area AND n.y = ce.y + d.dy AND n.x = ce.x + d.dx)) AS edges, count(DISTINCT (y, x)) AS cells FROM ce, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx) GROUP BY 1) SELECT area, cells, edges FROM e""")
def reach_outlines(spark, sf_dir):
    """The outline of what can be walked to from the stops of each group of feeds: its cells' union as a multipolygon,
    whose area must be the cells' and whose length their open sides."""
    rows = _budget(spark, sf_dir).withColumn("area", F.substring("id", 1, 4))
    return j.outlines(t.reach_cells_by(rows, "area", 0.002), "area", 0.002).select("area", "cells", "edges")


@query("SELECT p_partkey, list_filter([(p_size % 5 - 2)::DOUBLE, CASE WHEN p_size % 2 = 0 THEN (p_size / 2.0)::DOUBLE END], lambda x: x IS NOT NULL)::VARCHAR AS levels, least((p_size % 5 - 2)::DOUBLE, CASE WHEN p_size % 2 = 0 THEN (p_size / 2.0)::DOUBLE END) AS lowest FROM part")
def level_parse(spark, sf_dir):
    """Lists of levels, of which some are no numbers."""
    n = F.col("p_size")
    text = F.concat((n % 5 - 2).cast("string"), F.lit("; "), F.when(n % 2 == 0, (n / 2).cast("string")).otherwise("roof"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("level"))
    return rows.select("p_partkey", F.concat(F.lit("["), F.array_join(tag.levels("level"), ", "), F.lit("]")).alias("levels"), tag.lowest_level("level").alias("lowest"))


@query(f"WITH {P} SELECT id FROM p WHERE tags['public_transport'] = 'platform' AND tags['railway'] IS NULL AND tags['bus'] IS NULL")
def tag_filter(spark, sf_dir):
    g = F.col("tags")
    return places(spark, sf_dir).where(s.has_tags({"public_transport": "platform"}) & g["railway"].isNull() & g["bus"].isNull()).select("id")


@query("SELECT id, bbox[1] AS west, bbox[2] AS south, bbox[3] AS east, bbox[4] AS north FROM boundary_catalog WHERE len(bbox) = 4")
def region_boxes(spark, sf_dir):
    """Boxes of coordinates in text form, made from the catalogue's own."""
    b = F.col("bbox")
    ring = lambda *k: F.concat(F.lit("["), b[k[0]].cast("string"), F.lit(","), b[k[1]].cast("string"), F.lit("]"))
    rows = table(spark, sf_dir, "boundary_catalog").where("size(bbox) = 4").select("id", F.concat(F.lit("[["), ring(0, 1), F.lit(","), ring(2, 1), F.lit(","), ring(2, 3), F.lit(","), ring(0, 3), F.lit("]]")).alias("c"))
    box = feeds.box_of_coordinates("c")
    return rows.select("id", box[0].alias("west"), box[1].alias("south"), box[2].alias("east"), box[3].alias("north"))
