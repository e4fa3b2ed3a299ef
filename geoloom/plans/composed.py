"""Queries that put several operators together."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions import text as txt
from geoloom.operators import transit as t
from geoloom.plans.places import P, places
from geoloom.plans.transit import A, S, _anchors, hav, stops
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


R = "r AS (SELECT DISTINCT 'f' || (o_custkey % 3) AS feed_id, (o_custkey % 50)::VARCHAR AS route_id, o_orderkey AS trip_id FROM orders)"


def _trips(spark, sf_dir):
    o = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), o % 3).alias("feed_id"), (o % 50).cast("string").alias("route_id"), F.col("o_orderkey").alias("trip_id")).distinct()


@query(f"""WITH {R}, c AS (SELECT DISTINCT feed_id, route_id, l_suppkey AS stop_id, s_name, s_nationkey FROM r JOIN lineitem ON l_orderkey = trip_id JOIN supplier ON s_suppkey = l_suppkey)
SELECT feed_id, route_id, s_nationkey AS stop_group, stop_id, s_name AS stop_name FROM c QUALIFY row_number() OVER (PARTITION BY feed_id, route_id, s_nationkey ORDER BY stop_id) = 1""")
def route_stops(spark, sf_dir):
    """The stops of each route, one of each group of equals."""
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").alias("s_suppkey"))
    named = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    # Pairs are made distinct before names are joined, so that the wide columns move once per pair.
    pairs = _trips(spark, sf_dir).join(calls, "trip_id").select("feed_id", "route_id", "s_suppkey").distinct().join(named, "s_suppkey")
    best = F.min(F.struct(F.col("s_suppkey").alias("stop_id"), F.col("s_name").alias("stop_name")))
    return pairs.groupBy("feed_id", "route_id", F.col("s_nationkey").alias("stop_group")).agg(best.alias("m")).select("feed_id", "route_id", "stop_group", "m.*")


@query("""WITH sh AS (SELECT DISTINCT 'f' || (o_custkey % 3) AS feed_id, (o_custkey % 70)::VARCHAR AS route_id, 'sh' || (o_custkey % 70) || '-' || (o_custkey % 3) AS shape FROM orders WHERE o_custkey % 4 <> 0),
q AS (SELECT DISTINCT 'f' || (c_custkey % 3) AS feed_id, (c_custkey % 70)::VARCHAR AS route_id FROM customer)
SELECT q.feed_id, q.route_id, coalesce((SELECT min(shape) FROM sh WHERE sh.feed_id = q.feed_id AND sh.route_id = q.route_id), (SELECT min_by(shape, feed_id) FROM sh WHERE sh.route_id = q.route_id)) AS shape FROM q""")
def shape_lookup(spark, sf_dir):
    """A route's shape from its own feed, else from the first other feed that has one."""
    o, c = F.col("o_custkey"), F.col("c_custkey")
    shapes = table(spark, sf_dir, "orders").where(o % 4 != 0).select(
        F.concat(F.lit("f"), o % 3).alias("feed_id"), (o % 70).cast("string").alias("route_id"), F.concat(F.lit("sh"), o % 70, F.lit("-"), o % 3).alias("shape")
    ).distinct()
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), c % 3).alias("feed_id"), (c % 70).cast("string").alias("route_id")).distinct()
    own = shapes.groupBy("feed_id", "route_id").agg(F.min("shape").alias("own"))
    other = shapes.groupBy("route_id").agg(F.min_by("shape", "feed_id").alias("other"))
    return asked.join(own, ["feed_id", "route_id"], "left").join(other, "route_id", "left").select("feed_id", "route_id", F.coalesce("own", "other").alias("shape"))


@query(f"""WITH {P}, {S}, {A}, e AS (SELECT s.feed_id, s.stop_id, count(*) AS entrances, round(min({hav('s.lat', 's.lon', 'a.lat', 'a.lon')}), 1) AS nearest_m FROM s JOIN a ON s.location_type = 1 AND a.lat BETWEEN s.lat - 0.003 AND s.lat + 0.003 AND {hav('s.lat', 's.lon', 'a.lat', 'a.lon')} <= 250 GROUP BY 1, 2),
k AS (SELECT feed_id, parent_station AS stop_id, count(*) AS platforms FROM s WHERE parent_station IS NOT NULL GROUP BY 1, 2)
SELECT s.feed_id, s.stop_id, s.stop_name, coalesce(platforms, 0) AS platforms, coalesce(entrances, 0) AS entrances, nearest_m FROM s LEFT JOIN e USING (feed_id, stop_id) LEFT JOIN k USING (feed_id, stop_id) WHERE location_type = 1""")
def station_detail(spark, sf_dir):
    """Every station with its platforms and the ways in within 250 m; each side is counted before it is joined."""
    s = stops(spark, sf_dir)
    stations = s.where("location_type = 1")
    near = t.near_join(stations.select(F.struct("feed_id", "stop_id").alias("key"), "lat", "lon"), _anchors(spark, sf_dir), 250.0)
    near = near.groupBy("a").agg(F.count("*").alias("entrances"), F.round(F.min("distance_m"), 1).alias("nearest_m")).select("a.*", "entrances", "nearest_m")
    platforms = s.where("parent_station is not null").groupBy("feed_id", F.col("parent_station").alias("stop_id")).agg(F.count("*").alias("platforms"))
    out = stations.join(near, ["feed_id", "stop_id"], "left").join(platforms, ["feed_id", "stop_id"], "left")
    return out.select("feed_id", "stop_id", "stop_name", F.coalesce("platforms", F.lit(0)).alias("platforms"), F.coalesce("entrances", F.lit(0)).alias("entrances"), "nearest_m")


@query("""WITH g AS (SELECT l_orderkey AS line_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS i, l_returnflag AS surface, l_quantity AS ele, l_quantity * 10 AS metres FROM lineitem),
c AS (SELECT *, sum(metres) OVER (PARTITION BY line_id ORDER BY i) AS end_m, ele - lag(ele) OVER (PARTITION BY line_id ORDER BY i) AS d, CASE WHEN lag(surface) OVER (PARTITION BY line_id ORDER BY i) IS NOT DISTINCT FROM surface THEN 0 ELSE 1 END AS new FROM g),
n AS (SELECT *, sum(new) OVER (PARTITION BY line_id ORDER BY i) AS run FROM c), u AS (SELECT line_id, run, surface, min(end_m - metres) AS start_m, max(end_m) AS end_m FROM n GROUP BY 1, 2, 3),
e AS (SELECT line_id, round(sum(greatest(coalesce(d, 0), 0)), 1) AS gain, round(sum(greatest(-coalesce(d, 0), 0)), 1) AS loss FROM c GROUP BY 1)
SELECT u.line_id, surface, round(start_m, 1) AS start_m, round(end_m, 1) AS end_m, gain, loss FROM u JOIN e USING (line_id)""")
def enriched_route(spark, sf_dir):
    """Lines with their surface runs by distance and their climb: cumulative distance, gaps and islands, elevation,
    all over one partitioning by line."""
    w = W.partitionBy("line_id").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    g = table(spark, sf_dir, "lineitem").withColumn("line_id", F.col("l_orderkey"))
    g = g.select("line_id", F.row_number().over(w).alias("i"), F.col("l_returnflag").alias("surface"), F.col("l_quantity").alias("ele"), (F.col("l_quantity") * 10).alias("metres"))
    run = W.partitionBy("line_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    c = g.withColumn("end_m", F.sum("metres").over(run)).withColumn("start_m", F.col("end_m") - F.col("metres"))
    runs = t.merge_runs(c, "line_id", "start_m", "end_m", ["surface"])
    climb = t.elevation_stats(g, "line_id", "i").select("line_id", "gain", "loss")
    return runs.join(climb, "line_id").select("line_id", "surface", F.round("start_m", 1).alias("start_m"), F.round("end_m", 1).alias("end_m"), "gain", "loss")


@query(f"""WITH {P} SELECT CASE WHEN regexp_matches(id, '^(node|way|relation)/[0-9]+$') THEN id ELSE 'other/' || id END AS feature_id, split_part(id, '/', 1) AS kind, substr(id, strpos(id, '/') + 1) AS ref, coalesce(TRY_CAST(admin_level AS DOUBLE) / 10, 0.5) AS confidence FROM p""")
def feature_ids(spark, sf_dir):
    """Ids of foreign features: map ids are used as they are, others get a prefix; the part after the first separator;
    a default confidence."""
    rest = F.substring(F.col("id"), F.instr("id", "/") + 1, F.length("id"))
    own = F.when(F.col("id").rlike("^(node|way|relation)/[0-9]+$"), F.col("id")).otherwise(F.concat(F.lit("other/"), "id"))
    return places(spark, sf_dir).select(own.alias("feature_id"), F.substring_index("id", "/", 1).alias("kind"), rest.alias("ref"), F.coalesce(F.col("admin_level") / 10, F.lit(0.5)).alias("confidence"))


@query("""WITH i AS (SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS start_s, o_custkey % 600 AS walk_in, o_orderkey % 400 AS walk_out, (o_orderkey % 5) * 600 + 300 AS ride FROM orders)
SELECT id, start_s - walk_in AS start_s, start_s + ride + walk_out AS end_s, walk_in + ride + walk_out AS duration_s, 'walk ' || walk_in || ', ride ' || ride || ', walk ' || walk_out AS legs FROM i""")
def walk_legs(spark, sf_dir):
    """Rides with a walk before and after: earlier start, later end, one list of legs."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("s"), (F.col("o_custkey") % 600).alias("a"), (F.col("o_orderkey") % 400).alias("b"), (F.col("o_orderkey") % 5 * 600 + 300).alias("ride")
    )
    leg = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("seconds"))
    legs = F.concat(F.array(leg("walk", "a")), F.array(leg("ride", "ride")), F.array(leg("walk", "b")))
    shown = F.array_join(F.transform(legs, lambda x: F.concat_ws(" ", x["kind"], x["seconds"])), ", ")
    total = F.aggregate(legs, F.lit(0).cast("long"), lambda n, x: n + x["seconds"])
    return o.select("id", (F.col("s") - F.col("a")).alias("start_s"), (F.col("s") + F.col("ride") + F.col("b")).alias("end_s"), total.alias("duration_s"), shown.alias("legs"))


@query(f"WITH {P}, n AS (SELECT id, name, unnest(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM p WHERE name IS NOT NULL), c AS (SELECT w, count(DISTINCT id) AS places FROM n WHERE w <> '' GROUP BY 1) SELECT w AS word, places FROM c WHERE places >= 2")
def name_words(spark, sf_dir):
    """The search vocabulary: each word of names with the places that have it."""
    rows = places(spark, sf_dir).where("name is not null").select("id", F.explode(txt.words("name")).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("places")).where("places >= 2")
