"""Queries of usage counters and signals, set operations and the like."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.operators.rolling import latest_versions
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


KEYS = ["user_id", "api_key_id", "day", "endpoint"]


def counters(spark, sf_dir):
    """One row per counter, its newest version."""
    return latest_versions(table(spark, sf_dir, "accounts_usage"), KEYS, "updated_at", ["requests", "credits", "rejected"])


C = """c AS (SELECT user_id, api_key_id, day, endpoint, v[2]::BIGINT AS requests, v[3]::BIGINT AS credits, v[4]::BIGINT AS rejected FROM (
  SELECT user_id, api_key_id, day, endpoint, max(row(updated_at, coalesce(requests, 0), coalesce(credits, 0), coalesce(rejected, 0))) AS v FROM accounts_usage GROUP BY 1, 2, 3, 4))"""


@query(f"WITH {C} SELECT strftime(day, '%Y-%m-%d') AS day, sum(requests)::BIGINT AS requests, sum(credits)::BIGINT AS credits, sum(rejected)::BIGINT AS rejected, count(DISTINCT user_id) AS users FROM c GROUP BY 1")
def usage_by_day(spark, sf_dir):
    g = counters(spark, sf_dir).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"))
    return g.agg(F.sum("requests").alias("requests"), F.sum("credits").alias("credits"), F.sum("rejected").alias("rejected"), F.countDistinct("user_id").alias("users"))


@query(f"WITH {C} SELECT user_id, api_key_id, sum(requests)::BIGINT AS requests, sum(credits)::BIGINT AS credits FROM c WHERE day BETWEEN DATE '2025-03-01' AND DATE '2025-03-31' GROUP BY 1, 2")
def usage_by_key(spark, sf_dir):
    rows = counters(spark, sf_dir).where(F.col("day").between(F.lit("2025-03-01").cast("date"), F.lit("2025-03-31").cast("date")))
    return rows.groupBy("user_id", "api_key_id").agg(F.sum("requests").alias("requests"), F.sum("credits").alias("credits"))


@query(f"WITH {C} SELECT user_id, strftime(date_trunc('month', day), '%Y-%m-%d') AS cycle, sum(credits)::BIGINT AS used, sum(CASE WHEN credits < 0 THEN -credits ELSE 0 END)::BIGINT AS refunded FROM c GROUP BY 1, 2")
def credit_balance(spark, sf_dir):
    """Credits used in each calendar month, with what was given back."""
    g = counters(spark, sf_dir).groupBy("user_id", F.date_format(F.trunc("day", "MM"), "yyyy-MM-dd").alias("cycle"))
    return g.agg(F.sum("credits").alias("used"), F.sum(F.greatest(-F.col("credits"), F.lit(0))).alias("refunded"))


@query(f"WITH {C} SELECT user_id, endpoint, sum(credits)::BIGINT AS credits FROM c GROUP BY 1, 2 HAVING sum(credits) > 0")
def burn_rate(spark, sf_dir):
    return counters(spark, sf_dir).groupBy("user_id", "endpoint").agg(F.sum("credits").alias("credits")).where("credits > 0")


@query(f"WITH {C} SELECT user_id, sum(rejected)::BIGINT AS rejected, sum(requests)::BIGINT AS requests FROM c GROUP BY 1 HAVING sum(rejected) > 10 AND 100 * sum(rejected) > sum(requests)")
def rejected_share(spark, sf_dir):
    """Users with many rejections in proportion to what was served."""
    out = counters(spark, sf_dir).groupBy("user_id").agg(F.sum("rejected").alias("rejected"), F.sum("requests").alias("requests"))
    return out.where((F.col("rejected") > 10) & (100 * F.col("rejected") > F.col("requests")))


@query("SELECT user_id, count(*) AS signups FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-15' - INTERVAL 10 DAY AND ts < TIMESTAMP '2024-01-15' GROUP BY 1 HAVING count(*) >= 6")
def multi_account(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'signup' and ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-15'")
    return rows.groupBy("user_id").agg(F.count("*").alias("signups")).where("signups >= 6")


@query("""SELECT user_id, strftime(time_bucket(INTERVAL 60 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 2""")
def throttle_window(spark, sf_dir):
    """Users with more than two events in an aligned hour."""
    g = table(spark, sf_dir, "events").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "60 minutes").alias("w")).agg(F.count("*").alias("n")).where("n > 2")
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, i, ts, ts AS start, 1 AS n FROM e WHERE i = 1 UNION ALL
 SELECT e.user_id, e.i, e.ts, CASE WHEN e.ts >= w.start + INTERVAL 1 HOUR THEN e.ts ELSE w.start END, CASE WHEN e.ts >= w.start + INTERVAL 1 HOUR THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, count(*) AS hits, count(*) FILTER (WHERE n > 2) AS over_limit FROM w GROUP BY 1""")
def fixed_window_replay(spark, sf_dir):
    """Windows that start with a user's first hit, not on the clock. A pause as long as a window always starts a new
    one, so times are folded per unbroken run of hits, not per user."""
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    e = e.withColumn("new", F.when(F.col("t") - F.lag("t").over(w) < 3_600_000_000, 0).otherwise(1))
    e = e.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    e = e.groupBy("user_id", "run").agg(F.array_sort(F.collect_list("t")).alias("t"))
    start = F.struct(F.lit(-(10**18)).cast("long").alias("start"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("over"))

    def hit(s, t):
        fresh = t >= s["start"] + 3_600_000_000
        n = F.when(fresh, F.lit(1).cast("long")).otherwise(s["n"] + 1)
        return F.struct(F.when(fresh, t).otherwise(s["start"]).alias("start"), n.alias("n"), (s["over"] + F.when(n > 2, 1).otherwise(0)).alias("over"))

    runs = e.select("user_id", F.size("t").cast("long").alias("hits"), F.aggregate("t", start, hit)["over"].alias("over_limit"))
    return runs.groupBy("user_id").agg(F.sum("hits").alias("hits"), F.sum("over_limit").alias("over_limit"))


@query(f"""WITH {C} SELECT (SELECT count(DISTINCT id) FROM geo_places) AS places, (SELECT count(DISTINCT (feed_id, stop_id)) FROM gtfs_stops) AS stops, (SELECT count(*) FROM gtfs_feeds) AS feeds, (SELECT coalesce(sum(route_count), 0)::BIGINT FROM gtfs_feeds) AS routes,
 (SELECT count(*) FROM boundary_catalog) AS regions, count(DISTINCT user_id) AS users, sum(requests)::BIGINT AS requests, strftime(max(day), '%Y-%m-%d') AS last_day FROM c""")
def data_metrics(spark, sf_dir):
    """Counts of all tables in one row: single-row aggregates side by side."""
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        t("geo_places").agg(F.countDistinct("id").alias("places")), t("gtfs_stops").agg(F.countDistinct("feed_id", "stop_id").alias("stops")),
        t("gtfs_feeds").agg(F.count("*").alias("feeds"), F.coalesce(F.sum("route_count"), F.lit(0)).alias("routes")), t("boundary_catalog").agg(F.count("*").alias("regions")),
        counters(spark, sf_dir).agg(F.countDistinct("user_id").alias("users"), F.sum("requests").alias("requests"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("last_day")),
    ]
    out = parts[0].withColumn("one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


@query("SELECT feed_id, round(avg(stop_lat), 5) AS lat, round(avg(stop_lon), 5) AS lon, count(*) AS n FROM (SELECT DISTINCT feed_id, stop_id, stop_lat, stop_lon FROM gtfs_stops) GROUP BY 1 ORDER BY count(*) DESC, feed_id LIMIT 12")
def warm_points(spark, sf_dir):
    s = table(spark, sf_dir, "gtfs_stops").select("feed_id", "stop_id", "stop_lat", "stop_lon").distinct()
    g = s.groupBy("feed_id").agg(F.round(F.avg("stop_lat"), 5).alias("lat"), F.round(F.avg("stop_lon"), 5).alias("lon"), F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "feed_id").limit(12)


@query("SELECT f.feed_id, f.name, b.label AS region, count(DISTINCT s.stop_id) AS stops FROM gtfs_feeds f LEFT JOIN boundary_catalog b ON b.id = f.region LEFT JOIN gtfs_stops s ON s.feed_id = f.feed_id GROUP BY 1, 2, 3")
def feed_overview(spark, sf_dir):
    """Feeds with their region and the stops they have; the stops are counted before they are joined."""
    n = table(spark, sf_dir, "gtfs_stops").groupBy("feed_id").agg(F.countDistinct("stop_id").alias("n"))
    f = table(spark, sf_dir, "gtfs_feeds").select("feed_id", "name", "region").distinct()
    b = table(spark, sf_dir, "boundary_catalog").select(F.col("id").alias("region"), "label")
    return f.join(b, "region", "left").join(n, "feed_id", "left").select("feed_id", "name", F.col("label").alias("region"), F.coalesce("n", F.lit(0)).alias("stops"))


@query("SELECT o_custkey % 50 AS route, o_orderpriority AS fare, min(o_orderkey) AS first_order FROM orders GROUP BY ALL QUALIFY row_number() OVER (PARTITION BY route ORDER BY min(o_orderkey)) = 1".replace("GROUP BY ALL", "GROUP BY 1, 2"))
def first_claim(spark, sf_dir):
    """The first of several claims on a key keeps it."""
    g = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("route"), F.col("o_orderpriority").alias("fare")).agg(F.min("o_orderkey").alias("first_order"))
    return g.withColumn("k", F.row_number().over(W.partitionBy("route").orderBy("first_order"))).where("k = 1").drop("k")


@query("SELECT stop_name, feed_id, stop_id FROM gtfs_stops WHERE stop_name IS NOT NULL GROUP BY ALL QUALIFY row_number() OVER (PARTITION BY stop_name ORDER BY feed_id, stop_id) = 1".replace("GROUP BY ALL", "GROUP BY 1, 2, 3"))
def dedup_first(spark, sf_dir):
    """One row per key, the first in order: the least struct, so no sort is needed."""
    rows = table(spark, sf_dir, "gtfs_stops").where("stop_name is not null")
    return rows.groupBy("stop_name").agg(F.min(F.struct("feed_id", "stop_id")).alias("m")).select("stop_name", "m.*")


@query(f"WITH {C} SELECT endpoint, strftime(date_trunc('month', day), '%Y-%m') AS month, sum(requests)::BIGINT AS requests, grouping(endpoint)::INTEGER * 2 + grouping(date_trunc('month', day))::INTEGER AS level FROM c GROUP BY ROLLUP (endpoint, date_trunc('month', day))")
def usage_rollup(spark, sf_dir):
    """An extension: subtotals by endpoint and month."""
    c = counters(spark, sf_dir).withColumn("month", F.date_format("day", "yyyy-MM"))
    return c.rollup("endpoint", "month").agg(F.sum("requests").alias("requests"), F.grouping_id().cast("int").alias("level"))


@query("""SELECT split_part(split_part(pbf_url, '://', 2), '/', 1) AS host, count(*) AS n, count(*) FILTER (WHERE parent IS NULL) AS roots, max(length(pbf_url)) AS longest FROM boundary_catalog WHERE pbf_url IS NOT NULL GROUP BY 1""")
def region_hosts(spark, sf_dir):
    rows = table(spark, sf_dir, "boundary_catalog").where("pbf_url is not null")
    return rows.groupBy(F.parse_url(F.col("pbf_url"), F.lit("HOST")).alias("host")).agg(F.count("*").alias("n"), F.count_if(F.col("parent").isNull()).alias("roots"), F.max(F.length("pbf_url")).alias("longest"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 49)
SELECT 'both' AS side, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def set_operations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a = li.where("l_returnflag = 'R'").select("l_suppkey").distinct()
    b = li.where("l_returnflag = 'A' and l_quantity > 49").select("l_suppkey").distinct()
    n = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return n(a.intersect(b), "both").unionByName(n(a.exceptAll(b), "only_first")).unionByName(n(a.union(b).distinct(), "either"))
