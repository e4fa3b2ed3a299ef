"""Streaming queries, run over what is available and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.plans.transit import V
from geoloom.streaming.run import append_all, file_stream, upsert_all
from geoloom.streaming.stateful import previous_positions, suppress_repeats, windowed_counts

LATE = "35 days"  # the table's files hold a month in no order, so nothing of it counts as late

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark, sf_dir):
    return file_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT strftime(time_bucket(INTERVAL 60 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_usage_window(spark, sf_dir):
    out = upsert_all(windowed_counts(events(spark, sf_dir), "60 minutes", LATE), ["w", "event_type"])
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(f"""WITH {V}, l AS (SELECT *, lag(lat) OVER w AS pa, lag(lon) OVER w AS po, lag(ts) OVER w AS pt FROM v WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, event_id)),
k AS (SELECT *, epoch_us(ts) - epoch_us(pt) <= 7200 * 1000000::BIGINT AND (lat <> pa OR lon <> po) AS ok FROM l)
SELECT event_id, vehicle_id, round(lat, 4) AS lat, round(lon, 4) AS lon, CASE WHEN ok THEN round(pa, 4) END AS prev_lat, CASE WHEN ok THEN round(po, 4) END AS prev_lon FROM k""")
def stream_prev_position(spark, sf_dir):
    e = events(spark, sf_dir).select(
        "ts", "event_id", F.col("user_id").alias("vehicle_id"), F.unix_micros("ts").alias("us"),
        (F.lit(25.0) + F.floor("value") % 20 / 100).alias("lat"), (F.lit(-55.0) - F.floor(F.col("value") * 3) % 20 / 100).alias("lon"),
    )
    out = append_all(previous_positions(e, ttl_s=7200, late=LATE))
    return out.select("event_id", "vehicle_id", *[F.round(c, 4).alias(c) for c in ("lat", "lon", "prev_lat", "prev_lon")])


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_type, event_id, i, ts, ts AS last, TRUE AS let FROM e WHERE i = 1 UNION ALL
 SELECT e.user_id, e.event_type, e.event_id, e.i, e.ts, CASE WHEN e.ts >= w.last + INTERVAL 6 HOUR THEN e.ts ELSE w.last END, e.ts >= w.last + INTERVAL 6 HOUR FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.i = w.i + 1)
SELECT user_id, event_type, event_id FROM w WHERE let""")
def stream_dedup(spark, sf_dir):
    e = events(spark, sf_dir).select("ts", "user_id", "event_type", "event_id", F.unix_micros("ts").alias("us"))
    return append_all(suppress_repeats(e, ["user_id", "event_type"], 6 * 3600, late=LATE)).select("user_id", "event_type", "event_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def stream_latest_status(spark, sf_dir):
    """The newest row of each key, kept up to date."""
    latest = events(spark, sf_dir).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("m"))
    return upsert_all(latest, ["user_id"]).select("user_id", "m.event_type", "m.value")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS arrival FROM events WHERE ts > TIMESTAMP '2024-01-15' GROUP BY 1")
def stream_next_stop(spark, sf_dir):
    """The first update still to come of each key."""
    rows = events(spark, sf_dir).where(F.col("ts") > F.to_timestamp(F.lit("2024-01-15 00:00:00")))
    out = upsert_all(rows.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("m")), ["user_id"])
    return out.select("user_id", "m.event_id", F.date_format("m.ts", "yyyy-MM-dd HH:mm:ss").alias("arrival"))


@query("""SELECT e.event_id, n.n_name AS nation, e.event_type FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE e.event_type IN ('purchase', 'error')""")
def stream_static_join(spark, sf_dir):
    """A stream enriched from tables by two left joins."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n_nationkey"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.col("n_name").alias("nation"))
    rows = events(spark, sf_dir).where(F.col("event_type").isin("purchase", "error")).join(c, "user_id", "left").join(n, "n_nationkey", "left")
    return append_all(rows.select("event_id", "nation", "event_type"))
