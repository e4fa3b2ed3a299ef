import datetime as dt

from pyspark.sql import functions as F

from geoloom.streaming.run import append_all, file_stream, upsert_all
from geoloom.streaming.stateful import previous_positions, suppress_repeats, windowed_counts


def files(spark, folder, name, batches, kind):
    path = f"{folder}/{name}.parquet"
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def timed(stream):
    return stream.withColumn("ts", F.timestamp_micros(F.col("us") + 1_000_000_000_000))  # rows at the epoch would be late at once


def test_state_goes_when_it_can_no_longer_be_used(spark, tmp_path):
    s = 1_000_000
    batches = [[(v, v, 0, 1.0, 0.0) for v in range(20)], [(100, 100, 5000 * s, 1.0, 0.0)], [(101, 101, 5001 * s, 1.0, 0.0)], [(102, 102, 5002 * s, 1.0, 0.0)]]
    stream = files(spark, tmp_path, "x", batches, "vehicle_id bigint, event_id bigint, us bigint, lat double, lon double")
    q = previous_positions(timed(stream), late="10 seconds").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) >= 20 and held[-1] <= 3


def test_positions_across_batches(spark, tmp_path):
    kind = "vehicle_id bigint, event_id bigint, us bigint, lat double, lon double"
    s = 1_000_000
    stream = files(spark, tmp_path, "v", [[(1, 2, 60 * s, 2.0, 0.0), (1, 1, 0, 1.0, 0.0)], [(1, 3, 90 * s, 3.0, 0.0), (1, 4, 95 * s, 3.0, 0.0)], [(1, 5, 900 * s, 4.0, 0.0)]], kind)
    got = {r.event_id: r.prev_lat for r in append_all(previous_positions(timed(stream))).collect()}
    assert got == {1: None, 2: 1.0, 3: 2.0, 4: None, 5: None}


def test_suppression(spark, tmp_path):
    s = 1_000_000
    stream = files(spark, tmp_path, "s", [[("a", 1, 0), ("a", 2, 5 * s), ("b", 3, 6 * s)], [("a", 4, 9 * s), ("a", 5, 10 * s), ("a", 6, 11 * s)]], "k string, event_id bigint, us bigint")
    assert sorted(r.event_id for r in append_all(suppress_repeats(timed(stream), ["k"], 10)).collect()) == [1, 3, 5]


def test_windows_and_upsert(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    stream = files(spark, tmp_path, "w", [[(t(1), "x", 1.0), (t(5), "x", 2.0)], [(t(6), "x", 3.0), (t(30), "y", 1.0)]], "ts timestamp, event_type string, value double")
    out = upsert_all(windowed_counts(stream, "10 minutes", "1 day"), ["w", "event_type"])
    assert sorted((r.event_type, r.n, r.total) for r in out.collect()) == [("x", 3, 6.0), ("y", 1, 1.0)]


def test_single_file_as_stream(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "d"))
    part = next((tmp_path / "d").glob("part-*.parquet"))
    part.rename(tmp_path / "events.parquet")
    assert append_all(file_stream(spark, str(tmp_path), "events").select((F.col("id") * 2).alias("x"))).count() == 5
