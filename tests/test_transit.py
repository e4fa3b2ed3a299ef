import pytest
from pyspark.sql import functions as F

from geoloom.operators import transit as t


def test_patterns(spark):
    calls = {"X1": "ABD", "X2": "ABD", "Y1": "ABD", "Z1": "ABBCD"}
    rows = [(k, k[0], 0, i, s, s) for k, stops in calls.items() for i, s in enumerate(stops)]
    df = spark.createDataFrame(rows, "trip_id string, route_id string, direction_id int, seq int, tie string, station string")
    got = {(r.route_id, r.stop_seq) for r in t.trip_patterns(df).collect()}
    assert got == {("X", ",A,B,D,"), ("Y", ",A,B,D,"), ("Z", ",A,B,C,D,")}


def test_shapes_and_bikes(spark):
    trips = spark.createDataFrame([("r", "a", 1, 1), ("r", "b", 2, 1), ("r", "b", 3, 0), ("q", "y", 4, 1), ("q", "x", 5, 1), ("q", " ", 6, 1), (None, "a", 7, 1), ("n", None, 8, 0)], "route_id string, shape_id string, seen int, bikes_allowed int")
    assert {(r.route_id, r.shape_id) for r in t.canonical_shape(trips).collect()} == {("r", "b"), ("q", "y")}
    assert {(r.route_id, r.bikes) for r in t.bikes_allowed(trips).collect()} == {("r", 1), ("q", 2), ("n", 0)}


def test_complex_is_one_hop(spark):
    stops = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B"), ("c1", "C")], "stop string, station string")
    links = spark.createDataFrame([("a1", "b1"), ("b1", "c1")], "a string, b string")
    got = {(r.stop, r.member) for r in t.station_complex(stops, links).where("stop = 'a2'").collect()}
    assert got == {("a2", "a1"), ("a2", "a2"), ("a2", "b1")}


def test_interpolation(spark):
    kind = "trip_id string, calls array<struct<lat:double,lon:double,arrival:bigint,departure:bigint>>"
    rows = [
        ("mid", [(0.0, 0.0, None, 940), (0.0, 2.0, 1060, 1061)]), ("soon", [(5.0, 5.0, 1090, 1090), (6.0, 6.0, 2000, 2000)]), ("later", [(5.0, 5.0, 1200, 1200), (6.0, 6.0, 2000, 2000)]),
        ("one", [(0.0, 0.0, 900, 900)]), ("over", [(0.0, 0.0, 1, 2), (1.0, 1.0, 3, 4)]), ("none", []),
    ]
    got = {r.trip_id: r for r in t.interpolate(spark.createDataFrame(rows, kind), F.lit(1000)).collect()}
    assert (got["mid"].lat, got["mid"].lon) == (0.0, 1.0) and got["mid"].bearing == pytest.approx(90)
    assert (got["soon"].lat, got["soon"].speed) == (5.0, 0.0)
    assert all(got[k].lat is None for k in ("later", "one", "over", "none"))


def test_along_line(spark):
    line = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0))])
    got = spark.range(1).select(t.along_line(F.lit(0.5), F.lit(1.1), line)).first()[0]
    assert got == pytest.approx(111194.9 * 1.5, rel=1e-4)


def test_segments(spark):
    d = spark.createDataFrame([(1, "surface", 0, 2, "a"), (1, "surface", 2, 3, "a"), (1, "road", 0, 3, "x")], "line int, kind string, from_i int, to_i int, value string")
    cover = t.cover_breakpoints(d, "line").groupBy("line", "from_i", "to_i").pivot("kind", ["surface", "road"]).agg(F.first("value"))
    assert [tuple(r) for r in t.merge_runs(cover, "line", "from_i", "to_i", ["surface", "road"]).select("from_i", "to_i", "surface", "road").collect()] == [(0, 3, "a", "x")]


def test_previous_position(spark):
    rows = [("v", 1, "2024-01-01 00:00:00", 1.0), ("v", 2, "2024-01-01 00:01:00", 2.0), ("v", 3, "2024-01-01 00:01:30", 2.0), ("v", 4, "2024-01-01 00:09:00", 3.0)]
    df = spark.createDataFrame(rows, "vehicle_id string, event_id int, ts string, lat double").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("lon", F.lit(0.0))
    assert [(r.event_id, r.prev_lat) for r in t.previous_positions(df).orderBy("event_id").collect()] == [(1, None), (2, 1.0), (3, None), (4, None)]


def test_gbfs_and_grid(spark):
    kind = "num_bikes_available bigint, num_ebikes_available bigint, types array<struct<vehicle_type_id:string,count:bigint>>, is_renting boolean"
    rows = [(5, None, [("electric_bike", 2)], None), (3, 1, None, False), (None, None, [], True)]
    got = [(r.bikes, r.ebikes, r.renting) for r in t.available(spark.createDataFrame(rows, kind)).collect()]
    assert got == [(3, 2, True), (2, 1, False), (0, 0, True)]
    stops = spark.createDataFrame([("a", 0.0, 0.0, 10), ("b", 0.0001, 0.0, 20), ("c", 0.0, 0.0001, 20), ("d", 1.0, 1.0, 5)], "id string, lat double, lon double, remaining int")
    assert sorted(r.id for r in t.grid_dedupe(stops, 0.001).collect()) == ["b", "d"]
    assert tuple(t.coarsest_cell(stops, 2).first()) == (0.0005, 2)
    small, large = (t.reach_cells(stops.withColumn("remaining", F.col("remaining") * k), 0.0005) for k in (5, 10))
    assert small.exceptAll(large).count() == 0 < small.count() < large.count()


def test_nearest_entrance_prefers_tier(spark):
    m = 1 / 111195
    rows = [("far", {"railway": "subway_entrance"}, 300 * m), ("near", {"railway": "crossing"}, 20 * m), ("platform", {"railway": "platform"}, 0.0), ("lift", {"highway": "elevator"}, 30 * m)]
    df = spark.createDataFrame([(k, k, g, y, 0.0) for k, g, y in rows], "id string, name string, tags map<string,string>, lat double, lon double")
    assert t.nearest_entrance(df, 0.0, 0.0).first().id == "far"
    assert t.nearest_entrance(df.where("id != 'far'"), 0.0, 0.0).first().id == "lift"
    assert t.nearest_entrance(df.where("id in ('near', 'lift')"), 0.0, 0.0).first().id == "near"
    assert t.nearest_entrance(df.limit(0), 0.0, 0.0).count() == 0
