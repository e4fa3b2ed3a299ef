import json

import pytest

from geoloom.operators.enrich import brand_catalogue, road_crossings
from geoloom.sources import feeds, gtfs, osm, sinks


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.txt").write_text(text, encoding="utf-8")
    return str(folder)


def test_gtfs(spark, tmp_path):
    d = write(
        tmp_path,
        stops='﻿stop_id,stop_name,stop_lat,stop_lon,location_type,extra\nA,"A, north",40.0,-73.0,1,x\nB, Zürich ,40.1,-73.1,,\nC,no place,,-73\n\nD,late,x,1,0\n',
        agency="agency_id,agency_name\n,First\n,Last\n", routes="route_id,agency_id,route_short_name,route_type\nr1,,1,0\nr2,,2,1\nr3,zz,3,bad\n",
        transfers="from_stop_id,to_stop_id,transfer_type,min_transfer_time\nA,B,2,120\nA,,1,\nB,A,,\n", shapes="shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\ns,1,2,2\ns,3,4,1\ns,x,4,3\n",
        stop_times="trip_id,stop_id,stop_sequence\nt,A,\nt,B,\n",
    )
    rows = {r.stop_id: r for r in gtfs.stops(gtfs.read_file(spark, d, "stops")).collect()}
    assert set(rows) == {"A", "B"} and rows["A"].stop_name == "A, north" and rows["B"].stop_name == "Zürich" and rows["B"].location_type == 0 and rows["A"].platform_code is None
    agency = gtfs.agencies(gtfs.read_file(spark, d, "agency"))
    routes = {r.route_id: (r.route_type, r.agency_name) for r in gtfs.routes(gtfs.read_file(spark, d, "routes"), agency).collect()}
    assert routes == {"r1": (3, "Last"), "r2": (1, "Last"), "r3": (3, None)}
    assert gtfs.routes(gtfs.read_file(spark, d, "routes"), agency, True).where("route_id = 'r1'").first().route_type == 0
    assert [tuple(r) for r in gtfs.transfers(gtfs.read_file(spark, d, "transfers")).collect()] == [("A", "B", 2, 120), ("B", "A", 0, None)]
    assert gtfs.shapes(gtfs.read_file(spark, d, "shapes")).first().coordinates == [[4.0, 3.0], [2.0, 1.0]]
    assert [r.stop_sequence for r in gtfs.stop_times(gtfs.read_file(spark, d, "stop_times")).orderBy("stop_id").collect()] == [0, 1]


def test_bbox():
    assert gtfs.parse_bbox("global") is None and gtfs.parse_bbox(" -1, 2, 3,4 ") == (-1, 2, 3, 4) and gtfs.parse_bbox("Home", {"home": (0, 0, 1, 1)}) == (0, 0, 1, 1)
    for bad in ("nowhere", "3,2,-1,4", "-200,0,1,1", "1,2,3"):
        with pytest.raises(ValueError):
            gtfs.parse_bbox(bad)


def test_osm(spark, tmp_path):
    rows = [
        {"type": "node", "id": 1, "tags": {"amenity": "cafe", "name": "Big Blue Cup", "iata": "BB"}, "geometry": "POINT(1 2)"}, {"type": "node", "id": 2, "tags": {}},
        {"type": "way", "id": 3, "closed": True, "tags": {"building": "yes"}, "geometry": "POLYGON((0 0, 0.001 0, 0.001 0.001, 0 0.001, 0 0))"}, {"type": "way", "id": 4, "closed": True, "tags": {"area": "no", "highway": "cycleway", "oneway": "-1", "bridge": "no"}},
        {"type": "relation", "id": 5, "tags": {"type": "route", "route": "bicycle", "network": "rcn"}}, {"type": "relation", "id": 6, "tags": {"type": "other"}},
        {"type": "relation", "id": 7, "tags": {"type": "site", "public_transport": "stop_area", "name": "S"}, "members": [{"type": "node", "ref": 1, "role": "entrance"}]},
    ]
    (tmp_path / "o.json").write_text("\n".join(map(json.dumps, rows)))
    objects = osm.read_objects(spark, str(tmp_path / "o.json"))
    got = {r.id: r for r in osm.places(objects).collect()}
    assert {k: r.geom_type for k, r in got.items()} == {"node/1": "point", "way/3": "area", "way/4": "line", "relation/5": "line", "relation/7": "area"}
    assert got["node/1"].codes == ["bb"] and got["node/1"].name_abbrev == "bbc" and got["way/3"].area_m2 == pytest.approx(12364, rel=0.01)
    assert [(r.osm_id, r.infra_type, r.oneway, r.bridge) for r in osm.bicycle_ways(objects).collect()] == [(4, "cycleway", -1, False)]
    assert [(r.osm_id, r["mask"]) for r in osm.bicycle_routes(objects).collect()] == [(5, 2)]
    assert [tuple(r) for r in osm.stop_area_members(objects).collect()] == [(7, "S", "N", 1, "entrance")]


def test_feeds(spark):
    v3 = json.dumps({"data": {"feeds": [{"name": "a", "url": "u"}]}})
    v2 = json.dumps({"data": {"en": {"feeds": [{"name": "b", "url": "w"}]}}})
    got = feeds.discovered_feeds(spark.createDataFrame([(1, v3), (2, v2), (3, "bad")], "system int, body string"))
    assert sorted(map(tuple, got.collect())) == [(1, "a", "u"), (2, "b", "w")]
    status = json.dumps({"data": {"stations": [{"station_id": "s", "num_bikes_available": 5, "vehicle_types_available": [{"vehicle_type_id": "electric", "count": 2}]}]}})
    assert feeds.station_status(spark.createDataFrame([(1, status)], "system int, body string")).first().types[0]["count"] == 2
    live = json.dumps({"entity": [{"id": "e", "vehicle": {"trip": {"tripId": "t"}, "position": {"latitude": 1.0, "longitude": 2.0}}}, {"id": "x", "vehicle": {"position": {}}}]})
    assert [(r.vehicle_id, r.lat) for r in feeds.vehicle_positions(spark.createDataFrame([("f", live)], "feed string, body string")).collect()] == [("e", 1.0)]
    free = spark.createDataFrame([("a", "k", 1.0, 1.0, None, None, 0.555), ("b", "z", 1.0, 1.0, True, None, None), ("c", "z", 1.0, 2.0, False, False, None)], "vehicle_id string, vehicle_type_id string, lat double, lon double, is_reserved boolean, is_disabled boolean, charge double")
    forms = spark.createDataFrame([("k", "scooter")], "vehicle_type_id string, form_factor string")
    assert sorted((r.vehicle_id, r.form, r.battery_pct) for r in feeds.free_vehicles(free, forms).collect()) == [("a", "scooter", 56), ("c", "bicycle", None)]
    urls = spark.createDataFrame([("x/VehiclePositions.pb",), ("x/trip-updates",), ("x/alerts",)], "url string")
    assert [r[0] for r in urls.select(feeds.url_kind()).collect()] == ["vehicles", "updates", "other"]


def test_region_index(spark, tmp_path):
    f = {"features": [{"properties": {"id": "a", "name": "A", "urls": {"pbf": "u"}}, "geometry": {"type": "Polygon", "coordinates": [[[0, 1], [2, 3]]]}}, {"properties": {"id": "b", "urls": {}}}]}
    (tmp_path / "i.json").write_text(json.dumps(f))
    rows = feeds.region_index(spark, str(tmp_path / "i.json")).withColumn("box", feeds.box_of_coordinates("coordinates")).collect()
    assert [(r.id, r.box) for r in rows] == [("a", [0.0, 1.0, 2.0, 3.0])]


def test_sinks(spark, tmp_path):
    path, kind = str(tmp_path / "t"), "stop_id string, v int, feed_id string"
    read = lambda: sorted(map(tuple, spark.read.parquet(path).select("feed_id", "stop_id", "v").collect()))
    sinks.replace_by_feed(spark.createDataFrame([("a", 1, "f"), ("b", 2, "f"), ("a", 3, "g")], kind), path)
    sinks.replace_by_feed(spark.createDataFrame([("c", 4, "f")], kind), path)
    assert read() == [("f", "c", 4), ("g", "a", 3)]
    sinks.upsert(spark.createDataFrame([("c", 5, "f"), ("d", 6, "f"), ("d", 7, "f")], kind), path, ["feed_id", "stop_id"])
    assert read() == [("f", "c", 5), ("f", "d", 7), ("g", "a", 3)]
    sinks.upsert(spark.createDataFrame([("c", 9, "f"), ("e", 9, "f")], kind), path, ["feed_id", "stop_id"], keep_old=True)
    assert read() == [("f", "c", 5), ("f", "d", 7), ("f", "e", 9), ("g", "a", 3)]


def test_crossings(spark):
    line = lambda *p: [(float(x), float(y)) for x, y in p]
    rows = [("1", "B St", line((0, 0), (0.01, 0.01))), ("2", "A Rd", line((0, 0.01), (0.01, 0))), ("3", "A Rd", line((0, 0.005), (0.01, 0.005))), ("4", None, line((0, 0), (1, 1))), ("5", "C Ln", line((0.005, 0), (0.005, 0.01)))]
    df = spark.createDataFrame(rows, "id string, name string, line array<struct<lon:double,lat:double>>")
    assert [tuple(r) for r in road_crossings(df).select("lon", "lat", "name").collect()] == [(0.005, 0.005, "A Rd & B St & C Ln")]


def test_brands(spark):
    rows = [("a", {"brand": "Foo", "brand:wikidata": "Q1"}), ("b", {"brand": "FOO", "brand:wikidata": "Q1"}), ("c", {"brand": "Foo", "brand:wikidata": "Q1"}), ("d", {"brand": "Solo"}), ("e", {"brand": "Bar  x"}), ("f", {"brand": "bar x"}), (None, {"brand": "bar x"})]
    df = spark.createDataFrame([(n, g, ["shop/x"], "POINT(1 2)") for n, g in rows], "name string, tags map<string,string>, categories array<string>, centroid string")
    got = {r.brand_key: (r.name, r.location_count, r.wikidata) for r in brand_catalogue(df).collect()}
    assert got == {"Q1": ("Foo", 3, "Q1"), "name:bar x": ("Bar  x", 2, None)}
