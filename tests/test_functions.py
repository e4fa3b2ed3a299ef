import math

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo, tags, text
from geoloom.functions.polyline import decode_polyline, encode_polyline, polyline_points
from geoloom.operators.enrich import geometry_area_m2, rings


def values(spark, kind, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


def test_categories(spark):
    rows = [{"amenity": "restaurant", "cuisine": "pizza; thai", "building": "yes", "name": "X"}, {"building": "yes"}, {"shop": "no", "highway": "bus_stop"}, {}, None]
    got = values(spark, "map<string,string>", rows, tags.categories("x"))
    assert got[:4] == [["amenity/restaurant", "building", "cuisine/pizza", "cuisine/thai"], [], ["highway/bus_stop"], []]


def test_names(spark):
    rows = [{"name": "A", "brand": "B", "operator": "A", "name:es": "S", "name:en": "E"}]
    assert values(spark, "map<string,string>", rows, tags.names("x")) == [["A", "B", "E", "S"]]


@pytest.mark.parametrize("row,want", [
    ({"highway": "residential", "cycleway:both": "lane"}, ("cycle_lane", None)), ({"highway": "proposed", "proposed": "cycleway"}, ("cycleway", "proposed")),
    ({"highway": "construction"}, (None, None)), ({"highway": "construction", "construction": "cycleway"}, ("cycleway", "construction")), ({"highway": "cycleway"}, ("cycleway", None)),
    ({"bicycle_road": "yes"}, ("bicycle_road", None)), ({"cyclestreet": "yes", "cycleway": "proposed"}, ("cycle_street", "proposed")), ({"cycleway": "track"}, ("cycle_track", None)),
    ({"cycleway:left": "shared_lane"}, ("shared_lane", None)), ({"cycleway": "opposite_lane"}, ("opposite", None)), ({"shoulder:bicycle": "yes"}, ("shoulder", None)),
    ({"cycleway:right": "construction"}, ("cycle_lane", "construction")), ({"highway": "path", "bicycle": "designated"}, ("path_bicycle", None)),
    ({"highway": "steps", "ramp:bicycle": "yes"}, ("steps_bicycle", None)), ({"highway": "primary", "bicycle": "designated"}, ("bicycle_designated", None)),
    ({"highway": "primary", "bicycle": "yes"}, ("bicycle_yes", None)), ({"bicycle": "yes"}, (None, None)), ({}, (None, None)),
])
def test_bicycle_class(spark, row, want):
    assert tuple(values(spark, "map<string,string>", [row], tags.bicycle_class("x"))[0]) == want


def test_measures(spark):
    assert values(spark, "string", ["50", "30 mph", "5", "200", "x", None], tags.speed_kph("x")) == [50.0, 48.0, None, None, None, None]
    assert values(spark, "string", ["3.5", "3.5 t", "2000 lbs", "500 kg", "7 tons", "x", None], tags.weight_t("x")) == [3.5, 3.5, 1.0, 0.5, 7.0, None, None]
    assert values(spark, "string", ["2.5", "3ft6in", "3'6\"", "250 cm", "2,5", "4 yd", None], tags.measure_m("x")) == [2.5, 1.07, 1.07, 2.5, 2.5, None, None]
    assert values(spark, "string", ["-1;0", "2", "x", None], tags.is_underground("x"), tags.lowest_level("x")) == [(True, -1.0), (False, 2.0), (False, None), (None, None)]
    assert values(spark, "string", ["no_left_turn @ (07:00-09:00)", "no_exit", None], tags.restriction_type("x"), tags.restriction_times("x")) == [("no_left_turn", "(07:00-09:00)"), (None, None), (None, None)]
    assert values(spark, "string", ["a", "b;a", "b;c", "z", None], tags.any_of({"a": "true", "b": "false"}, "x")) == ["true", "true", "false", None, None]
    pay = [{"payment:cash": "yes", "payment:cards": "no"}, {"payment:cash": "yes", "payment:cards": "yes"}, {"payment:coins": "NO"}, {}]
    assert values(spark, "map<string,string>", pay, tags.cash_only("x")) == [True, False, False, False]
    assert values(spark, "array<string>", [["ncn", "lcn", "ncn"], ["mtb"], [], ["zzz"]], tags.network_mask("x")) == [5, 8, 0, 0]


def test_text(spark):
    assert values(spark, "string", ["two words"], text.similarity(F.lit("word"), F.col("x")))[0] == pytest.approx(0.363636, abs=1e-6)
    assert values(spark, "string", ["University of North Carolina", "北京大学", "Starbucks", "A/B C", None], text.abbreviation("x")) == ["unc", None, None, None, None]
    assert values(spark, "map<string,string>", [{"iata": "CLT", "ref": "A;B ; a"}, {}, None], text.codes("x")) == [["a", "b", "clt"], None, None]
    assert values(spark, "string", ["europe/great-britain", "Wales", None], text.pretty_label("x")) == ["Great Britain", "Wales", None]
    assert values(spark, "string", ["Île Ðé", None], text.unaccent("x"))[0].startswith("Ile")
    assert text.sanitise_query("Sal's  Piz#za") == "Sals  Piz za" and text.looks_like_address(" 350 5th") and not text.looks_like_address("a1")
    row = spark.createDataFrame([("Tarn Street & Joe's", ["T"], "X")], "n string, ns array<string>, k string")
    got = row.select(text.search_tokens("n", "ns", F.lit(None).cast("string"), F.array(F.lit("highway/x_y")), F.lit("Ünder"), F.col("k") == "X")).first()[0]
    assert got == ["tarn", "street", "st", "and", "et", "und", "y", "e", "joes", "t", "highway", "x", "under"]


def test_cheap_trigram_filter_is_exact(spark):
    names = ["Market Hall", "market", "Hall of Mars", "", "x", "Ämter Hall", "the market-hall"]
    got = values(spark, "string", names, text.shared_trigrams("x", "market hall"), F.size(F.array_intersect(text.trigrams("x"), text.trigrams(F.lit("market hall")))), text.similarity("x", F.lit("market hall")), text.like_filter("x", "market hall", 0.3))
    assert all(a == b and (keep or sim < 0.3) for a, b, sim, keep in got)


def test_geometry(spark):
    assert values(spark, "string", ["POINT(1 2)", "SRID=4326;POINT (-1.5  2e0)", "POINT EMPTY", "LINESTRING(0 0, 1 1)", None], geo.point_of("x"))[:2] == [(1.0, 2.0), (-1.5, 2.0)]
    one = spark.range(1)
    d = one.select(geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), geo.cosine_law_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(-1.0)), geo.lerp(F.lit(0.0), F.lit(10.0), F.lit(1.5))).first()
    assert d[0] == pytest.approx(111194.9, abs=1) and d[1] == pytest.approx(d[0], abs=0.01) and d[2] == pytest.approx(270) and d[3] == 10
    square = "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0),(0.25 0.25, 0.75 0.25, 0.75 0.75, 0.25 0.75, 0.25 0.25))"
    area = values(spark, "string", [square, "POINT(1 1)", None], geometry_area_m2("x"))
    assert area[0] == pytest.approx(111194.9**2 * 0.75, rel=1e-3) and area[1] == 0
    assert [len(r) for r in values(spark, "string", [square], rings("x"))[0]] == [5, 5]
    south, west, north, east = geo.box_around(60.0, 10.0, 1000)
    assert north - 60 == pytest.approx(1000 / 111320) and east - 10 > 2 * (north - 60) * 0.99 and math.isfinite(geo.box_around(90.0, 0.0, 10)[1])


def test_polyline(spark):
    line = [[8.5, 50.1], [8.50001, 50.2], [-3.0, -4.0]]
    assert decode_polyline(encode_polyline(line)) == line and decode_polyline(None) is None and decode_polyline("") == []
    assert values(spark, "string", [encode_polyline(line), None], polyline_points("x"))[0] == line
