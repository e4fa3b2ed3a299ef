import math
import random

import numpy as np

from geoloom.operators import dualtree as dtm


def hav(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))


def test_tree_pairs_match_brute_force():
    rng = np.random.default_rng(0)
    for n, m, spread in ((0, 5, 1), (1, 1, 0), (200, 150, 0.02), (300, 40, 0.0)):
        if not n:
            continue
        p, q = rng.normal(0, spread, (n, 2)) + [50, 8], rng.normal(0, spread, (m, 2)) + [50, 8]
        i, j = (np.concatenate(x) for x in zip(*dtm.near_slices(p[:, 0], p[:, 1], q[:, 0], q[:, 1], 800.0)))
        want = {(a, b) for a in range(n) for b in range(m) if hav(*p[a], *q[b]) <= 800.0}
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


def join(spark, points, places, radius=300.0):
    p = spark.createDataFrame(points, "key string, lat double, lon double")
    q = spark.createDataFrame(places, "id string, lon double, lat double, geom string")
    rows = dtm.spatial_join(p, q, radius).collect()
    at, to = {k: (a, o) for k, a, o in points}, {i: (a, o) for i, o, a, _ in places}
    assert all((r.distance_m is None) == (r.rel == "inside") for r in rows)
    assert all(abs(r.distance_m - hav(*at[r.point_key], *to[r.place_id])) < 1e-3 for r in rows if r.rel == "near")
    return sorted((r.rel, r.point_key, r.place_id) for r in rows)


def test_join_with_dense_spot_and_edges(spark, monkeypatch):
    monkeypatch.setattr(dtm, "TILE_ROWS", 40)
    monkeypatch.setattr(dtm, "TASK_ROWS", 100)
    monkeypatch.setattr(dtm, "GROUP_ROWS", 60)
    monkeypatch.setattr(dtm, "SLICE", 50)
    rnd = random.Random(2)
    points = [(f"p{i}", 50 + rnd.gauss(0, 0.03), 8 + rnd.gauss(0, 0.03)) for i in range(150)] + [(f"same{i}", 50.0, 8.0) for i in range(90)]
    points += [("west", 10.0, -179.9999), ("pole", 89.99995, 20.0), ("null", None, 1.0), ("nan", float("nan"), 1.0)]
    places = [(f"q{i}", 8 + rnd.gauss(0, 0.03), 50 + rnd.gauss(0, 0.03), None) for i in range(120)] + [(f"spot{i}", 8.0, 50.0, None) for i in range(60)]
    places += [("east", 179.9999, 10.0, None), ("over", -160.0, 89.99995, None), ("none", None, None, None)]
    got = join(spark, points, places)
    want = sorted(("near", k, i) for k, a, b in points for i, d, c, _ in places if a is not None and c is not None and a == a and hav(a, b, c, d) <= 300.0)
    assert got == want and len(got) > 5400


def test_regions(spark):
    hole = "SRID=4326;POLYGON((0 0, 1 0, 1 1, 0 1, 0 0),(0.4 0.4, 0.6 0.4, 0.6 0.6, 0.4 0.6, 0.4 0.4))"
    multi = "MULTIPOLYGON(((2 0, 3 0, 3 1, 2 1, 2 0)), ((5 5, 6 5, 6 6, 5 6, 5 5)))"
    places = [("hole", None, None, hole), ("multi", None, None, multi), ("empty", None, None, "POLYGON EMPTY"), ("line", None, None, "LINESTRING(0 0, 1 1)"), ("big", None, None, "POLYGON((-20 -20, 20 -20, 20 20, -20 20, -20 -20))")]
    points = [("in", 0.2, 0.2), ("void", 0.5, 0.5), ("second", 5.5, 5.5), ("out", 30.0, 30.0)]
    assert join(spark, points, places) == [("inside", "in", "big"), ("inside", "in", "hole"), ("inside", "second", "big"), ("inside", "second", "multi"), ("inside", "void", "big")]
    assert join(spark, points[:0], places) == [] and join(spark, points, places[:0]) == []


def test_one_spot_in_bounded_memory():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    lat = np.full(dtm.TILE_ROWS, 50.0)
    pairs = sum(len(i) for i, _ in dtm.near_slices(lat, lat, lat, lat, 80.0))
    assert pairs == dtm.TILE_ROWS**2 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # KB


def test_classes_of_coincident_rows(spark):
    points = spark.createDataFrame([(f"p{i:05}", 50.0, 8.0) for i in range(20_000)] + [("q", 51.0, 8.0)], "key string, lat double, lon double")
    places = spark.createDataFrame([(f"a{i:05}", 8.0, 50.0, None) for i in range(20_000)] + [("b", 8.0001, 50.0, None)], "id string, lon double, lat double, geom string")
    pairs, of_points, of_places = dtm.spatial_classes(points, places, 80.0)
    assert sorted((r.point_key, r.place_id) for r in pairs.collect()) == [("p00000", "a00000"), ("p00000", "b")]
    assert sorted(map(tuple, of_points.groupBy("class_id", "links").count().collect())) == [("p00000", 2, 20_000), ("q", 0, 1)]
    assert sorted(map(tuple, of_places.groupBy("class_id", "links").count().collect())) == [("a00000", 1, 20_000), ("b", 1, 1)]
