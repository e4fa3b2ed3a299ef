import math

import pytest
from pyspark.sql import functions as F

from geoloom.functions.geo import haversine_m
from geoloom.functions.shape import circle, in_tile, simplified, simplify_line, tile_box
from geoloom.operators.pipeline import build_places, refresh_context
from geoloom.sources.osm import OBJECT


def objects(spark, city="City"):
    square = "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))"
    rows = [
        ("node", 1, {"amenity": "cafe", "name": "Blue Cup", "addr:street": "Main St"}, "POINT(0.5 0.5)", None, None), ("way", 2, {"highway": "residential", "name": "Main St"}, "LINESTRING(0.4 0.5, 0.402 0.5)", None, None),
        ("way", 3, {"highway": "primary", "name": "Oak Rd"}, "LINESTRING(0.401 0.499, 0.401 0.501)", None, None), ("relation", 4, {"type": "boundary", "boundary": "administrative", "admin_level": "8", "name": city}, square, None, None),
        ("node", 5, {"shop": "x", "name": "Away"}, "POINT(5 5)", None, None), ("node", 6, None, "POINT(0 0)", None, None), ("node", 7, {}, "POINT(0 0)", None, None),
    ]
    return spark.createDataFrame(rows, OBJECT).where("tags is not null and size(tags) > 0")


def test_build(spark):
    got = {r.id: r for r in build_places(objects(spark)).collect()}
    assert set(got) == {"node/1", "way/2", "way/3", "relation/4", "node/5", "intersection/1"}
    assert got["intersection/1"].name == "Main St & Oak Rd" and got["intersection/1"].parent_context == "City"
    assert got["node/1"].parent_context.split() == ["Main", "St", "City"] and {"blue", "cup", "cafe", "city"} <= set(got["node/1"].ts)
    assert got["node/5"].parent_context is None


def test_refresh(spark):
    after = build_places(objects(spark, "Town")).drop("parent_context", "ts", "lat", "lon")
    got = {r.id: r.parent_context for r in refresh_context(after, spark.createDataFrame([("relation/4",)], "id string")).collect()}
    assert got["node/1"].split()[-1] == "Town" and "node/5" not in got
    assert refresh_context(after, spark.createDataFrame([], "id string")).count() == 0


def test_shapes(spark):
    ring = spark.range(1).select(F.explode(circle(F.lit(60.0), F.lit(10.0), 500.0)).alias("v"))
    d = [r[0] for r in ring.select(haversine_m(F.lit(60.0), F.lit(10.0), "v.lat", "v.lon")).collect()]
    assert len(d) == 33 and all(x == pytest.approx(500, abs=0.01) for x in d)
    south, west, north, east = tile_box(1, 0, 0)
    assert (west, east, south) == (-180, 0, pytest.approx(0)) and north == pytest.approx(85.0511, abs=1e-3)
    with pytest.raises(ValueError):
        tile_box(1, 2, 0)
    assert spark.createDataFrame([(10.0, -10.0), (10.0, 10.0)], "lat double, lon double").where(in_tile("lat", "lon", 1, 0, 0)).count() == 1


def test_simplify(spark):
    line = [[x / 1000, 0.0001 * math.sin(x)] for x in range(100)]
    few = simplify_line(line, 30.0)
    assert few == [line[0], line[-1]] and simplify_line(line, 0.0) == line and simplify_line([], 1.0) == []
    ring = [[math.cos(k / 50 * 2 * math.pi), math.sin(k / 50 * 2 * math.pi)] for k in range(50)]
    ring.append(ring[0])
    small = simplify_line(ring, 1e9)
    assert len(small) >= 4 and small[0] == small[-1]
    df = spark.createDataFrame([(line,), (None,)], "l array<array<double>>")
    assert [r[0] for r in df.select(simplified("l", 30.0)).collect()] == [few, None]


def test_store_lets_boxes_skip_row_groups(spark, tmp_path):
    import glob
    import random

    import pyarrow.parquet as pq

    from geoloom.operators.pipeline import store_places

    rnd = random.Random(0)
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(i, rnd.uniform(-80, 80), rnd.uniform(-170, 170)) for i in range(4000)] + [(-1, None, None)], "id int, lat double, lon double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        store_places(df, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", old)
    boxes = []
    for f in glob.glob(f"{path}/*.parquet"):
        md = pq.ParquetFile(f).metadata
        for g in range(md.num_row_groups):
            lat, lon = md.row_group(g).column(1).statistics, md.row_group(g).column(2).statistics
            boxes.append((lat.min, lat.max, lon.min, lon.max))
    touched = [b for b in boxes if b[0] <= 11 and b[1] >= 10 and b[2] <= 11 and b[3] >= 10]
    assert spark.read.parquet(path).count() == 4001 and len(boxes) >= 16 and len(touched) <= len(boxes) / 4
