import math

import pytest
from pyspark.sql import functions as F

from geoloom.operators import journeys as j
from geoloom.operators.dualtree import inside, rings_of
from geoloom.operators.pipeline import store_places


def test_requests():
    assert j.parse_mode(None) == "walk" and j.parse_mode(" Cycling ") == "bike"
    assert j.parse_durations("600, 300,600.2") == [300, 600] and j.parse_durations(None) == [900]
    for bad in ("0", "x", "99999", "1,2,3,4,5,6,7", "-5"):
        with pytest.raises(ValueError):
            j.parse_durations(bad)
    with pytest.raises(ValueError):
        j.parse_mode("boat")
    j.check_origin(90, -180)
    for lat, lon in ((91, 0), (0, 181), (math.nan, 0)):
        with pytest.raises(ValueError):
            j.check_origin(lat, lon)


def test_buckets_and_radius(spark):
    df = spark.createDataFrame([([300, 600, 900],), ([300, 700],), ([300],), ([],), (None,)], "d array<int>")
    assert [r[0] for r in df.select(F.coalesce(j.in_equal_steps(F.col("d")), F.lit(False))).collect()] == [True, False, False, False, False]
    df = spark.createDataFrame([(60,), (1000,), (9000,)], "s int")
    assert [r[0] for r in df.select(j.access_radius_m(F.col("s"))).collect()] == [500.0, 1250.0, 2500.0]


def test_outlines_are_valid(spark):
    cells = [("ring", y, x) for y in range(5) for x in range(5) if not (1 <= y <= 3 and 1 <= x <= 3)] + [("ring", 2, 2)]  # a hole with an island
    cells += [("corner", 0, 0), ("corner", 1, 1), ("corner", 1, 1), ("one", -3, 7)]
    rows = {r.g: r for r in j.outlines(spark.createDataFrame(cells, "g string, y bigint, x bigint"), "g", 0.5).collect()}
    assert (rows["ring"].cells, rows["ring"].holes, rows["ring"].rings) == (17, 1, 3) and rows["corner"].cells == 2 and rows["one"].edges == 4
    for g, r in rows.items():
        found = rings_of(r.wkt)
        for y in range(-5, 10):
            for x in range(-5, 10):
                hit = inside(found, F_array(x * 0.5), F_array(y * 0.5))[0]
                assert hit == ((g, y, x) in cells), (g, y, x)
    assert j.outlines(spark.createDataFrame([], "g string, y bigint, x bigint"), "g", 0.5).count() == 0


def F_array(v):
    import numpy as np

    return np.array([v], float)


def test_polygons_and_circles_unite(spark):
    areas = spark.createDataFrame([(1, "POLYGON((-0.1 -0.1, 4.1 -0.1, 4.1 1.1, -0.1 1.1, -0.1 -0.1))"), (1, None), (2, "POLYGON EMPTY")], "g int, geom string")
    filled = j.cells_of_polygon(areas, "g", 1.0)
    assert filled.count() == 10
    more = spark.createDataFrame([(1, 2, 2)], "g int, y bigint, x bigint")
    (r,) = j.outlines(filled.unionByName(more), "g", 1.0).collect()
    assert (r.cells, r.rings, r.holes) == (11, 1, 0)


def test_transfers_and_itineraries(spark):
    pairs = spark.createDataFrame([("a", "b", 200.0), ("b", "c", 10.0)], "a string, b string, distance_m double")
    assert sorted(map(tuple, j.transfer_links(pairs).collect())) == [("a", "b", 160), ("b", "a", 160), ("b", "c", 60), ("c", "b", 60)]
    found = spark.createDataFrame([(1, 50, "x", 1), (1, 40, "x", 2), (1, 40, "y", 3), (1, 90, "z", 4)], "request_id int, duration_s int, signature string, pos int")
    assert sorted((r.place, r.signature) for r in j.rank_itineraries(found, 2).collect()) == [(1, "x"), (2, "y")]


def test_freshness(spark):
    rows = spark.range(100)
    mark = lambda *r: spark.createDataFrame([r], "completed_at string, row_count bigint, version int")
    fresh = lambda m: j.is_fresh(m, rows, 2).first().fresh
    assert fresh(mark("2024", 95, 2)) and not fresh(mark("2024", 80, 2)) and not fresh(mark("2024", 100, 1)) and not fresh(mark(None, 100, 2))
    assert not fresh(mark("2024", 95, 2).limit(0))


def test_a_box_reads_few_row_groups(spark, tmp_path):
    rows = spark.range(40_000).select(F.col("id"), (F.col("id") % 200 / 10).alias("lat"), (F.floor(F.col("id") / 200) / 10).alias("lon"), F.sha2(F.col("id").cast("string"), 512).alias("ballast"))
    path = str(tmp_path / "p")
    store_places(rows.repartition(8), path, partitions=32)
    box = spark.read.parquet(path).where("lat between 5.0 and 5.5 and lon between 5.0 and 5.5")
    assert "GreaterThanOrEqual(lat,5.0)" in box._jdf.queryExecution().executedPlan().toString()
    import glob

    import pyarrow.parquet as pq

    groups = [pq.ParquetFile(f).metadata.row_group(k) for f in glob.glob(f"{path}/*.parquet") for k in range(pq.ParquetFile(f).metadata.num_row_groups)]
    columns = {groups[0].column(k).path_in_schema: k for k in range(groups[0].num_columns)}

    def touches(g):
        return all(g.column(columns[c]).statistics.min <= 5.5 and g.column(columns[c]).statistics.max >= 5.0 for c in ("lat", "lon"))

    assert len(groups) >= 24 and sum(map(touches, groups)) <= len(groups) / 3
