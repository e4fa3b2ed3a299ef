"""Extra columns whose names the operators use inside do no harm."""

import datetime as dt

from pyspark.sql import functions as F

from geoloom.operators.dualtree import spatial_join
from geoloom.operators.hierarchy import resolve_hierarchy
from geoloom.operators.packed import packed_tags, split_packed
from geoloom.operators.rolling import latest_versions, rolling_totals

NAMES = ("rel", "zoom", "tx", "ty", "k", "n", "m", "part", "bucket", "i", "j", "t", "_e", "_d", "_t", "_s", "_n", "cur", "dist", "trail", "stop", "next", "r", "value", "x0", "_v", "west")


def crowded(df):
    return df.withColumns({c: F.lit("taken") for c in NAMES if c not in df.columns})


def test_core_operators(spark):
    points = crowded(spark.createDataFrame([("p", 1.0, 1.0)], "key string, lat double, lon double"))
    places = crowded(spark.createDataFrame([("q", 1.0, 1.0, "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))")], "id string, lon double, lat double, geom string"))
    assert sorted(r.rel for r in spatial_join(points, places, 10.0).collect()) == ["inside", "near"]
    links = crowded(spark.createDataFrame([("t", "s", "a", "b"), ("t", "s", "b", None)], "tab string, scope string, node_id string, parent_id string"))
    assert {(r.node_id, r.depth) for r in resolve_hierarchy(links).collect()} == {("a", 1), ("b", 0)}
    daily = crowded(spark.createDataFrame([("u", dt.date(2025, 1, 5), 3)], "e string, d date, v int"))
    day = dt.date(2025, 1, 6)
    assert [r.v_7 for r in rolling_totals(daily, "e", "d", ["v"], first=day, last=day).collect()] == [3]
    assert latest_versions(daily, ["e"], "d", ["v"]).first().v == 3
    tags = crowded(spark.createDataFrame([("p", {"ref": "1;2"})], "id string, tags map<string,string>"))
    assert packed_tags(tags, ("ref",)).count() == 2
    assert split_packed(crowded(spark.createDataFrame([("1;2",)], "v string")), "v").count() == 2
