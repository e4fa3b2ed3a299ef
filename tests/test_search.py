import pytest
from pyspark.sql import functions as F

from geoloom.operators import search as s

KIND = "id string, osm_type string, name string, name_abbrev string, names array<string>, tags map<string,string>, categories array<string>, codes array<string>, centroid string, geom string, geom_type string, admin_level int, area_m2 double, parent_context string"


def place(i, name, lat=35.22, lon=-80.84, cats=("shop/x",), codes=None, abbrev=None, kind="point", area=None, level=None, geom=None, tags=None, ctx=None):
    return (i, "N", name, abbrev, [], tags or {}, list(cats), codes, f"POINT({lon} {lat})", geom, kind, level, area, ctx)


@pytest.fixture(scope="module")
def df(spark):
    rows = [
        place("n1", "Walmart Supercenter", ctx="Independence Blvd"), place("n2", "Independence Woods"), place("n3", "Walmart", lat=36.5), place("n4", "Walmart Road", cats=("highway/residential",)),
        place("n5", "Jefferson Kay Field", codes=["jfk"], kind="area", area=9.0), place("n6", "JFK Expressway", codes=["jfk"], kind="line", cats=("highway/motorway",)), place("n7", "Just For Kids", abbrev="jfk"),
        place("n8", None), place("n9", "Café Soleil", cats=("amenity/cafe",), lat=35.2201), place("n10", "Zoo", lat=0.0, lon=0.0),
    ]
    return s.searchable(spark.createDataFrame(rows, KIND)).cache()


def ids(out):
    return [r.id for r in out.collect()]


def test_layers_and_merge(df):
    assert ids(s.search(df, s.Request("jfk", 35.22, -80.84)))[:3] == ["n5", "n6", "n7"]
    got = ids(s.search(df, s.Request("walmart", 35.22, -80.84)))
    assert got[0] in ("n1", "n3") and got.index("n1") < got.index("n4")
    assert ids(s.search(df, s.Request("walmart independence", 35.22, -80.84)))[0] == "n1"
    assert ids(s.search(df, s.Request("cafe soleil")))[0] == "n9" and ids(s.search(df, s.Request("zzzzzz"))) == []


def test_autocomplete_box(df):
    assert "n3" not in ids(s.search(df, s.Request("walm", 35.22, -80.84, autocomplete=True)))
    assert "n3" in ids(s.search(df, s.Request("walmart", 35.22, -80.84)))


def test_browse(df):
    assert ids(s.search(df, s.Request(lat=35.22, lon=-80.84, categories=["amenity/cafe"]))) == ["n9"]
    assert "n10" in ids(s.search(df, s.Request(lat=0.0, lon=0.0, radius=10.0)))
    line = s.search(df, s.Request(line=[(-80.85, 35.2201), (-80.83, 35.2201)], buffer=100.0))
    assert "n3" not in ids(line) and "n9" in ids(line)
    with pytest.raises(ValueError):
        s.Request(lat=1.0)


def test_roles(spark):
    rows = spark.createDataFrame([("a", "L9", 9), ("b", "L8", 8), ("c", "L6", 6), ("d", "L4", 4), ("e", "L2", 2)], "id string, name string, admin_level int")
    assert tuple(s.address_roles(rows).first()) == ("L9", "L8", "L6", "L4")
    assert tuple(s.address_roles(rows.limit(0)).first()) == (None, None, None, None)


def test_containment(spark):
    sq = lambda d: f"POLYGON((-{d} -{d}, {d} -{d}, {d} {d}, -{d} {d}, -{d} -{d}))"
    rows = [place("city", "City", kind="area", area=4.0, level=8, geom=sq(1)), place("state", "State", kind="area", area=400.0, level=4, geom=sq(10)), place("in", "In", lat=0.5, lon=0.5), place("out", "Out", lat=5.0, lon=5.0)]
    df = s.searchable(spark.createDataFrame(rows, KIND))
    assert ids(s.containing_areas(df, 0.1, 0.1)) == ["city", "state"] and ids(s.containing_areas(df, 0.1, 0.1, "city")) == ["state"] and ids(s.containing_areas(df, 50.0, 50.0)) == []
    assert ids(s.children_of(df, "city")) == ["in"] and set(ids(s.children_of(df, "state"))) == {"in", "out"} and ids(s.children_of(df, "none")) == []


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, df, tmp_path):
    path = str(tmp_path / "p")
    spark.range(1000).select(F.col("id"), (F.col("id") / 10).alias("lat"), (F.col("id") / 10).alias("lon")).write.parquet(path)
    from geoloom.functions.geo import within_m
    from geoloom.operators.transit import near_join

    rows = spark.read.parquet(path)
    text = plan(rows.where(within_m("lat", "lon", 20.0, 20.0, 500.0)).select("id"))
    assert "PushedFilters" in text and "GreaterThanOrEqual(lat" in text
    assert "TakeOrderedAndProject" in plan(s.browse(df, s.Request(lat=35.22, lon=-80.84, radius=500.0)))
    pts = rows.select(F.col("id").alias("key"), "lat", "lon")
    text = plan(near_join(pts, rows, 100.0))
    assert "NestedLoop" not in text and "Cartesian" not in text
