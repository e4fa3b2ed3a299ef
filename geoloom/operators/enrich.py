"""Enrichment of places: newest versions, rings of geometries, context from containing areas, crossings, brands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions.geo import NUMBER, point_of, ring_area_m2
from geoloom.operators.dualtree import spatial_join

# Categories of areas that name a place's surroundings besides administrative ones.
CONTEXT_CATEGORIES = ("place/neighbourhood", "place/suburb", "place/quarter", "place/city_block")
# Categories of lines that can cross.
ROAD_CATEGORIES = (
    "highway/motorway", "highway/motorway_link", "highway/trunk", "highway/trunk_link", "highway/primary", "highway/primary_link", "highway/secondary",
    "highway/secondary_link", "highway/tertiary", "highway/tertiary_link", "highway/residential", "highway/unclassified", "highway/living_street",
    "highway/cycleway", "highway/footway",
)


def newest(places: DataFrame, key: str = "id", version: str = "updated_at") -> DataFrame:
    """One row per key, the newest version; null versions are the oldest, identical copies count once."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col(version).desc_nulls_last()))
    return places.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def rings(wkt: Column | str, outer: bool = False) -> Column:
    """Rings (or, for lines, the line) of a WKT or EWKT geometry as arrays of struct(lon, lat); only outer rings on
    request. Empty for points written without lists, null for null."""
    text = F.col(wkt) if isinstance(wkt, str) else wkt
    parts = F.regexp_extract_all(text, F.lit(r"\(\s*\(([^()]+)\)" if outer else r"\(([^()]+)\)"), F.lit(1))

    def vertices(ring: Column) -> Column:
        xs, ys = (F.regexp_extract_all(ring, F.lit(rf"({NUMBER})[ \t]+({NUMBER})"), F.lit(k)) for k in (1, 2))
        return F.zip_with(xs, ys, lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat")))

    return F.transform(parts, vertices)


def geometry_area_m2(wkt: Column | str) -> Column:
    """Area of polygons and multipolygons, holes taken off; 0 for other geometries."""
    total = lambda rs: F.aggregate(F.transform(rs, ring_area_m2), F.lit(0.0), lambda s, v: s + v)
    text = F.col(wkt) if isinstance(wkt, str) else wkt
    return F.when(text.rlike("(?i)POLYGON"), 2 * total(rings(text, outer=True)) - total(rings(text))).otherwise(F.lit(0.0))


def parent_context(places: DataFrame) -> DataFrame:
    """(id, parent_context) of named places: street, city, state and postcode of the address, then the names of all
    named administrative or neighbourhood areas that contain the place, smallest first; null if there is nothing.

    The containment is a dual-tree join over tiles, so neither side is broadcast.
    """
    at = point_of("centroid")
    is_area = (F.col("geom_type") == "area") & F.col("name").isNotNull()
    around = is_area & (F.col("admin_level").isNotNull() | F.arrays_overlap("categories", F.array(*[F.lit(c) for c in CONTEXT_CATEGORIES])))
    named = places.where("name is not null")
    points = named.select(F.col("id").alias("key"), at["lat"].alias("lat"), at["lon"].alias("lon"))
    areas = places.where(F.coalesce(around, F.lit(False)))
    none = F.lit(None).cast("double")
    inside = spatial_join(points, areas.select("id", none.alias("lon"), none.alias("lat"), "geom"), 1.0).where("rel = 'inside'")
    labels = inside.join(areas.select(F.col("id").alias("place_id"), F.col("name").alias("label"), "area_m2"), "place_id")
    order = F.struct(F.col("area_m2").isNull().alias("last"), F.col("area_m2").alias("size"), F.col("place_id").alias("id"), F.col("label").alias("label"))
    labels = labels.groupBy(F.col("point_key").alias("id")).agg(F.array_sort(F.collect_list(order)).alias("found"))  # the areas over one place
    labels = labels.select("id", F.array_join(F.transform("found", lambda x: x["label"]), " ").alias("labels"))
    parts = [F.coalesce(F.get_json_object("address", f"$.{k}"), F.lit("")) for k in ("street", "city", "state", "postcode")]
    whole = F.trim(F.concat_ws(" ", *parts, F.coalesce("labels", F.lit(""))))
    return named.join(labels, "id", "left").select("id", F.nullif(whole, F.lit("")).alias("parent_context"))


def road_crossings(roads: DataFrame, cell_deg: float = 0.002) -> DataFrame:
    """(lon, lat, name, names) of the points where lines of different names meet, snapped to 1e-5 degrees.

    `roads` is (id, name, line) with a line as array of struct(lon, lat). Segments meet in the grid cells that they pass
    through (of each column the rows between where they enter and leave it, so a long slanting segment takes as many
    cells as it is long); the join is by equality. A point where more than two names meet comes out once with all of
    them.
    """
    segments = roads.where("name is not null and size(line) > 1").select(
        "name", F.explode(F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda i: F.struct(F.get("line", i - 1).alias("p"), F.get("line", i).alias("q")))).alias("s")
    ).select("name", F.col("s.p.lon").alias("x1"), F.col("s.p.lat").alias("y1"), F.col("s.q.lon").alias("x2"), F.col("s.q.lat").alias("y2"))
    row = lambda v: F.floor(v / cell_deg).cast("long")
    columns = segments.select("*", F.explode(F.sequence(row(F.least("x1", "x2")), row(F.greatest("x1", "x2")))).alias("cx"))
    # Heights at the column's two sides, a little beyond them so that rounding loses no cell.
    slope = (F.col("y2") - F.col("y1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0))
    at = lambda x: F.col("y1") + (F.least(F.greatest(x, F.least("x1", "x2")), F.greatest("x1", "x2")) - F.col("x1")) * slope
    sides = [F.coalesce(at((F.col("cx") + k) * cell_deg), c) for k, c in ((-1e-6, F.col("y1")), (1 + 1e-6, F.col("y2")))]
    low, high = F.least(*sides) - 1e-9, F.greatest(*sides) + 1e-9
    cells = columns.select("*", F.explode(F.sequence(row(low), row(high))).alias("cy"))
    other = cells.select(F.col("name").alias("name_b"), *[F.col(c).alias(c.replace("1", "3").replace("2", "4")) for c in ("x1", "y1", "x2", "y2")], "cx", "cy")
    pairs = cells.join(other, ["cx", "cy"]).where("name < name_b")
    d = (F.col("x2") - F.col("x1")) * (F.col("y4") - F.col("y3")) - (F.col("y2") - F.col("y1")) * (F.col("x4") - F.col("x3"))
    t = ((F.col("x3") - F.col("x1")) * (F.col("y4") - F.col("y3")) - (F.col("y3") - F.col("y1")) * (F.col("x4") - F.col("x3"))) / d
    u = ((F.col("x3") - F.col("x1")) * (F.col("y2") - F.col("y1")) - (F.col("y3") - F.col("y1")) * (F.col("x2") - F.col("x1"))) / d
    met = pairs.where(d != 0).select("name", "name_b", "x1", "y1", "x2", "y2", t.alias("t"), u.alias("u")).where("t between 0 and 1 and u between 0 and 1")
    snap = lambda v: F.round(v, 5)
    points = met.select("name", "name_b", snap(F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1"))).alias("lon"), snap(F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1"))).alias("lat"))
    named = points.select("lon", "lat", F.explode(F.array("name", "name_b")).alias("road")).distinct()
    return named.groupBy("lon", "lat").agg(F.array_sort(F.collect_set("road")).alias("names")).select("lon", "lat", F.array_join("names", " & ").alias("name"), "names")


def brand_catalogue(places: DataFrame) -> DataFrame:
    """Brands with at least two named places: brand_key (Wikidata id, else 'name:' and the folded name), name and
    category (most frequent, smallest first), wikidata, location_count, rep_lat, rep_lon."""
    qid = F.nullif(F.col("tags")["brand:wikidata"], F.lit(""))
    folded = F.lower(F.regexp_replace(F.trim(F.col("tags")["brand"]), r"\s+", " "))
    at = point_of("centroid")
    rows = places.where("name is not null").where(F.map_contains_key("tags", "brand")).select(
        F.coalesce(qid, F.concat(F.lit("name:"), folded)).alias("brand_key"), qid.alias("wikidata"), F.col("tags")["brand"].alias("brand"),
        F.try_element_at("categories", F.lit(1)).alias("category"), at["lat"].alias("lat"), at["lon"].alias("lon"),
    )
    # Two steps keep the state of a brand small: frequencies of its values, then the most frequent.
    total = rows.groupBy("brand_key").agg(F.max("wikidata").alias("wikidata"), F.count("*").cast("int").alias("location_count"), F.avg("lat").alias("rep_lat"), F.avg("lon").alias("rep_lon"))

    def most(value: str, name: str) -> DataFrame:
        counted = rows.where(F.col(value).isNotNull()).groupBy("brand_key", value).agg((-F.count("*")).alias("n"))
        return counted.groupBy("brand_key").agg(F.min(F.struct("n", F.col(value).alias("v")))["v"].alias(name))

    out = total.where("location_count >= 2").join(most("brand", "name"), "brand_key", "left").join(most("category", "category"), "brand_key", "left")
    return out.select("brand_key", "name", "wikidata", "location_count", "category", "rep_lat", "rep_lon")
