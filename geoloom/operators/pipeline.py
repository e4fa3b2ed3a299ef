"""From map objects to the searchable place table, whole and incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.operators.enrich import ROAD_CATEGORIES, parent_context, rings, road_crossings
from geoloom.operators.search import searchable
from geoloom.sources import osm
from geoloom.util import materialise


def number_rows(rows: DataFrame, *order) -> DataFrame:
    """`rows` with `n`, their place in the order from 1: counts of ranges before a row's, and its place within its own."""
    placed = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(W.orderBy("_range")) - F.col("_size")).alias("_before"))  # one row per range
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return placed.withColumn("_within", within).join(before, "_range").withColumn("n", F.col("_before") + F.col("_within")).drop("_range", "_within", "_before")


def crossings_as_places(places: DataFrame) -> DataFrame:
    """Crossings of named roads as places of type X; ids count from north to south, then west to east."""
    lines = F.explode(rings("geom")).alias("line")  # all parts of a line
    roads = places.where((F.col("geom_type") == "line") & F.arrays_overlap("categories", F.array(*[F.lit(c) for c in ROAD_CATEGORIES])))
    numbered = number_rows(road_crossings(roads.select("id", "name", lines)), F.desc("lat"), F.asc("lon"))
    point = F.concat(F.lit("POINT("), "lon", F.lit(" "), "lat", F.lit(")"))
    given = {
        "id": F.concat(F.lit("intersection/"), "n"), "osm_type": F.lit("X"), "osm_id": F.col("n"), "name": F.col("name"), "names": F.col("names"), "categories": F.array(F.lit("highway/intersection")),
        "tags": F.expr("cast(map() as map<string,string>)"), "geom": point, "centroid": point, "geom_type": F.lit("point"),
    }
    return numbered.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in places.schema.fields])


def centroid_wkt(geom: str = "geom"):
    """The point itself, or the middle of the box of the other geometries, as WKT."""
    xs, ys = (F.regexp_extract_all(F.col(geom), F.lit(r"(-?[\d.]+(?:[eE][-+]?\d+)?)[ \t]+(-?[\d.]+(?:[eE][-+]?\d+)?)"), F.lit(k)).cast("array<double>") for k in (1, 2))
    mid = lambda v: (F.array_min(v) + F.array_max(v)) / 2
    return F.when(F.size(xs) > 0, F.concat(F.lit("POINT("), mid(xs), F.lit(" "), mid(ys), F.lit(")")))


def build_places(objects: DataFrame) -> DataFrame:
    """Derived columns, crossings, context and search words, in the order in which they need one another."""
    base = osm.places(objects).withColumn("centroid", centroid_wkt())
    base = materialise(base)
    whole = materialise(base.unionByName(crossings_as_places(base)))
    context = parent_context(whole)
    return searchable(whole.join(context, "id", "left"))


def refresh_context(places: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, parent_context) of what a change touches: the changed places (id) themselves, and all places within a
    changed area. `places` is the table after the change; the rest keeps what it has."""
    from geoloom.functions.geo import point_of
    from geoloom.operators.dualtree import spatial_join

    ids = changed.select("id").distinct()
    at = point_of("centroid")
    none = F.lit(None).cast("double")
    areas = places.where("geom_type = 'area'").join(ids, "id", "left_semi").select("id", none.alias("lon"), none.alias("lat"), "geom")
    inside = spatial_join(places.select(F.col("id").alias("key"), at["lat"].alias("lat"), at["lon"].alias("lon")), areas, 1.0).where("rel = 'inside'")
    touched = materialise(ids.unionByName(inside.select(F.col("point_key").alias("id"))).distinct())
    around = places.where("geom_type = 'area'").withColumn("_area", F.lit(True))
    few = places.join(touched, "id", "left_semi").unionByName(around.drop("_area").join(touched, "id", "left_anti"))
    return parent_context(few).join(touched, "id", "left_semi")


def store_places(places: DataFrame, path: str, cell_deg: float = 0.05, partitions: int | None = None) -> None:
    """Writes places with `lat` and `lon` in the order of a Z-curve over grid cells, so that the row groups' statistics
    let a search in a box skip most of them. A range partition holds neighbouring cells only."""
    x, y = (F.floor((F.coalesce(c, F.lit(0.0)) + 360) / cell_deg).cast("long") for c in ("lon", "lat"))
    spread = lambda v: F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0).cast("long"), lambda s, b: s + F.getbit(v, b).cast("long") * F.pow(F.lit(4.0), b).cast("long"))
    ordered = places.withColumn("_z", spread(x) + 2 * spread(y))
    ranged = ordered.repartitionByRange(partitions, "_z") if partitions else ordered.repartitionByRange("_z")
    ranged.sortWithinPartitions("_z").drop("_z").write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(path)
