"""Objects of a map extract (JSON lines with type, id, tags and WKT) as the place table, and relation members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import tags as tag
from geoloom.functions import text as txt
from geoloom.operators.enrich import geometry_area_m2

OBJECT = "type string, id bigint, tags map<string,string>, geometry string, closed boolean, members array<struct<type:string,ref:bigint,role:string>>"
# Relation types that make an area or a line.
AREA_RELATIONS = ("multipolygon", "boundary", "site", "associatedStreet", "building")
LINE_RELATIONS = ("route",)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Tagged objects; untagged ones are dropped."""
    return spark.read.schema(OBJECT).json(path).where("tags is not null and size(tags) > 0")


def geometry_type(objects: DataFrame) -> DataFrame:
    """Adds `geom_type`: nodes are points, closed ways areas unless area=no, other ways lines, relations by their
    type; other relations are dropped."""
    kind = F.col("tags")["type"]
    way = F.when(F.coalesce("closed", F.lit(False)) & (F.coalesce(F.col("tags")["area"], F.lit("")) != "no"), "area").otherwise("line")
    relation = F.when(kind.isin(*AREA_RELATIONS), "area").when(kind.isin(*LINE_RELATIONS), "line")
    return objects.withColumn("geom_type", F.when(F.col("type") == "node", "point").when(F.col("type") == "way", way).otherwise(relation)).where("geom_type is not null")


def places(objects: DataFrame) -> DataFrame:
    """The place columns that tags and geometry give; one narrow pass without a shuffle."""
    t = F.col("tags")
    short = F.upper(F.substring("type", 1, 1))
    scrubbed = F.map_filter("tags", lambda k, v: ~k.isin("created_by", "source"))
    return geometry_type(objects).select(
        tag.object_id(short, "id").alias("id"), short.alias("osm_type"), F.col("id").alias("osm_id"), t["name"].alias("name"), txt.abbreviation(t["name"]).alias("name_abbrev"),
        tag.names("tags").alias("names"), scrubbed.alias("tags"), tag.categories("tags").alias("categories"), txt.codes("tags").alias("codes"), F.col("geometry").alias("geom"), "geom_type",
        tag.admin_level("tags").alias("admin_level"), F.when(F.col("geom_type") == "area", geometry_area_m2("geometry")).alias("area_m2"), F.to_json(tag.address("tags")).alias("address"),
        t["opening_hours"].alias("hours"), tag.phones("tags").alias("phones"), tag.websites("tags").alias("websites"),
    )


def bicycle_ways(objects: DataFrame) -> DataFrame:
    """Ways with bicycle infrastructure."""
    c = tag.bicycle_class("tags")
    t = F.col("tags")
    rows = objects.where("type = 'way'").select(
        F.col("id").alias("osm_id"), t["name"].alias("name"), c["infra"].alias("infra_type"), c["state"].alias("state"), t["highway"].alias("highway"), t["surface"].alias("surface"),
        tag.oneway("tags").alias("oneway"), tag.is_set("tags", "bridge").alias("bridge"), tag.is_set("tags", "tunnel").alias("tunnel"),
    )
    return rows.where("infra_type is not null")


def bicycle_routes(objects: DataFrame) -> DataFrame:
    """Route relations for bicycles, with the bit of their network."""
    t = F.col("tags")
    rows = objects.where((F.col("type") == "relation") & (t["type"] == "route") & t["route"].isin("bicycle", "mtb"))
    return rows.select(F.col("id").alias("osm_id"), t["name"].alias("name"), t["network"].alias("network"), tag.network_mask(F.array(F.coalesce(t["network"], F.lit("")))).alias("mask"))


def stop_area_members(objects: DataFrame) -> DataFrame:
    """(relation_id, name, member_type, member_ref, member_role) of stop-area relations."""
    t = F.col("tags")
    rows = objects.where((F.col("type") == "relation") & (t["public_transport"] == "stop_area"))
    m = rows.select(F.col("id").alias("relation_id"), t["name"].alias("name"), F.explode("members").alias("m"))
    return m.select("relation_id", "name", F.upper(F.substring("m.type", 1, 1)).alias("member_type"), F.col("m.ref").alias("member_ref"), F.col("m.role").alias("member_role"))
