"""Registered queries of the data-processing operators of the core (problems 3, 4, 6 and 7)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.geo import point_of
from geoloom.operators.dualtree import spatial_join
from geoloom.operators.hierarchy import clean_key, descendants, resolve_hierarchy
from geoloom.operators.packed import packed_tags
from geoloom.operators.rolling import latest_versions, rolling_totals
from geoloom.plans.data_oracles import ORACLES
from geoloom.util import table

PACKED_KEYS = ("cuisine", "alt_name", "ref", "contact:phone", "destination")
NEAR_M = 80.0
FIRST_DAY, LAST_DAY = dt.date(2025, 2, 1), dt.date(2025, 6, 30)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_tags(table(spark, sf_dir, "geo_places"), PACKED_KEYS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = table(spark, sf_dir, "gtfs_stops").where("feed_id is not null and stop_id is not null")
    stops = stops.groupBy("feed_id", "stop_id").agg(F.min("stop_lat").alias("lat"), F.min("stop_lon").alias("lon"))
    places = table(spark, sf_dir, "geo_places").where("id is not null").groupBy("id").agg(
        F.min("centroid").alias("centroid"), F.min(F.when(F.col("geom_type") == "area", F.col("geom"))).alias("geom")
    )
    at = point_of("centroid")
    pairs = spatial_join(
        stops.select(F.struct("feed_id", "stop_id").alias("key"), "lat", "lon"),
        places.select("id", at["lon"].alias("lon"), at["lat"].alias("lat"), "geom"),
        NEAR_M,
    )
    return pairs.select("rel", F.col("point_key.feed_id").alias("feed_id"), F.col("point_key.stop_id").alias("stop_id"), "place_id")


def hierarchy_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables' links in one shape."""
    stops = table(spark, sf_dir, "gtfs_stops").where("feed_id is not null").select(
        F.lit("gtfs_stops").alias("tab"), F.col("feed_id").alias("scope"), F.col("stop_id").alias("node_id"), clean_key("parent_station").alias("parent_id")
    )
    regions = table(spark, sf_dir, "boundary_catalog").select(
        F.lit("boundary_catalog").alias("tab"), F.lit("").alias("scope"), F.col("id").alias("node_id"), clean_key("parent").alias("parent_id")
    )
    return stops.unionByName(regions)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_hierarchy(hierarchy_links(spark, sf_dir))
    return out.where("parent_id is not null").select("tab", "scope", "node_id", "root_id", "depth")


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_hierarchy(hierarchy_links(spark, sf_dir), paths=True)
    return out.select("tab", "scope", "node_id", "root_id", "depth", F.concat_ws(" > ", F.reverse("path")).alias("path"))


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(resolve_hierarchy(hierarchy_links(spark, sf_dir), paths=True))


def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = table(spark, sf_dir, "accounts_usage")
    return latest_versions(usage, ["user_id", "api_key_id", "day", "endpoint"], "updated_at", ["requests", "credits"])


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rolling_totals(usage_daily(spark, sf_dir), "user_id", "day", ["requests", "credits"], first=FIRST_DAY, last=LAST_DAY)
    rounded = [F.round(c, 4).alias(c) if c.startswith("avg_") else F.col(c) for c in out.columns[2:]]
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), *rounded)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rolling_totals(usage_daily(spark, sf_dir), "user_id", "day", ["requests", "credits"], first=FIRST_DAY, last=LAST_DAY, averages=False)
    case = (F.col("credits_7") > 0) & (10 * F.col("credits_7") > 7 * F.col("credits_30")) & (F.col("requests_30") >= 200)
    return out.where(case).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p6_found, p6_paths, p6_descendants, p7_found, p7_totals)}

__all__ = ["ORACLES", "QUERIES"]
