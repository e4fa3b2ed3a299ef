"""Shared-mobility feeds, live vehicle feeds and region indexes in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEED = "array<struct<name:string,url:string>>"
DISCOVERY = f"data struct<feeds:{FEED}>"
DISCOVERY_BY_LANGUAGE = f"data map<string,struct<feeds:{FEED}>>"
STATIONS = (
    "data struct<stations:array<struct<station_id:string,num_bikes_available:bigint,num_ebikes_available:bigint,num_docks_available:bigint,is_renting:boolean,"
    "vehicle_types_available:array<struct<vehicle_type_id:string,count:bigint>>>>>, last_updated bigint"
)
VEHICLES = "entity array<struct<id:string,vehicle:struct<trip:struct<tripId:string,routeId:string>,position:struct<latitude:double,longitude:double,bearing:double,speed:double>,timestamp:bigint,vehicle:struct<id:string>>>>"
UPDATES = "entity array<struct<tripUpdate:struct<trip:struct<tripId:string>,stopTimeUpdate:array<struct<stopId:string,arrival:struct<time:bigint>,departure:struct<time:bigint>>>>>>"


def discovered_feeds(rows: DataFrame, text: str = "body") -> DataFrame:
    """(columns of `rows`, name, url) of auto-discovery files: the list itself, else the first language's."""
    direct = F.from_json(F.col(text), DISCOVERY)["data"]["feeds"]
    by_language = F.get(F.map_values(F.from_json(F.col(text), DISCOVERY_BY_LANGUAGE)["data"]), F.lit(0))["feeds"]
    out = rows.withColumn("f", F.explode(F.coalesce(direct, by_language)))
    return out.select(*[c for c in rows.columns if c != text], F.col("f.name").alias("name"), F.col("f.url").alias("url"))


def station_status(rows: DataFrame, text: str = "body") -> DataFrame:
    """Status rows with the columns `transit.available` reads."""
    s = rows.withColumn("p", F.from_json(F.col(text), STATIONS)).select(*[c for c in rows.columns if c != text], F.explode("p.data.stations").alias("s"))
    return s.select(*[c for c in rows.columns if c != text], "s.*").withColumnRenamed("vehicle_types_available", "types")


def free_vehicles(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """Free-floating vehicles (vehicle_id, vehicle_type_id, lat, lon, is_reserved, is_disabled, charge): reserved,
    disabled and unplaced ones left out, the form by type (unknown: bicycle), the charge in whole percent."""
    ok = ~F.coalesce("is_reserved", F.lit(False)) & ~F.coalesce("is_disabled", F.lit(False)) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    named = rows.where(ok).join(forms.select("vehicle_type_id", "form_factor"), "vehicle_type_id", "left")
    return named.select("vehicle_id", "lat", "lon", F.coalesce("form_factor", F.lit("bicycle")).alias("form"), F.round(F.col("charge") * 100).cast("int").alias("battery_pct"))


def vehicle_positions(rows: DataFrame, text: str = "body") -> DataFrame:
    """Positions of a live feed's JSON, those without coordinates left out."""
    e = rows.withColumn("e", F.explode(F.from_json(F.col(text), VEHICLES)["entity"]))
    v = F.col("e.vehicle")
    out = e.select(
        *[c for c in rows.columns if c != text], F.coalesce(v["vehicle"]["id"], F.col("e.id")).alias("vehicle_id"), v["trip"]["tripId"].alias("trip_id"), v["trip"]["routeId"].alias("route_id"),
        v["position"]["latitude"].alias("lat"), v["position"]["longitude"].alias("lon"), v["position"]["bearing"].alias("bearing"), v["position"]["speed"].alias("speed"), v["timestamp"].alias("ts"),
    )
    return out.where("lat is not null and lon is not null")


def trip_updates(rows: DataFrame, text: str = "body") -> DataFrame:
    """(trip_id, seq, stop_id, arrival): the stop times of a live feed's trips in list order."""
    e = rows.select(F.explode(F.from_json(F.col(text), UPDATES)["entity"]).alias("e"))
    s = e.select(F.col("e.tripUpdate.trip.tripId").alias("trip_id"), F.posexplode("e.tripUpdate.stopTimeUpdate").alias("seq", "s"))
    return s.select("trip_id", "seq", F.col("s.stopId").alias("stop_id"), F.coalesce("s.arrival.time", "s.departure.time").alias("arrival"))


def url_kind(urls: str = "url"):
    """'vehicles', 'updates' or 'other' by a feed's address."""
    c = F.col(urls)
    return F.when(c.rlike("(?i)vehicle.?position"), "vehicles").when(c.rlike("(?i)trip.?update"), "updates").otherwise("other")


def region_index(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a GeoJSON collection; features without a download address are left out."""
    schema = "features array<struct<properties:struct<id:string,name:string,parent:string,`iso3166-1:alpha2`:array<string>,`iso3166-2`:array<string>,urls:struct<pbf:string,updates:string>>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).where("f.properties.urls.pbf is not null")
    p = "f.properties"
    return f.select(
        F.col(f"{p}.id").alias("id"), F.col(f"{p}.name").alias("name"), F.col(f"{p}.parent").alias("parent"), F.col(f"{p}.`iso3166-1:alpha2`").alias("iso3166_1"), F.col(f"{p}.`iso3166-2`").alias("iso3166_2"),
        F.col(f"{p}.urls.pbf").alias("pbf_url"), F.col(f"{p}.urls.updates").alias("updates_url"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"),
    )


def box_of_coordinates(coordinates: str):
    """[west, south, east, north] of GeoJSON coordinates in text form."""
    pair = r"\[\s*(-?[\d.]+(?:[eE][-+]?\d+)?)\s*,\s*(-?[\d.]+(?:[eE][-+]?\d+)?)"
    xs, ys = (F.regexp_extract_all(F.col(coordinates), F.lit(pair), F.lit(k)).cast("array<double>") for k in (1, 2))
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
