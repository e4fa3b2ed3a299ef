"""GTFS text files, unzipped to one folder per feed, as clean tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The columns read of each file; a file without one of them has nulls there.
FILES = {
    "agency": ("agency_id", "agency_name"),
    "stops": ("stop_id", "stop_code", "stop_name", "stop_lat", "stop_lon", "location_type", "parent_station", "wheelchair_boarding", "platform_code"),
    "routes": ("route_id", "agency_id", "route_short_name", "route_long_name", "route_type", "route_color", "route_text_color", "route_url"),
    "trips": ("trip_id", "route_id", "direction_id", "shape_id", "bikes_allowed"),
    "stop_times": ("trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"),
    "transfers": ("from_stop_id", "to_stop_id", "transfer_type", "min_transfer_time"),
    "shapes": ("shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"),
}


def _text(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _int(c: str, default: int | None = None) -> Column:
    value = F.trim(c).try_cast("int")
    return value if default is None else F.coalesce(value, F.lit(default))


def read_file(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One file of a feed as text columns: quoted fields, blanks around values and a byte order mark are dealt with,
    ragged rows are kept, unknown columns left out."""
    raw = spark.read.csv(f"{folder}/{name}.txt", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", multiLine=False)
    have = {c.lstrip("﻿").strip().strip('"').lower(): c for c in raw.columns}
    return raw.select(*[(F.col(f"`{have[c]}`") if c in have else F.lit(None).cast("string")).alias(c) for c in FILES[name]])


def stops(raw: DataFrame) -> DataFrame:
    """Stops with coordinates; missing integers 0, blank texts null."""
    lat, lon = F.trim("stop_lat").try_cast("double"), F.trim("stop_lon").try_cast("double")
    return raw.where(lat.isNotNull() & lon.isNotNull() & _text("stop_id").isNotNull()).select(
        _text("stop_id").alias("stop_id"), _text("stop_code").alias("stop_code"), _text("stop_name").alias("stop_name"), lat.alias("stop_lat"), lon.alias("stop_lon"),
        _int("location_type", 0).alias("location_type"), _text("parent_station").alias("parent_station"), _int("wheelchair_boarding", 0).alias("wheelchair_boarding"), _text("platform_code").alias("platform_code"),
    )


def agencies(raw: DataFrame) -> DataFrame:
    """The last name of each agency id ('' where there is none)."""
    rows = raw.withColumn("n", F.monotonically_increasing_id())
    return rows.groupBy(F.coalesce(F.trim("agency_id"), F.lit("")).alias("agency_id")).agg(F.max_by("agency_name", "n").alias("agency_name"))


def routes(raw: DataFrame, agency: DataFrame, fix_route_type_zero: bool = False) -> DataFrame:
    """Routes with their agency's name. A missing, invalid or zero route type becomes 3 (bus); with
    `fix_route_type_zero` 0 (tram) stays 0."""
    kind = _int("route_type")
    kind = F.coalesce(kind if fix_route_type_zero else F.nullif(kind, F.lit(0)), F.lit(3))
    keyed = raw.where(_text("route_id").isNotNull()).withColumn("agency_id", F.coalesce(F.trim("agency_id"), F.lit("")))
    return keyed.join(agency, "agency_id", "left").select(
        _text("route_id").alias("route_id"), _text("route_short_name").alias("route_short_name"), _text("route_long_name").alias("route_long_name"), kind.alias("route_type"),
        _text("route_color").alias("route_color"), _text("route_text_color").alias("route_text_color"), _text("route_url").alias("route_url"), "agency_name",
    )


def transfers(raw: DataFrame) -> DataFrame:
    ids = _text("from_stop_id").isNotNull() & _text("to_stop_id").isNotNull()
    return raw.where(ids).select(_text("from_stop_id").alias("from_stop_id"), _text("to_stop_id").alias("to_stop_id"), _int("transfer_type", 0).alias("transfer_type"), _int("min_transfer_time").alias("min_transfer_time"))


def shapes(raw: DataFrame) -> DataFrame:
    """(shape_id, coordinates): the points of each shape as [lon, lat] in sequence; invalid rows are dropped."""
    lat, lon, seq = F.trim("shape_pt_lat").try_cast("double"), F.trim("shape_pt_lon").try_cast("double"), F.trim("shape_pt_sequence").try_cast("int")
    rows = raw.select(_text("shape_id").alias("shape_id"), lat.alias("lat"), lon.alias("lon"), seq.alias("seq")).where("shape_id is not null and lat is not null and lon is not null and seq is not null")
    points = rows.groupBy("shape_id").agg(F.sort_array(F.collect_list(F.struct("seq", "lon", "lat"))).alias("p"))  # the points of one shape
    return points.select("shape_id", F.transform("p", lambda x: F.array(x["lon"], x["lat"])).alias("coordinates"))


def trips(raw: DataFrame) -> DataFrame:
    return raw.where(_text("trip_id").isNotNull()).select(_text("trip_id").alias("trip_id"), _text("route_id").alias("route_id"), _int("direction_id").alias("direction_id"), _text("shape_id").alias("shape_id"), _int("bikes_allowed").alias("bikes_allowed"))


def stop_times(raw: DataFrame) -> DataFrame:
    """Calls; a missing sequence number is the row's place within its trip."""
    rows = raw.where(_text("trip_id").isNotNull() & _text("stop_id").isNotNull()).withColumn("n", F.monotonically_increasing_id())
    place = F.row_number().over(W.partitionBy("trip_id").orderBy("n")) - 1
    return rows.select(_text("trip_id").alias("trip_id"), _text("stop_id").alias("stop_id"), F.coalesce(_int("stop_sequence"), place).alias("stop_sequence"))


def parse_bbox(text: str | None, named: dict[str, tuple[float, float, float, float]] | None = None) -> tuple[float, float, float, float] | None:
    """'global' or nothing: None; a known name; or 'west,south,east,north' in range and in order, else ValueError."""
    value = (text or "").strip()
    if not value or value.lower() == "global":
        return None
    if named and value.lower() in named:
        return named[value.lower()]
    try:
        west, south, east, north = (float(x) for x in value.split(","))
    except ValueError:
        raise ValueError(f"not a bounding box: {text!r}") from None
    if not (-180 <= west <= 180 and -180 <= east <= 180 and -90 <= south <= 90 and -90 <= north <= 90):
        raise ValueError(f"bounding box out of range: {text!r}")
    if west >= east or south >= north:
        raise ValueError(f"bounding box not in the order west, south, east, north: {text!r}")
    return west, south, east, north
