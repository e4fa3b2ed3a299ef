"""Requests, live results and outlines around journeys: what is parsed, joined and drawn besides the boards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions.geo import haversine_m

# Names of modes in requests, and the limits of durations in seconds.
MODES = {"walk": "walk", "walking": "walk", "foot": "walk", "bike": "bike", "bicycle": "bike", "cycling": "bike", "car": "car", "drive": "car", "driving": "car", "transit": "transit"}
MOST_SECONDS, MOST_TRANSIT_SECONDS, MOST_CONTOURS = 7200, 5400, 6


def parse_mode(text: str | None) -> str:
    """The mode a request names; none is walking, an unknown one a ValueError."""
    if not text:
        return "walk"
    mode = MODES.get(text.strip().lower())
    if mode is None:
        raise ValueError(f"unknown mode {text!r}")
    return mode


def parse_durations(text: str | None, mode: str = "walk") -> list[int]:
    """Distinct whole seconds in rising order from 'a,b,c'; 900 if none. Not positive, not numeric, too long or too
    many is a ValueError."""
    parts = [p.strip() for p in (text or "").split(",") if p.strip()] or ["900"]
    try:
        values = [float(p) for p in parts]
    except ValueError:
        raise ValueError(f"not seconds: {text!r}") from None
    most = MOST_TRANSIT_SECONDS if mode == "transit" else MOST_SECONDS
    if any(not 0 < v <= most for v in values):
        raise ValueError(f"durations must be above 0 and at most {most} seconds")
    out = sorted({int(v + 0.5) for v in values})
    if len(out) > MOST_CONTOURS:
        raise ValueError(f"at most {MOST_CONTOURS} durations")
    return out


def check_origin(lat: float, lon: float) -> None:
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):  # false for NaN
        raise ValueError("lat must be in [-90, 90] and lon in [-180, 180]")


def in_equal_steps(durations: Column) -> Column:
    """Whether sorted durations are multiples of the first, so that one search with buckets serves all of them."""
    first = F.get(durations, F.lit(0))
    return (F.size(durations) >= 2) & F.forall(F.transform(durations, lambda d, i: F.abs(d - first * (i + 1)) < 1), lambda x: x)


def access_radius_m(seconds: Column) -> Column:
    """How far to look for stops that can be walked to: 1.25 m a second, at least 500 and at most 2,500 m."""
    return F.least(F.greatest(seconds * 1.25, F.lit(500.0)), F.lit(2500.0))


def rank_itineraries(found: DataFrame, n: int, request: str = "request_id") -> DataFrame:
    """The `n` shortest itineraries (request, duration_s, signature, pos) of each request: equal signatures count
    once, the shortest first; ties keep the order in which they were found (pos)."""
    one = F.row_number().over(W.partitionBy(request, "signature").orderBy("duration_s", "pos"))
    place = F.row_number().over(W.partitionBy(request).orderBy("duration_s", "pos"))
    return found.withColumn("_one", one).where("_one = 1").withColumn("place", place).where(F.col("place") <= n).drop("_one")


def live_in_view(vehicles: DataFrame, feeds: DataFrame, south: float, west: float, north: float, east: float, route_id: str | None = None) -> DataFrame:
    """Vehicles (feed_id, ..., lat, lon, route_id) of the feeds (feed_id, feed_ts), within the bounds and, if named, on
    the route, each with the newest time of its feed."""
    stamps = feeds.groupBy("feed_id").agg(F.max("feed_ts").alias("feed_ts"))
    seen = vehicles.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    if route_id is not None:
        seen = seen.where(F.col("route_id") == route_id)
    return seen.join(stamps, "feed_id")


def complex_routes(members: DataFrame, stop_routes: DataFrame, routes: DataFrame) -> DataFrame:
    """The distinct routes of all members of each stop's complex: `members` (stop, member), `stop_routes` (member,
    route_id), `routes` (route_id, ...)."""
    return members.join(stop_routes, "member").select("stop", "route_id").distinct().join(routes, "route_id")


def stop_area_entrances(places: DataFrame, members: DataFrame, lat: float, lon: float, near_deg: float = 0.003) -> DataFrame:
    """Ways in that share a stop area with a platform, stop position or station near a point, nearest first: the tier
    before all geometric ones. `members` is (relation_id, member_type, member_ref)."""
    t = F.col("tags")
    stop = t["public_transport"].isin("platform", "stop_position", "station") | t["railway"].isin("platform", "station", "halt", "stop")
    close = places.where(F.coalesce(stop, F.lit(False)) & F.col("lat").between(lat - near_deg, lat + near_deg) & F.col("lon").between(lon - near_deg, lon + near_deg))
    own = ["member_type", "member_ref"]
    areas = close.select(F.col("osm_type").alias("member_type"), F.col("osm_id").alias("member_ref")).join(members, own).select("relation_id").distinct()
    ways = F.coalesce(t["railway"].isin("subway_entrance", "train_station_entrance") | t["entrance"].isNotNull() | (t["highway"] == "elevator"), F.lit(False))
    doors = places.where(ways).withColumnsRenamed({"osm_type": "member_type", "osm_id": "member_ref"})
    linked = members.join(areas, "relation_id", "left_semi").select(*own).distinct()
    kind = F.coalesce(t["railway"], F.when(t["highway"] == "elevator", "elevator").otherwise("entrance"))
    out = doors.join(linked, own).select("id", "name", kind.alias("access_type"), F.round(haversine_m("lat", "lon", lat, lon), 3).alias("distance_m"), F.lit(0).alias("tier"))
    return out.orderBy("distance_m", "id")


def transfer_links(pairs: DataFrame, metres_per_s: float = 1.25, least_s: int = 60) -> DataFrame:
    """Timed transfers (from, to, min_transfer_time) both ways of pairs (a, b, distance_m)."""
    seconds = F.greatest(F.lit(least_s), F.ceil(F.round(F.col("distance_m"), 3) / metres_per_s)).cast("int").alias("min_transfer_time")
    ways = F.array(F.struct(F.col("a").alias("from"), F.col("b").alias("to")), F.struct(F.col("b").alias("from"), F.col("a").alias("to")))
    return pairs.select(F.explode(ways).alias("w"), seconds).select("w.from", "w.to", "min_transfer_time")


def is_fresh(marker: DataFrame, rows: DataFrame, version: int, drift: float = 0.1) -> DataFrame:
    """One row: whether enrichment recorded in `marker` (completed_at, row_count, version) still holds for `rows`: it was
    completed, by this version, and the number of rows has drifted by at most a tenth."""
    now = rows.agg(F.count("*").alias("n"))
    last = marker.agg(F.max(F.struct("completed_at", "row_count", "version")).alias("m"))
    m = F.col("m")
    ok = m["completed_at"].isNotNull() & (m["version"] == version) & (F.abs(F.col("n") - m["row_count"]) <= drift * m["row_count"])
    return now.join(last).select("n", F.coalesce(ok, F.lit(False)).alias("fresh"))  # two single rows


# --- outlines -------------------------------------------------------------------------------------------------------


def trace(edges: np.ndarray) -> list[np.ndarray]:
    """Closed rings of directed unit edges (x1, y1, x2, y2), the inside on their left; where rings touch they turn left."""
    ends: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x1, y1, x2, y2 in edges.tolist():
        ends.setdefault((x1, y1), []).append((x2, y2))
    rings = []
    for start in list(ends):
        while ends.get(start):
            ring, at, heading = [start], start, (0, 0)
            while True:
                ways = ends[at]
                if len(ways) > 1:
                    left = lambda w: heading[0] * (w[1] - at[1]) - heading[1] * (w[0] - at[0])  # noqa: B023, E731
                    ways.sort(key=left)
                to = ways.pop()
                heading = (to[0] - at[0], to[1] - at[1])
                if len(ring) > 1 and (ring[-1][0] - ring[-2][0], ring[-1][1] - ring[-2][1]) == (to[0] - ring[-1][0], to[1] - ring[-1][1]):
                    ring[-1] = to  # straight on
                else:
                    ring.append(to)
                at = to
                if at == start:
                    break
            rings.append(np.array(ring))
    return rings


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:-1].T
    xn, yn = ring[1:].T
    return float((x * yn - xn * y).sum() / 2)


def outlines(cells: DataFrame, group: str, cell_deg: float) -> DataFrame:
    """(group, wkt, rings, holes, cells, edges): the union of the square cells (group, y, x) of each group, centred on
    multiples of `cell_deg`, as a valid multipolygon.

    Sides that two cells share cancel out before anything is gathered, so a task holds the outline of a group and never
    its cells. Outer rings run counter-clockwise; a hole follows the outer ring that it lies in. Repeated cells count
    once; an empty table gives an empty result.
    """
    kind = cells.schema[group].dataType.simpleString()
    one = cells.select(group, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()
    x, y = F.col("x"), F.col("y")
    side = lambda x1, y1, x2, y2, flip: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.lit(flip).alias("flip"))
    sides = F.array(side(x, y, x + 1, y, False), side(x, y + 1, x + 1, y + 1, True), side(x, y, x, y + 1, True), side(x + 1, y, x + 1, y + 1, False))
    edges = one.select(group, F.explode(sides).alias("s")).select(group, "s.*").groupBy(group, "x1", "y1", "x2", "y2").agg(F.count("*").alias("n"), F.first("flip").alias("flip")).where("n = 1")

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        e = rows[["x1", "y1", "x2", "y2"]].to_numpy(np.int64)
        flip = rows["flip"].to_numpy(bool)
        e[flip] = e[flip][:, [2, 3, 0, 1]]
        e = e[np.lexsort(e.T[::-1])]
        found = trace(e)
        area = [ring_area(r) for r in found]
        outer = [k for k, a in enumerate(area) if a > 0]
        parts: dict[int, list[np.ndarray]] = {k: [found[k]] for k in outer}
        for k in (k for k, a in enumerate(area) if a < 0):
            # A cell's centre beside the hole's lowest, leftmost side is within the outer ring and not in the hole.
            px, py = found[k][np.lexsort((found[k][:, 0], found[k][:, 1]))[0]] + np.array([0.5, -0.5])

            def holds(r: np.ndarray) -> bool:
                x1, y1, x2, y2 = r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1]
                return bool((((y1 > py) != (y2 > py)) & (px < x1)).sum() % 2)  # noqa: B023

            parts[min((o for o in outer if holds(found[o])), key=lambda o: area[o])].append(found[k])
        text = lambda r: "(" + ", ".join(f"{(x - 0.5) * cell_deg:.6f} {(y - 0.5) * cell_deg:.6f}" for x, y in r.tolist()) + ")"
        wkt = "MULTIPOLYGON(" + ", ".join("(" + ", ".join(text(r) for r in parts[o]) + ")" for o in outer) + ")"
        return pd.DataFrame({group: rows[group].iloc[:1].to_numpy(), "wkt": [wkt], "rings": [len(found)], "holes": [len(found) - len(outer)], "cells": [int(round(sum(area)))], "edges": [len(e)]})

    return edges.groupBy(group).applyInPandas(draw, f"{group} {kind}, wkt string, rings int, holes int, cells bigint, edges bigint")


def cells_of_polygon(areas: DataFrame, group: str, cell_deg: float) -> DataFrame:
    """(group, y, x): the cells whose centre lies in the polygons (group, geom) of a group, to be united with others."""
    from geoloom.operators.dualtree import inside, rings_of

    kind = areas.schema[group].dataType.simpleString()

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, geom in zip(batch[group], batch["geom"]):
                found = rings_of(geom) if geom else []
                if not found:
                    continue
                low, high = np.min([r.min(0) for r in found], 0), np.max([r.max(0) for r in found], 0)
                xs = np.arange(np.floor(low[0] / cell_deg), np.ceil(high[0] / cell_deg) + 1)
                for y in np.arange(np.floor(low[1] / cell_deg), np.ceil(high[1] / cell_deg) + 1):
                    hit = xs[inside(found, xs * cell_deg, np.full(len(xs), y * cell_deg))].astype(np.int64)
                    if len(hit):
                        yield pd.DataFrame({group: [key] * len(hit), "y": np.full(len(hit), int(y)), "x": hit})

    return areas.select(group, "geom").mapInPandas(fill, f"{group} {kind}, y bigint, x bigint")
