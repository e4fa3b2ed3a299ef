"""Public transport: stops, links between them, trip patterns, boards, live vehicles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions.geo import bearing_deg, cosine_law_m, haversine_m, lerp, planar_degrees, segment_m
from geoloom.operators.dualtree import spatial_join
from geoloom.operators.enrich import rings


def blank_to_null(col: str) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def clean_stops(stops: DataFrame) -> DataFrame:
    """Stops with coordinates, once per (feed, stop): blank texts to null, missing integers to 0."""
    rows = stops.where("feed_id is not null and stop_id is not null and stop_lat is not null and stop_lon is not null")
    return rows.groupBy("feed_id", "stop_id").agg(
        F.min(blank_to_null("stop_name")).alias("stop_name"), F.min("stop_lat").alias("lat"), F.min("stop_lon").alias("lon"),
        F.coalesce(F.max("location_type"), F.lit(0)).alias("location_type"), F.min(blank_to_null("parent_station")).alias("parent_station"),
        F.coalesce(F.max("wheelchair_boarding"), F.lit(0)).alias("wheelchair_boarding"),
    )


def near_join(points: DataFrame, anchors: DataFrame, metres: float) -> DataFrame:
    """Pairs (a, b, distance_m) of `points` (key, lat, lon) and `anchors` (id, lat, lon) within `metres`."""
    none = F.lit(None).cast("string").alias("geom")
    pairs = spatial_join(points, anchors.select("id", "lon", "lat", none), metres).where("rel = 'near'")
    return pairs.select(F.col("point_key").alias("a"), F.col("place_id").alias("b"), "distance_m")


def transfer_pairs(stops: DataFrame, metres: float = 500.0) -> DataFrame:
    """Pairs of boarding stops within walking distance, the smaller (feed, stop) first."""
    platforms = stops.where("location_type = 0").select(F.struct("feed_id", "stop_id").alias("key"), "lat", "lon")
    out = near_join(platforms, platforms.withColumnRenamed("key", "id"), metres)
    return out.where(F.col("a") < F.col("b"))


def nearest_anchor(points: DataFrame, anchors: DataFrame, metres: float = 250.0) -> DataFrame:
    """The nearest anchor (id, rank, lat, lon) of each point; at equal distance the smaller rank, then id."""
    pairs = near_join(points, anchors.select(F.struct("rank", "id").alias("id"), "lat", "lon"), metres)
    best = F.min(F.struct(F.round("distance_m", 3).alias("d"), F.col("b.rank").alias("r"), F.col("b.id").alias("b")))
    return pairs.groupBy("a").agg(best.alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.d").alias("distance_m"), F.col("m.r").alias("rank"))


def region_distance_m(wkt: Column | str, lat: Column | str, lon: Column | str) -> Column:
    """Metres from a point to the nearest side of a polygon's rings."""
    y, x = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))

    def ring_m(r: Column) -> Column:
        sides = F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: segment_m(y, x, F.get(r, i - 1)["lat"], F.get(r, i - 1)["lon"], F.get(r, i)["lat"], F.get(r, i)["lon"]))
        return F.array_min(sides)

    return F.array_min(F.transform(rings(wkt), ring_m))


def stop_times_of(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    return trips.join(stop_times, "trip_id")


def trip_patterns(calls: DataFrame) -> DataFrame:
    """Distinct station sequences per route and direction from calls (trip_id, route_id, direction_id, seq, tie,
    station): ',a,b,c,' in call order, stations that repeat in a row once. A trip is one bounded group."""
    trips = calls.groupBy("trip_id", "route_id", "direction_id").agg(F.sort_array(F.collect_list(F.struct("seq", "tie", "station"))).alias("s"))
    ordered = F.transform("s", lambda x: x["station"].cast("string"))
    kept = F.filter(ordered, lambda x, i: (i == 0) | (x != F.get(ordered, i - 1)))
    return trips.select("route_id", "direction_id", F.concat(F.lit(","), F.array_join(kept, ","), F.lit(",")).alias("stop_seq")).distinct()


def canonical_shape(trips: DataFrame) -> DataFrame:
    """The most frequent shape of each route; among equals the one seen first (trips in the order of `seen`)."""
    rows = trips.where("route_id is not null and shape_id is not null and trim(shape_id) != ''").groupBy("route_id", "shape_id").agg(F.count("*").alias("n"), F.min("seen").alias("first"))
    rank = F.row_number().over(W.partitionBy("route_id").orderBy(F.desc("n"), "first"))
    return rows.withColumn("k", rank).where("k = 1").select("route_id", "shape_id", "n")


def bikes_allowed(trips: DataFrame) -> DataFrame:
    """2 if all trips of a route take bicycles, 1 if some do, else 0."""
    n = F.count_if(F.col("bikes_allowed") == 1)
    return trips.where("route_id is not null").groupBy("route_id").agg(F.when(n == 0, 0).when(n == F.count("*"), 2).otherwise(1).alias("bikes"))


def station_complex(stops: DataFrame, transfers: DataFrame) -> DataFrame:
    """(stop, member): the stops of a stop's station and of the stations one transfer away, itself included.

    `stops` is (stop, station), `transfers` (a, b) between stops, read both ways; the expansion is one hop, as the
    transfers of transfers are another station's concern.
    """
    own = stops.select(F.col("stop"), "station")
    links = transfers.select("a", "b").unionByName(transfers.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hop = own.join(links, own["stop"] == links["a"]).select("station", "b").join(own.select(F.col("stop").alias("b"), F.col("station").alias("far")), "b").select("station", "far")
    reach = own.select("station", F.col("station").alias("far")).unionByName(hop).distinct()
    members = own.select(F.col("stop").alias("member"), F.col("station").alias("far"))
    return own.join(reach, "station").join(members, "far").select("stop", "member").distinct()


def departures(calls: DataFrame, at: Column, n: int) -> DataFrame:
    """The next `n` calls of each stop from `at`: (stop_id, route_id, departure, delay_s, pos).

    `actual` counts where given, else `scheduled`; the delay is rounded seconds, null without an actual time.
    """
    when = F.coalesce("actual", "scheduled")
    delay = F.round(F.unix_micros("actual") / 1e6 - F.unix_micros("scheduled") / 1e6).cast("long")
    rows = calls.withColumn("departure", when).withColumn("delay_s", delay).where(F.col("departure") >= at)
    pos = F.row_number().over(W.partitionBy("stop_id").orderBy("departure", "route_id", "trip_id"))
    return rows.withColumn("pos", pos).where(F.col("pos") <= n)


def along_line(lat: Column, lon: Column, line: Column) -> Column:
    """Metres along a line (array of struct(lon, lat)) to the projection of a point; the first nearest segment."""
    step = lambda i: haversine_m(F.get(line, i - 1)["lat"], F.get(line, i - 1)["lon"], F.get(line, i)["lat"], F.get(line, i)["lon"])
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0.0).alias("at"), F.lit(0.0).alias("done"))

    def visit(s: Column, i: Column) -> Column:
        a, b = F.get(line, i - 1), F.get(line, i)
        dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        norm = dx * dx + dy * dy
        t = F.when(norm == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - a["lon"]) * dx + (lat - a["lat"]) * dy) / norm)))
        d = haversine_m(lat, lon, a["lat"] + dy * t, a["lon"] + dx * t)
        near = d < s["best"]
        return F.struct(F.when(near, d).otherwise(s["best"]).alias("best"), F.when(near, s["done"] + step(i) * t).otherwise(s["at"]).alias("at"), (s["done"] + step(i)).alias("done"))

    return F.aggregate(F.sequence(F.lit(1), F.size(line) - 1), start, visit)["at"]


def cumulative_m(points: DataFrame, line_id: str, order: str) -> DataFrame:
    """Running metres along each line's points (lat, lon)."""
    w = W.partitionBy(line_id).orderBy(order)
    step = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    return points.withColumn("step_m", F.coalesce(step, F.lit(0.0))).withColumn("along_m", F.sum("step_m").over(w.rowsBetween(W.unboundedPreceding, 0)))


def elevation_stats(points: DataFrame, line_id: str, order: str) -> DataFrame:
    """Gain, loss, lowest and highest of `ele` along each line, to one digit."""
    w = W.partitionBy(line_id).orderBy(order)
    d = F.col("ele") - F.lag("ele").over(w)
    one = lambda c: F.round(c, 1)
    return points.withColumn("d", F.coalesce(d, F.lit(0.0))).groupBy(line_id).agg(
        one(F.sum(F.greatest("d", F.lit(0.0)))).alias("gain"), one(F.sum(F.greatest(-F.col("d"), F.lit(0.0)))).alias("loss"), one(F.min("ele")).alias("low"), one(F.max("ele")).alias("high")
    )


def cover_breakpoints(details: DataFrame, line_id: str) -> DataFrame:
    """Elementary ranges of each line's details (line, kind, from_i, to_i, value), with the value of each kind that
    covers them: (line, from_i, to_i, kind, value)."""
    ends = details.select(line_id, F.explode(F.array("from_i", "to_i")).alias("i")).distinct()
    w = W.partitionBy(line_id).orderBy("i")
    ranges = ends.withColumn("j", F.lead("i").over(w)).where("j is not null")
    d = details.select(line_id, "kind", F.col("from_i").alias("f"), F.col("to_i").alias("t"), "value")
    return ranges.join(d, line_id).where("f <= i and t >= j").select(line_id, F.col("i").alias("from_i"), F.col("j").alias("to_i"), "kind", "value")


def merge_runs(segments: DataFrame, line_id: str, start: str, end: str, attributes: list[str]) -> DataFrame:
    """Consecutive segments of a line with equal attributes as one: (line, start, end, attributes)."""
    w = W.partitionBy(line_id).orderBy(start)
    state = F.struct(*[F.col(a) for a in attributes])
    new = F.when(F.lag(state).over(w).eqNullSafe(state), 0).otherwise(1)
    runs = segments.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(line_id, "_run", *attributes).agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def interpolate(trips: DataFrame, now: Column) -> DataFrame:
    """Position of each trip from `calls`, an array in order of struct(lat, lon, arrival, departure) in seconds:
    between the last stop left and the first stop still to come; at the first stop within two minutes before the
    start; else null."""
    left = F.try_element_at(F.filter("calls", lambda c: c["departure"].isNotNull() & (c["departure"] <= now)), F.lit(-1))
    ahead = F.try_element_at(F.filter("calls", lambda c: c["arrival"].isNotNull() & (c["arrival"] > now)), F.lit(1))
    first = F.try_element_at("calls", F.lit(1))
    starts = F.coalesce(first["arrival"], first["departure"])
    waits = left.isNull() & (starts > now) & (starts - now < 120)
    span = ahead["arrival"] - left["departure"]
    t = (now - left["departure"]) / span
    moves = left.isNotNull() & ahead.isNotNull() & (span > 0)
    pick = lambda a, b: F.when(F.size("calls") < 2, None).when(waits, a).when(moves, b)
    return trips.select(
        "trip_id", pick(first["lat"], lerp(left["lat"], ahead["lat"], t)).alias("lat"), pick(first["lon"], lerp(left["lon"], ahead["lon"], t)).alias("lon"),
        pick(F.lit(0.0), bearing_deg(left["lat"], left["lon"], ahead["lat"], ahead["lon"])).alias("bearing"),
        pick(F.lit(0.0), cosine_law_m(left["lat"], left["lon"], ahead["lat"], ahead["lon"]) / span).alias("speed"),
    )


def previous_positions(positions: DataFrame, ttl_s: int = 120) -> DataFrame:
    """Each position with the one before it of the same vehicle, if that is at most `ttl_s` old and elsewhere."""
    w = W.partitionBy("vehicle_id").orderBy("ts", "event_id")
    rows = positions.withColumns({f"prev_{c}": F.lag(c).over(w) for c in ("lat", "lon", "ts")})
    fresh = (F.unix_micros("ts") - F.unix_micros("prev_ts") <= ttl_s * 1_000_000) & ((F.col("lat") != F.col("prev_lat")) | (F.col("lon") != F.col("prev_lon")))
    return rows.withColumns({f"prev_{c}": F.when(fresh, F.col(f"prev_{c}")) for c in ("lat", "lon", "ts")})


def enrich_vehicles(vehicles: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Vehicles with their route: by their trip where they name none, and the route's name from their own feed, else
    from the first other feed (by feed id) that names it."""
    own = vehicles.join(trips.select("trip_id", F.col("route_id").alias("trip_route")), "trip_id", "left")
    own = own.withColumn("route_id", F.coalesce("route_id", "trip_route")).drop("trip_route")
    exact = routes.select("feed_id", "route_id", F.col("route_name").alias("exact_name"))
    named = routes.where("route_name is not null and route_name != ''")
    any_feed = named.groupBy("route_id").agg(F.min_by("route_name", "feed_id").alias("other_name"))
    out = own.join(exact, ["feed_id", "route_id"], "left").join(any_feed, "route_id", "left")
    return out.withColumn("route_name", F.coalesce(F.nullif("exact_name", F.lit("")), "other_name")).drop("exact_name", "other_name")


def next_stops(updates: DataFrame, now: Column) -> DataFrame:
    """The first stop of each trip, in list order, that is still to come."""
    rows = updates.where(F.col("arrival") > now)
    return rows.groupBy("trip_id").agg(F.min_by(F.struct("stop_id", "arrival"), "seq").alias("n")).select("trip_id", "n.stop_id", "n.arrival")


def available(stations: DataFrame) -> DataFrame:
    """Bikes, e-bikes and scooters of GBFS status rows: e-bikes from the count or the electric types, the rest of the
    bikes without them; not renting only where it says so."""
    electric = F.filter("types", lambda t: F.lower(t["vehicle_type_id"]).contains("electric") | F.lower(t["vehicle_type_id"]).contains("ebike"))
    ebikes = F.coalesce("num_ebikes_available", F.get(electric, F.lit(0))["count"], F.lit(0))
    return stations.withColumns({
        "ebikes": ebikes, "bikes": F.greatest(F.lit(0), F.coalesce("num_bikes_available", F.lit(0)) - ebikes), "renting": F.coalesce("is_renting", F.lit(True)),
    })


def grid_dedupe(stops: DataFrame, cell_deg: float) -> DataFrame:
    """Per grid cell the stop with the most budget left (ties: smaller id)."""
    key = [F.floor(F.col(c) / cell_deg + 0.5).cast("long").alias(f"c_{c}") for c in ("lat", "lon")]
    best = F.min_by(F.struct("id", "lat", "lon", "remaining"), F.struct(-F.col("remaining"), F.col("id")))
    return stops.groupBy(*key).agg(best.alias("b")).select("b.*")


def coarsest_cell(stops: DataFrame, most: int, first: float = 0.0005, last: float = 0.016) -> DataFrame:
    """One row: the smallest of the doubling cell sizes that leaves at most `most` cells (else the last), and the
    cells left; all sizes are counted in one pass."""
    sizes, s = [], first
    while s <= last * 1.0001:
        sizes.append(s)
        s *= 2
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("cell_deg"), F.floor(F.col("lat") / s + 0.5).alias("y"), F.floor(F.col("lon") / s + 0.5).alias("x")) for k, s in enumerate(sizes)])
    counts = stops.select(F.explode(cells).alias("c")).select("c.*").distinct().groupBy("k", "cell_deg").agg(F.count("*").alias("cells"))
    good = F.when((F.col("cells") <= most) | (F.col("k") == len(sizes) - 1), F.struct("k", "cell_deg", "cells"))
    return counts.agg(F.min(good).alias("m")).select("m.cell_deg", "m.cells")


def reach_cells(stops: DataFrame, cell_deg: float, metres_per_s: float = 1.25) -> DataFrame:
    """The grid cells whose centre can be walked to from a stop in its `remaining` seconds: the union of all circles
    as a set of cells, so a larger budget always holds a smaller one."""
    return reach_cells_by(stops.withColumn("_all", F.lit(0)), "_all", cell_deg, metres_per_s).drop("_all")


def reach_cells_by(stops: DataFrame, group: str, cell_deg: float, metres_per_s: float = 1.25) -> DataFrame:
    """`reach_cells` for each group of stops: (group, y, x)."""
    from geoloom.functions.geo import DEG_M

    r = F.col("remaining") * metres_per_s
    dy = F.ceil(r / DEG_M / cell_deg)
    dx = F.ceil(r / DEG_M / F.greatest(F.lit(0.01), F.cos(F.radians("lat"))) / cell_deg)
    y0, x0 = F.floor(F.col("lat") / cell_deg + 0.5), F.floor(F.col("lon") / cell_deg + 0.5)
    rows = stops.select(group, "lat", "lon", r.alias("r"), F.explode(F.sequence(y0 - dy, y0 + dy)).alias("y"), x0.alias("x0"), dx.alias("dx"))
    rows = rows.select(group, "lat", "lon", "r", "y", F.explode(F.sequence(F.col("x0") - F.col("dx"), F.col("x0") + F.col("dx"))).alias("x"))
    return rows.where(haversine_m("lat", "lon", F.col("y") * cell_deg, F.col("x") * cell_deg) <= F.col("r")).select(group, "y", "x").distinct()


def nearest_entrance(places: DataFrame, lat: float, lon: float, metres: float = 500.0, wheelchair: bool = False) -> DataFrame:
    """The best way in near a point: explicit entrances (tier 1), entrances, then stairs and lifts near a platform (2,
    3), rail crossings (4), crossings near a platform (5); the lowest tier that exists, then the nearest.

    "Near a platform" is a semi-join on grid cells, not a search per row.
    """
    t = F.col("tags")
    d = metres / 111_000.0
    box = places.where(F.col("lat").between(lat - d, lat + d) & F.col("lon").between(lon - d, lon + d))
    if wheelchair:
        box = box.where(F.coalesce(t["wheelchair"], F.lit("")) != "no")
    pf = places.where((t["public_transport"] == "platform") | (t["railway"] == "platform")).select("lat", "lon")
    reach = 0.0015
    cell = lambda c, o=0: (F.floor(F.col(c) / reach) + o).cast("long")
    around = pf.select(F.col("lat").alias("pla"), F.col("lon").alias("plo"), F.explode(F.array(*[F.struct(cell("lat", i).alias("cy"), cell("lon", j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")).select("pla", "plo", "c.*")

    def by_platform(df: DataFrame, deg: float) -> DataFrame:
        keyed = df.withColumns({"cy": cell("lat"), "cx": cell("lon")})
        close = (keyed["cy"] == around["cy"]) & (keyed["cx"] == around["cx"]) & (F.abs(keyed["lat"] - around["pla"]) <= deg) & (F.abs(keyed["lon"] - around["plo"]) <= deg)
        return keyed.join(around, close, "left_semi").drop("cy", "cx")

    steps = ["elevator"] if wheelchair else ["steps", "elevator"]
    tiers = [
        (1, box.where(t["railway"].isin("subway_entrance", "train_station_entrance")), t["railway"]),
        (2, by_platform(box.where(t["entrance"].isNotNull() & ~t["entrance"].isin("no", "service", "emergency")), 0.001), F.lit("entrance")),
        (3, by_platform(box.where(t["highway"].isin(*steps)), 0.0015), t["highway"]),
        (4, box.where(t["railway"] == "crossing"), F.lit("railway_crossing")),
        (5, by_platform(box.where((t["highway"] == "crossing") & F.col("lat").between(lat - 0.4 * d, lat + 0.4 * d) & F.col("lon").between(lon - 0.4 * d, lon + 0.4 * d)), 0.001), F.lit("highway_crossing")),
    ]
    out = None
    for tier, rows, kind in tiers:
        part = rows.select("id", "name", F.coalesce(t["wheelchair"], F.lit("")).alias("wheelchair"), kind.alias("access_type"), F.round(haversine_m("lat", "lon", lat, lon), 3).alias("distance_m"), F.lit(tier).alias("tier"))
        out = part if out is None else out.unionByName(part)
    order = [F.asc("tier")] + ([F.desc(F.col("wheelchair") == "yes")] if wheelchair else []) + [F.asc("distance_m"), F.asc("id")]
    return out.orderBy(*order).limit(1)


def boarding_stations(stops: DataFrame, types: DataFrame, lat: float, lon: float, metres: float, n: int) -> DataFrame:
    """Stations around a point to start from: one stop per name (the nearest), rail before bus, then nearest.
    `types` is (feed_id, stop_id, route_type)."""
    low = types.groupBy("feed_id", "stop_id").agg(F.min("route_type").alias("route_type"))
    near = stops.withColumn("distance_m", F.round(haversine_m("lat", "lon", lat, lon), 3)).where(F.col("distance_m") <= metres).join(low, ["feed_id", "stop_id"], "left")
    one = F.row_number().over(W.partitionBy("stop_name").orderBy("distance_m", "feed_id", "stop_id"))
    rows = near.withColumn("k", one).where("k = 1")
    return rows.orderBy(F.coalesce("route_type", F.lit(3)) == 3, "distance_m", "feed_id", "stop_id").limit(n)


def planar_order(lat: float, lon: float) -> Column:
    return planar_degrees("lat", "lon", lat, lon)
