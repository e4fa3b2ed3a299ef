"""Points near other points or inside regions: a dual-tree join over spatial tiles.

Both sides are placed on tiles of a latitude-longitude grid, the region side on every tile its reach touches. Tiles
that hold more than `TILE_ROWS` rows are cut into quarters as often as that needs, and what still is too dense (many
rows at one spot) is cut by hash, so no task ever holds an unbounded group. A task reads its tiles in order, builds a
bounding-box tree over each side of a few of them and compares nodes level by level: pairs of nodes that are too far
apart are discarded, pairs that are certainly near are accepted wholesale, and only undecided leaves are compared row by
row. Pairs leave the task in slices, so its memory does not grow with them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions.geo import EARTH_M, NUMBER
from geoloom.util import materialise

TILE_DEG = 0.1
TILE_ROWS = 8192
TASK_ROWS = 65536
GROUP_ROWS = 16384  # rows of whole tiles that share a tree
SLICE = 1 << 19  # pairs in memory at a time
LEAF = 16
_POINT, _NEAR, _AREA = range(3)
_PAIR = re.compile(rf"({NUMBER})[ \t]+({NUMBER})")


# --- geometry of one task -------------------------------------------------------------------------------------------


def rings_of(wkt: str) -> list[np.ndarray]:
    """The rings of a WKT or EWKT polygon or multipolygon, as arrays of lon, lat."""
    body = wkt.rsplit(";", 1)[-1]
    return [np.array(_PAIR.findall(part), float) for part in re.findall(r"\(([^()]+)\)", body)]


def inside(rings: list[np.ndarray], lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Even-odd test over all rings, so holes and parts need no further rule."""
    odd = np.zeros(len(lon), bool)
    most = max(1, SLICE // max(1, max(map(len, rings), default=1)))
    if len(lon) > most:
        return np.concatenate([inside(rings, lon[k : k + most], lat[k : k + most]) for k in range(0, len(lon), most)])
    for ring in rings:
        x1, y1, x2, y2 = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
        span = (y1[None] > lat[:, None]) != (y2[None] > lat[:, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = (x2 - x1)[None] * (lat[:, None] - y1[None]) / (y2 - y1)[None] + x1[None]
        odd ^= (span & (lon[:, None] < cut)).sum(1) % 2 == 1
    return odd


def unit_xyz(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.stack((np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)), 1)


class BoxTree:
    """A complete binary tree of bounding boxes over rows in Z-order; `low[l]`, `high[l]` are the boxes of level l."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        n, dims = low.shape
        mid = (low + high) / 2
        base, reach = mid.min(0), np.maximum(np.ptp(mid, axis=0), 1e-12)
        bits = 16
        q = ((mid - base) / reach * ((1 << bits) - 1)).astype(np.uint64)
        code = np.zeros(n, np.uint64)
        for b in range(bits - 1, -1, -1):
            for d in range(dims):
                code = (code << np.uint64(1)) | ((q[:, d] >> np.uint64(b)) & np.uint64(1))
        self.order = np.argsort(code, kind="stable")
        self.n = n
        depth = max(0, math.ceil(math.log2(max(1, n / LEAF))))
        slots = LEAF << depth
        pad = np.full((slots - n, dims), np.nan)
        lo = np.concatenate((low[self.order], pad)).reshape(-1, LEAF, dims)
        hi = np.concatenate((high[self.order], pad)).reshape(-1, LEAF, dims)
        with np.errstate(all="ignore"):
            levels = [(np.fmin.reduce(lo, axis=1), np.fmax.reduce(hi, axis=1))]
            while len(levels[-1][0]) > 1:
                a, b = levels[-1]
                levels.append((np.fmin(a[0::2], a[1::2]), np.fmax(b[0::2], b[1::2])))
        self.low, self.high = [x[0] for x in levels[::-1]], [x[1] for x in levels[::-1]]
        self.depth = depth

    def rows(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end row of nodes."""
        size = LEAF << (self.depth - level)
        return np.minimum(node * size, self.n), np.minimum((node + 1) * size, self.n)


def _products(a0, a1, b0, b1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the ranges a0..a1 and b0..b1, about `SLICE` at a time."""
    na, nb = a1 - a0, b1 - b0
    total = np.cumsum(na * nb)
    at = 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, "right")))
        size = (na * nb)[at:end]
        # One pair of large nodes may alone be over the limit.
        for first in range(0, max(1, int(size[0])) if end == at + 1 else 1, SLICE):
            if end == at + 1:
                k = np.arange(first, min(first + SLICE, int(size[0])))
                which = np.zeros(len(k), np.int64)
            else:
                which = np.repeat(np.arange(len(size)), size)
                k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            yield a0[at:end][which] + k // np.maximum(nb[at:end], 1)[which], b0[at:end][which] + k % np.maximum(nb[at:end], 1)[which]
        at = end


def dual_tree(a: BoxTree, b: BoxTree, radius: float) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Slices (sure, rows of a, rows of b): all pairs within `radius` are among them once, and the sure ones are within
    it. Distances are Euclidean in the trees' space; rows are positions in the trees' input."""
    la = lb = 0
    na = nb = np.zeros(1, np.int64)
    while len(na):
        lo = np.maximum(a.low[la][na] - b.high[lb][nb], b.low[lb][nb] - a.high[la][na])
        near = np.sqrt((np.maximum(lo, 0) ** 2).sum(1))
        keep = near <= radius  # false for padding too
        na, nb = na[keep], nb[keep]
        hi = np.maximum(a.high[la][na] - b.low[lb][nb], b.high[lb][nb] - a.low[la][na])
        certain = np.sqrt((hi**2).sum(1)) <= radius
        for i, j in _products(*a.rows(la, na[certain]), *b.rows(lb, nb[certain])):
            yield True, a.order[i], b.order[j]
        na, nb = na[~certain], nb[~certain]
        if la == a.depth and lb == b.depth:
            for i, j in _products(*a.rows(la, na), *b.rows(lb, nb)):
                yield False, a.order[i], b.order[j]
            return
        if la < a.depth:
            la += 1
            na, nb = np.concatenate((2 * na, 2 * na + 1)), np.concatenate((nb, nb))
        if lb < b.depth:
            lb += 1
            na, nb = np.concatenate((na, na)), np.concatenate((2 * nb, 2 * nb + 1))


def distance_m(lat1, lon1, lat2, lon2) -> np.ndarray:
    p, q = np.radians(lat1), np.radians(lat2)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def near_slices(lat1, lon1, lat2, lon2, radius_m: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs whose great-circle distance is at most `radius_m`, each once, a slice at a time."""
    p, q = unit_xyz(lat1, lon1), unit_xyz(lat2, lon2)
    chord = 2 * math.sin(min(math.pi / 2, radius_m / (2 * EARTH_M)))
    for sure, i, j in dual_tree(BoxTree(p, p), BoxTree(q, q), chord):
        if not sure:
            ok = ((p[i] - q[j]) ** 2).sum(1) <= chord * chord
            i, j = i[ok], j[ok]
        yield i, j


# --- one task -------------------------------------------------------------------------------------------------------


def _floats(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy(zero_copy_only=False)


def _group_pairs(rows: pa.RecordBatch, radius_m: float) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(rel, rows of points, rows of places, distances) of whole tiles."""
    kind, part = _floats(rows, "kind"), _floats(rows, "part")
    points, close, areas = (np.flatnonzero(kind == k) for k in (_POINT, _NEAR, _AREA))
    lat, lon = _floats(rows, "lat"), _floats(rows, "lon")
    if len(points) and len(close):
        for i, j in near_slices(lat[points], lon[points], lat[close], lon[close], radius_m):
            i, j = points[i], close[j]
            same = part[i] == part[j]  # a pair counts in the point's tile only
            i, j = i[same], j[same]
            yield "near", i, j, distance_m(lat[i], lon[i], lat[j], lon[j])
    if len(points) and len(areas):
        spot = np.stack((lon, lat), 1)
        low, high = (np.stack([_floats(rows, c) for c in side], 1) for side in (("west", "south"), ("east", "north")))
        geoms, read = rows.column("geom"), {}
        for _, i, j in dual_tree(BoxTree(spot[points], spot[points]), BoxTree(low[areas], high[areas]), 0.0):
            i, j = points[i], areas[j]
            fits = (spot[i] >= low[j]).all(1) & (spot[i] <= high[j]).all(1) & (part[i] == part[j])
            i, j = i[fits], j[fits]
            order = np.argsort(j, kind="stable")
            i, j = i[order], j[order]
            hit = np.zeros(len(i), bool)
            starts = np.flatnonzero(np.concatenate(([True], j[1:] != j[:-1]))) if len(j) else []
            for s, e in zip(starts, [*starts[1:], len(j)]):
                if j[s] not in read:
                    read[j[s]] = rings_of(geoms[int(j[s])].as_py())
                hit[s:e] = inside(read[j[s]], lon[i[s:e]], lat[i[s:e]])
            yield "inside", i[hit], j[hit], None


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, regrouped so that each group holds whole parts, about `GROUP_ROWS` rows or one part."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < GROUP_ROWS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        part = _floats(rows, "part")
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        at = 0
        while len(ends := starts[starts > at]):
            end = ends[max(0, int(np.searchsorted(ends, at + GROUP_ROWS, "right")) - 1)]
            if end == ends[-1] and end - at < GROUP_ROWS:
                break
            yield rows.slice(at, end - at)
            at = int(end)
        held, size = [rows.slice(at)], len(part) - at
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# --- the distributed join -------------------------------------------------------------------------------------------


def _cell(v: Column, deg: float | Column) -> Column:
    return F.floor(v / deg).cast("long")


def _cover(west: Column, south: Column, east: Column, north: Column, deg: Column) -> Column:
    """Structs (tx, ty) of the tiles a box touches; tile columns wrap around the antimeridian."""
    round_ = F.ceil(F.lit(360.0) / deg).cast("long")
    xs = F.transform(F.sequence(_cell(west, deg), F.least(_cell(east, deg), _cell(west, deg) + round_ - 1)), lambda x: F.pmod(x, round_))
    ys = F.sequence(_cell(south, deg), _cell(north, deg))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("tx"), y.alias("ty")))))


def spatial_join(points: DataFrame, places: DataFrame, radius_m: float) -> DataFrame:
    """(rel, point_key, place_id, distance_m) for `points` (key, lat, lon) and `places` (id, lon, lat, geom).

    `rel` is 'near' for a place whose lon/lat is within `radius_m` of the point and 'inside' for a place whose `geom`
    (WKT or EWKT polygon or multipolygon, else null) contains the point, holes excluded; there `distance_m` is null.
    Rows without coordinates, or with NaN, match nothing; coordinates out of range count as they stand on the sphere.
    Each pair comes out once if keys and ids are unique; repeated rows give repeated pairs. Other columns are ignored.
    Empty tables give an empty result. Where many rows share their spot and all pairs are not wanted, see
    `spatial_classes`.
    """
    pts = materialise(points.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").select("key", "lat", "lon"))
    near = places.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    reach = F.lit(radius_m * 1.01 / EARTH_M * 180 / math.pi)
    # Longitudes shrink towards the poles; where the circle may hold a pole it takes the whole round.
    shrink = F.cos(F.radians(F.least(F.lit(90.0), F.abs("lat") + reach)))
    wide = F.when(shrink > 0.001, F.least(F.lit(360.0), reach / shrink)).otherwise(F.lit(360.0))
    base = F.lit(TILE_DEG)
    boxes_near = near.select(
        F.lit(_NEAR).cast("byte").alias("kind"), "id", "lat", "lon", F.lit(None).cast("string").alias("geom"), F.lit(0).alias("zoom"),
        (F.col("lon") - wide).alias("west"), (F.col("lat") - reach).alias("south"), (F.col("lon") + wide).alias("east"), (F.col("lat") + reach).alias("north"),
    )
    numbers = F.regexp_extract_all("geom", F.lit(rf"({NUMBER})[ \t]+({NUMBER})"), F.lit(1)).cast("array<double>")
    others = F.regexp_extract_all("geom", F.lit(rf"({NUMBER})[ \t]+({NUMBER})"), F.lit(2)).cast("array<double>")
    areas = places.where(F.col("geom").rlike(r"(?i)POLYGON[^(]*\(+\s*[-+.\d]")).select("id", "geom", numbers.alias("xs"), others.alias("ys"))
    areas = areas.select("id", "geom", F.array_min("xs").alias("west"), F.array_min("ys").alias("south"), F.array_max("xs").alias("east"), F.array_max("ys").alias("north"))
    # A region larger than a tile goes to a level of larger tiles, so that it never touches more than four.
    side = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    zoom = F.greatest(F.lit(0), F.ceil(F.log2(side / base))).cast("int")
    none = F.lit(None).cast("double")
    boxes_in = areas.select(F.lit(_AREA).cast("byte").alias("kind"), "id", none.alias("lat"), none.alias("lon"), "geom", zoom.alias("zoom"), "west", "south", "east", "north")

    sides = ["kind", "id", "lat", "lon", "geom", "west", "south", "east", "north"]
    boxes = boxes_near.unionByName(boxes_in)
    right = materialise(boxes.withColumn("t", F.explode(_cover(F.col("west"), F.col("south"), F.col("east"), F.col("north"), base * F.pow(F.lit(2.0), "zoom")))).select(*sides, "zoom", "t.*"))
    zooms = sorted(r[0] for r in right.select("zoom").distinct().collect()) or [0]  # at most twelve levels exist
    deg = base * F.pow(F.lit(2.0), "zoom")
    round_ = F.ceil(F.lit(360.0) / deg).cast("long")
    left = pts.select("*", F.explode(F.array(*[F.lit(z) for z in zooms])).alias("zoom")).select("*", F.pmod(_cell(F.col("lon"), deg), round_).alias("tx"), _cell(F.col("lat"), deg).alias("ty"))

    # Rows by tile, counted before anything moves. A tile over the limit is cut into quarters, as often as it needs
    # but not below twice the reach.
    tile = ["zoom", "tx", "ty"]
    floor_ = math.log2(max(1.0, TILE_DEG / (2 * radius_m / EARTH_M * 180 / math.pi + 1e-9)))
    counts = left.groupBy(*tile).agg(F.count("*").alias("n")).join(right.groupBy(*tile).agg(F.count("*").alias("m")), tile)
    need = F.ceil(F.log(4.0, F.greatest("n", "m") / TILE_ROWS))
    cuts = materialise(counts.select(*tile, F.greatest(F.lit(0), F.least(need, F.floor(F.lit(floor_) + F.col("zoom")))).cast("int").alias("k"), "n", "m"))
    most, rows = cuts.agg(F.max(F.greatest("n", "m")), F.sum(F.col("n") + F.col("m"))).first()
    cuts = cuts.drop("n", "m")
    part = F.xxhash64(*tile)
    if (most or 0) > TILE_ROWS:
        fine = deg / F.pow(F.lit(2.0), "k")
        whole = F.pow(F.lit(2.0), "k").cast("long")
        left = left.join(cuts, tile).select(
            "key", "lat", "lon", "zoom", "k", F.pmod(_cell(F.col("lon"), fine), round_ * whole).alias("fx"), _cell(F.col("lat"), fine).alias("fy")
        )
        parts = F.filter(
            _cover(F.col("west"), F.col("south"), F.col("east"), F.col("north"), fine),
            lambda t: (F.floor(t["tx"] / whole) == F.col("tx")) & (F.floor(t["ty"] / whole) == F.col("ty")),
        )
        right = right.join(cuts, tile).select(*sides, "zoom", "k", F.explode(F.when(F.col("k") == 0, F.array(F.struct("tx", "ty"))).otherwise(parts)).alias("t"))
        right = right.select(*sides, "zoom", "k", F.col("t.tx").alias("fx"), F.col("t.ty").alias("fy"))
        # What is still too dense lies at one spot; it is cut by hash, each part of one side meeting each of the other.
        # At most one spot in `TILE_ROWS` rows is.
        spot = ["zoom", "k", "fx", "fy"]
        counts = left.groupBy(*spot).agg(F.count("*").alias("n")).join(right.groupBy(*spot).agg(F.count("*").alias("m")), spot)
        counts = materialise(counts.select(*spot, *[F.ceil(F.col(a) / TILE_ROWS).cast("int").alias(b) for a, b in (("n", "cn"), ("m", "cm"))], "n", "m"))
        rows = counts.agg(F.sum(F.col("n") * F.col("cm") + F.col("m") * F.col("cn"))).first()[0]
        dense = materialise(counts.where("cn > 1 or cm > 1").select(*spot, "cn", "cm"))
        deal = lambda n, *key: F.pmod(F.xxhash64(*key), F.coalesce(n, F.lit(1))).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
        left = left.join(dense, spot, "left").select("key", "lat", "lon", *spot, deal(F.col("cn"), "lat", "lon", "key").alias("i"), each(F.col("cm")).alias("j"))
        right = right.join(dense, spot, "left").select(*sides, *spot, deal(F.col("cm"), "id", "kind").alias("j"), each(F.col("cn")).alias("i"))
        part = F.xxhash64(*spot, "i", "j")
    else:
        left, right = left.join(cuts, tile, "left_semi"), right.join(cuts, tile, "left_semi")
    none = {c: F.lit(None).cast(t) for c, t in (("geom", "string"), *((x, "double") for x in ("west", "south", "east", "north")))}
    key_type, id_type = points.schema["key"].dataType, places.schema["id"].dataType
    both = left.select(part.alias("part"), F.lit(_POINT).cast("byte").alias("kind"), "key", F.lit(None).cast(id_type).alias("id"), "lat", "lon", *[v.alias(c) for c, v in none.items()])
    both = both.unionByName(right.select(part.alias("part"), "kind", F.lit(None).cast(key_type).alias("key"), *sides[1:]))
    both = both.repartition(max(1, math.ceil((rows or 0) / TASK_ROWS)), "part").sortWithinPartitions("part")
    names = ["rel", "point_key", "place_id", "distance_m"]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, (T.StringType(), key_type, id_type, T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_parts(batches):
            for rel, i, j, dist in _group_pairs(group, radius_m):
                if len(i):
                    away = pa.nulls(len(i), pa.float64()) if dist is None else pa.array(dist)
                    columns = [pa.array([rel]).take(pa.array(np.zeros(len(i), np.int8))), group.column("key").take(pa.array(i)), group.column("id").take(pa.array(j)), away]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(run, schema)


def spatial_classes(points: DataFrame, places: DataFrame, radius_m: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, members of points, members of places): the join between spots instead of rows.

    Points of equal coordinates, and places of equal coordinates and geometry, form a class, named after its smallest
    key or id and joined once; `pairs` is as of `spatial_join`, between classes, and the members (key or id, class_id,
    links) name each row's class and the classes it is linked with. A spot that holds a third of all rows costs no more
    than one row. Rows that match nothing have 0 links.
    """
    spots = points.groupBy("lat", "lon").agg(F.min("key").alias("class_id"))
    forms = places.groupBy("lat", "lon", "geom").agg(F.min("id").alias("class_id"))
    pairs = materialise(spatial_join(spots.withColumnRenamed("class_id", "key"), forms.withColumnRenamed("class_id", "id"), radius_m))

    def members(rows: DataFrame, classes: DataFrame, on: list[str], name: str, side: str) -> DataFrame:
        same = classes.select(*[F.col(c).alias(f"_{c}") for c in on], "class_id")
        match = rows.join(same, [rows[c].eqNullSafe(same[f"_{c}"]) for c in on]).select(name, "class_id")
        links = pairs.groupBy(F.col(side).alias("class_id")).agg(F.count("*").alias("links"))
        return match.join(links, "class_id", "left").select(name, "class_id", F.coalesce("links", F.lit(0)).alias("links"))

    return pairs, members(points, spots, ["lat", "lon"], "key", "point_key"), members(places, forms, ["lat", "lon", "geom"], "id", "place_id")
