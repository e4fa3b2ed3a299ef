"""Hybrid place search: one scan marks every layer a place answers in; layers are merged by priority and ranked again."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions import text as txt
from geoloom.functions.geo import DEG_M, haversine_m, in_box, line_m, planar_degrees, point_of, ring_contains, within_m
from geoloom.operators.enrich import rings
from geoloom.util import materialise

# Fixed values of the ranking.
CODE_RANK, ABBREV_RANK, FTS_BOOST, WORD_FLOOR, SIMILAR = 0.98, 0.90, 1.5, 0.5, 0.3
DECAY_DEG, DECAY_M, UNKNOWN_M, WIDEN_DEG, POOL = 0.45, 50_000.0, 100_000.0, 1.35, 200
NEAR_M = 50_000.0  # of the box that autocompletion looks into
LEAST_TEXT, LEAST_RETRY, LEAST_FEW = 2, 4, 5  # letters to complete, letters to look farther, hits below which vectors help


def searchable(places: DataFrame) -> DataFrame:
    """Places with `lat`, `lon` and their search words `ts`."""
    at = point_of("centroid")
    ts = txt.search_tokens("name", "names", "name_abbrev", "categories", "parent_context", F.col("osm_type") == "X")
    return places.withColumns({"lat": at["lat"], "lon": at["lon"], "ts": ts})


def demotion(categories: Column | str = "categories") -> Column:
    """Weight of a place's first category: roads and cameras count less."""
    first = F.try_element_at(F.col(categories) if isinstance(categories, str) else categories, F.lit(1))
    return F.when(first == "highway/intersection", 0.7).when(first.startswith("highway/"), 0.3).when(first.startswith("man_made/surveillance"), 0.2).otherwise(1.0)


def has_category(prefix: str, categories: str = "categories") -> Column:
    """Whether a category is `prefix` or below it."""
    return F.exists(F.col(categories), lambda c: (c == prefix) | c.startswith(f"{prefix}/"))


def has_tags(wanted: dict[str, str], tags: str = "tags") -> Column:
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & F.coalesce(F.col(tags)[k] == v, F.lit(False))
    return out


def all_words(ts: Column, query: str, prefix: bool = False) -> Column:
    """Whether all words of the query are among `ts`; with `prefix` the last may be the start of one."""
    q = [w for w in txt_words(query)]
    if not q:
        return F.lit(False)
    exact, last = (q[:-1], q[-1]) if prefix else (q, None)
    out = F.lit(True)
    for w in exact:
        out = out & F.array_contains(ts, w)
    return out & F.exists(ts, lambda t: t.startswith(last)) if last else out


def txt_words(query: str) -> list[str]:
    """The query's words as the search words are made."""
    import re
    import unicodedata

    bare = "".join(ch for ch in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(ch))
    return list(dict.fromkeys(re.findall(r"[^\W_]+", bare)))


@dataclass
class Request:
    """A search; without text it browses a category around a point or along a line."""

    query: str = ""
    lat: float | None = None
    lon: float | None = None
    radius: float | None = None
    line: list[tuple[float, float]] | None = None
    buffer: float = 1000.0
    categories: list[str] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    limit: int = 20
    offset: int = 0
    autocomplete: bool = False
    semantic: bool = False
    vector: list[float] | None = None  # of the query, from the model that made the places' embeddings
    exclude: list[str] = field(default_factory=list)

    def __post_init__(self):
        if (self.lat is None) != (self.lon is None):
            raise ValueError("lat and lon go together")
        if self.lat is not None and not (-90 <= self.lat <= 90 and -180 <= self.lon <= 180):
            raise ValueError("coordinates out of range")
        if self.limit < 1 or self.offset < 0:
            raise ValueError("limit must be positive and offset not negative")


def _filters(r: Request) -> Column:
    out = F.lit(True)
    if r.categories:
        out = out & F.arrays_overlap("categories", F.array(*[F.lit(c) for c in r.categories]))
    if r.tags:
        out = out & has_tags(r.tags)
    if r.exclude:
        out = out & ~F.col("id").isin(*r.exclude)
    return out


def _distance(r: Request) -> Column:
    if r.line:
        return line_m("lat", "lon", r.line)
    return haversine_m("lat", "lon", r.lat, r.lon) if r.lat is not None else F.lit(None).cast("double")


def browse(places: DataFrame, r: Request) -> DataFrame:
    """Places around a point (radius), in a wide box (category without radius) or along a line, nearest first; along
    a line near ones count by an exponential of the distance."""
    df = places.where(_filters(r)).withColumn("distance_m", _distance(r)).withColumn("text_rank", F.lit(1.0))
    if r.line:
        d = r.buffer / DEG_M
        lons, lats = [p[0] for p in r.line], [p[1] for p in r.line]
        df = df.where(in_box("lat", "lon", min(lats) - d, min(lons) - d, max(lats) + d, max(lons) + d)).where(F.col("distance_m") <= r.buffer)
        order = [F.desc(F.round(F.exp(-F.coalesce(F.nullif("distance_m", F.lit(0.0)), F.lit(r.buffer)) / (r.buffer / 3)), 9))]
    else:
        near = within_m("lat", "lon", r.lat, r.lon, r.radius) if r.radius else in_box("lat", "lon", r.lat - WIDEN_DEG, r.lon - WIDEN_DEG, r.lat + WIDEN_DEG, r.lon + WIDEN_DEG)
        df = df.where(near)
        order = [F.asc(F.round(planar_degrees("lat", "lon", r.lat, r.lon), 9))]
    return df.orderBy(*order, "id").offset(r.offset).limit(r.limit)


def layers(places: DataFrame, r: Request, local: bool) -> DataFrame:
    """(id, name, categories, lat, lon, priority, text_rank, pos): the best of the layers codes, abbreviation, words and
    likeness (1 to 4). All layers are marked in one scan; what a layer costs is only computed where it is met.

    With `local` words are looked for in a box around the point, nearest first, and likeness is left out.
    """
    q = txt.sanitise_query(r.query)
    words = q.split()
    low = q.lower()
    dist = F.round(planar_degrees("lat", "lon", r.lat, r.lon), 9) if r.lat is not None else F.lit(None).cast("double")
    whole = txt.similarity("name", F.lit(q))
    sims = [txt.similarity("name", F.lit(w)) for w in words]
    best = F.greatest(*sims) if len(sims) > 1 else sims[0]
    last = F.lit(float("inf"))
    marks: list[Column] = []

    def layer(priority: int, hit: Column, rank: Column, *order: Column, name: Column | None = None) -> None:
        keys = [F.coalesce(o.cast("double"), last) for o in order] + [F.lit(0.0)] * (2 - len(order))
        entry = F.struct(F.lit(priority).alias("priority"), rank.cast("double").alias("text_rank"), keys[0].alias("o1"), keys[1].alias("o2"), (name if name is not None else F.lit("")).alias("o3"))
        marks.append(F.when(F.coalesce(hit, F.lit(False)), entry))

    if len(q) <= 20:
        layer(1, F.array_contains("codes", low), F.lit(CODE_RANK), F.col("geom_type") == "line", -F.col("area_m2"))
        layer(2, F.col("name_abbrev") == low, F.lit(ABBREV_RANK) * demotion(), *([dist] if r.lat is not None else []), name=None if r.lat is not None else F.coalesce("name", F.lit("")))
    floor_ = F.lit(WORD_FLOOR if len(words) > 1 else 0.0)
    fts = all_words(F.col("ts"), q, r.autocomplete)
    fts_rank = FTS_BOOST * F.greatest(F.coalesce(whole, F.lit(0.0)), F.coalesce(best, F.lit(0.0)), floor_) * demotion()
    if local:
        d = max(r.radius or 0, NEAR_M) / DEG_M
        layer(3, in_box("lat", "lon", r.lat - d, r.lon - d, r.lat + d, r.lon + d) & fts, fts_rank, dist)
    else:
        layer(3, fts, fts_rank, -F.round(fts_rank / (1 + F.coalesce(dist, F.lit(0.0)) / DECAY_DEG), 9))
        if len(q) > 4:
            rank = whole * demotion()
            if len(words) > 1:
                covered = sum((F.when((x > SIMILAR) | all_words(F.col("ts"), w), 1).otherwise(0) for x, w in zip(sims, words)), F.lit(0))
                rank = best * (0.3 + 0.7 * covered / len(words)) * demotion()
            like = F.col("name").isNotNull() & txt.like_filter("name", q, SIMILAR) & (whole >= SIMILAR)
            layer(4, like, rank, -F.round(whole, 9))
    shown = ["id", "name", "categories", "lat", "lon"]
    marked = places.where(_filters(r)).select(*shown, F.explode(F.array_compact(F.array(*marks))).alias("m")).select(*shown, "m.*")
    pos = F.row_number().over(W.partitionBy("priority").orderBy("o1", "o2", "o3", "id"))
    most = max(POOL, r.limit) if local else r.limit
    kept = marked.withColumn("pos", pos).where(F.col("pos") <= most)
    return kept.where((F.col("pos") <= r.limit) | (F.lit(local) & (F.col("priority") == 3) & (F.col("pos") <= POOL))).select(*shown, "priority", "text_rank", "pos")


def _firsts(rows: DataFrame) -> DataFrame:
    """Each place once, where it comes first."""
    rest = [c for c in rows.columns if c not in ("id", "priority", "pos")]
    return rows.groupBy("id").agg(F.min(F.struct("priority", "pos", *rest)).alias("m")).select("id", "m.*")


def alike(places: DataFrame, r: Request) -> DataFrame:
    """The places whose `embedding` is nearest to the request's vector, as a layer of priority 5."""
    v = F.array(*[F.lit(float(x)) for x in r.vector])
    e = F.col("embedding").cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = sum(float(x) ** 2 for x in r.vector) ** 0.5
    usable = (F.size("embedding") == len(r.vector)) & F.exists("embedding", lambda x: x != 0)
    rows = places.where(_filters(r)).where(usable).select("id", "name", "categories", "lat", "lon", (dot(e, v) / (F.sqrt(dot(e, e)) * norm)).alias("text_rank"))
    order = [F.desc(F.round("text_rank", 9)), F.asc("id")]
    pos = F.row_number().over(W.orderBy(*order))  # over at most twice the limit
    return rows.orderBy(*order).limit(2 * r.limit).select("id", "name", "categories", "lat", "lon", F.lit(5).alias("priority"), "text_rank", pos.alias("pos"))


def search(places: DataFrame, r: Request) -> DataFrame:
    """`places` (as from `searchable`) that answer the request, best first, with text_rank, distance_m and place.

    Layers are merged by priority (codes, abbreviation, words, likeness), a place counts where it comes first, and the
    best are ranked again by distance; code matches stay on top. An unknown distance, and one of exactly 0, counts as
    100 km. Ties go to the smaller id. Completion around a point looks nearby only, takes a pool of candidates into the
    ranking and looks everywhere if nothing is there (from four letters on); texts of one letter complete to nothing.
    With a query vector the nearest places by embedding fill up what is left where the texts gave few, or on request.
    """
    text = txt.sanitise_query(r.query)
    if not text:
        return browse(places, r)
    local = r.autocomplete and r.lat is not None
    first = _firsts(layers(places, r, local))
    if r.autocomplete and len(text) < LEAST_TEXT:
        first = first.limit(0)
    elif local and len(text) >= LEAST_RETRY and not txt.looks_like_address(r.query):
        first = materialise(first)  # at most the pool
        if first.isEmpty():
            first = _firsts(layers(places, r, False).where("priority >= 3"))
    most = POOL if local else r.limit
    pool = first.orderBy("priority", "pos").limit(most)
    if r.vector and not r.autocomplete:
        far = alike(places, r).join(pool.select("id"), "id", "left_anti")
        told = F.sum(F.when(F.col("priority") < 5, 1).otherwise(0)).over(W.partitionBy(F.lit(1)))  # over at most three times the limit
        both = pool.unionByName(far).withColumn("_told", told)
        pool = both.where((F.col("priority") < 5) | F.lit(r.semantic) | (F.col("_told") < min(LEAST_FEW, r.limit))).drop("_told").orderBy("priority", "pos").limit(most)
    rows = pool.withColumn("distance_m", _distance(r))
    if r.line:
        decay = F.exp(-F.coalesce(F.nullif("distance_m", F.lit(0.0)), F.lit(r.buffer)) / (r.buffer / 3))
    elif r.lat is not None:
        decay = 1 / (1 + F.coalesce(F.nullif("distance_m", F.lit(0.0)), F.lit(UNKNOWN_M)) / DECAY_M)
    else:
        decay = None
    pinned = F.col("priority") == 1
    score = F.round(F.col("text_rank") * decay, 9) if decay is not None else -(F.col("priority") * 1000 + F.col("pos"))
    rows = rows.withColumn("score", score)
    return rows.orderBy(F.desc(pinned), F.when(pinned, F.col("pos")), F.desc("score"), "id").limit(r.limit)


def contains(wkt: Column | str, lat, lon) -> Column:
    """Whether a polygon or multipolygon in WKT holds a point, holes excluded."""
    return F.aggregate(rings(wkt), F.lit(False), lambda odd, ring: odd != ring_contains(ring, lat, lon))


def containing_areas(places: DataFrame, lat: float, lon: float, exclude: str | None = None) -> DataFrame:
    """Areas that hold the point, smallest first."""
    df = places.where("geom_type = 'area'").where(contains("geom", F.lit(lat), F.lit(lon)))
    if exclude:
        df = df.where(F.col("id") != exclude)
    return df.orderBy(F.col("area_m2").asc_nulls_last(), "id")


def address_roles(rows: DataFrame) -> DataFrame:
    """One row (city, county, state, country) from areas (name, admin_level): levels in falling order fill the first
    free role they reach (8 city, 6 county, 4 state, 2 country), so a second high level falls through to the next."""
    listed = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("admin_level")).alias("o"), F.col("id"), F.col("name"), F.col("admin_level").alias("l")))).alias("a"))  # the areas over one point
    start = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("city", "county", "state", "country")])

    def fill(s: Column, x: Column) -> Column:
        free = [s[c].isNull() | (s[c] == "") for c in ("city", "county", "state", "country")]
        level, name = x["l"], x["name"]
        city = (level >= 8) & free[0]
        county = ~city & (level >= 6) & free[1]
        state = ~city & ~county & (level >= 4) & free[2]
        country = ~city & ~county & ~state & (level >= 2) & free[3]
        return F.struct(*[F.when(hit, name).otherwise(s[c]).alias(c) for hit, c in zip((city, county, state, country), ("city", "county", "state", "country"))])

    return listed.select(F.aggregate("a", start, fill).alias("r")).select("r.*")


def children_of(places: DataFrame, area_id: str, *, category: str | None = None, limit: int = 20, offset: int = 0, lat: float | None = None, lon: float | None = None) -> DataFrame:
    """Places within an area, named and categorised ones first, then by distance and name.

    The area's outline is a scalar subquery: it is read where the plan runs, and no join is needed.
    """
    around = places.where((F.col("id") == area_id) & (F.col("geom_type") == "area")).agg(F.min("geom").alias("around"))
    df = places.where((F.col("id") != area_id) & F.col("tags")["building:part"].isNull())
    df = df.withColumn("around", around.scalar()).where(contains("around", F.col("lat"), F.col("lon")))
    if category:
        df = df.where(has_category(category))
    dist = F.round(planar_degrees("lat", "lon", lat, lon), 9) if lat is not None else F.lit(0.0)
    order = [F.asc(F.col("name").isNull()), F.asc(F.coalesce(F.size("categories"), F.lit(0)) == 0), dist, F.col("name").asc_nulls_last(), F.asc("id")]
    return df.orderBy(*order).offset(offset).limit(limit)


def at_address(places: DataFrame, number: str, street: str, lat: float, lon: float) -> DataFrame:
    """The place of an address within 40 m: areas first, then those that hold the point, then the nearest."""
    t = F.col("tags")
    df = places.where((t["addr:housenumber"] == number) & (F.lower(t["addr:street"]) == street.lower())).where(within_m("lat", "lon", lat, lon, 40.0))
    order = [F.desc(F.col("geom_type") == "area"), F.desc(contains("geom", F.lit(lat), F.lit(lon))), F.round(haversine_m("lat", "lon", lat, lon), 6), F.col("id")]
    return df.orderBy(*order).limit(1)


def reverse_geocode(places: DataFrame, lat: float, lon: float, *, limit: int = 5, radius: float = 100.0) -> DataFrame:
    """The nearest named places; those without an address borrow that of the first that has street and number."""
    dist = F.round(haversine_m("lat", "lon", lat, lon), 6)
    near = places.where("name is not null").where(within_m("lat", "lon", lat, lon, radius)).withColumn("distance_m", dist).orderBy("distance_m", "id").limit(limit)
    t = F.col("tags")
    full = F.when(t["addr:street"].isNotNull() & t["addr:housenumber"].isNotNull(), F.concat_ws(" ", t["addr:housenumber"], t["addr:street"]))
    over = W.orderBy("distance_m", "id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # over at most `limit` rows
    return near.withColumn("own", full).withColumn("address_line", F.coalesce("own", F.first("own", ignorenulls=True).over(over)))
