"""Queries of place search, containment and geocoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import text as txt
from geoloom.functions.geo import haversine_m
from geoloom.operators import search as s
from geoloom.plans.places import P, places, similarity_sql, stored_places
from geoloom.util import table

QUERIES: dict = {}
ORACLES: dict = {}
LAT, LON = 25.1, -55.3
LINE = [(-55.31, 25.09), (-55.30, 25.10), (-55.29, 25.105)]
TEXT = "market hall"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def found(spark, sf_dir):
    return stored_places(spark, sf_dir)


HAV = f"2*6371000.0*asin(least(1.0, sqrt(pow(sin(radians({LAT}-lat)/2),2)+cos(radians(lat))*cos(radians({LAT}))*pow(sin(radians(({LON})-lon)/2),2))))"
DEG = f"round(sqrt(pow(lat-({LAT}),2)+pow(lon-({LON}),2)), 9)"
DEMOTE = "CASE WHEN categories[1] = 'highway/intersection' THEN 0.7 WHEN starts_with(categories[1], 'highway/') THEN 0.3 WHEN starts_with(categories[1], 'man_made/surveillance') THEN 0.2 ELSE 1.0 END"
TS = r"""list_distinct(list_filter(regexp_split_to_array(lower(strip_accents(replace(concat_ws(' ', replace(coalesce(name, ''), ' & ', ' and et und y e '), coalesce(name_abbrev, ''),
  translate(array_to_string(categories, ' '), '/_', '  '), coalesce(parent_context, '')), chr(39), ''))), '[^\p{L}\p{N}]+'), lambda x: x <> ''))"""
Q = f"{P}, q AS (SELECT *, {TS} AS ts, {DEMOTE}::DOUBLE AS demote FROM p)"


@query(f"WITH {P} SELECT id, name, round({HAV}, 1) AS distance_m FROM p WHERE list_has_any(categories, ['amenity/cafe', 'amenity/restaurant', 'amenity/fuel']) AND {HAV} <= 5000 ORDER BY {DEG}, id LIMIT 50")
def browse_radius(spark, sf_dir):
    out = s.browse(found(spark, sf_dir), s.Request(lat=LAT, lon=LON, radius=5000, categories=["amenity/cafe", "amenity/restaurant", "amenity/fuel"], limit=50))
    return out.select("id", "name", F.round("distance_m", 1).alias("distance_m"))


@query(f"WITH {P} SELECT id, name, round({HAV}, 1) AS distance_m FROM p WHERE list_has_any(categories, ['amenity/fuel']) AND lat BETWEEN {LAT}-1.35 AND {LAT}+1.35 AND lon BETWEEN {LON}-1.35 AND {LON}+1.35 ORDER BY {DEG}, id LIMIT 20")
def browse_widen(spark, sf_dir):
    out = s.browse(found(spark, sf_dir), s.Request(lat=LAT, lon=LON, categories=["amenity/fuel"]))
    return out.select("id", "name", F.round("distance_m", 1).alias("distance_m"))


def _segment(a, b) -> str:
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = f"greatest(0.0, least(1.0, ((lon-({a[0]}))*({dx!r})+(lat-({a[1]}))*({dy!r}))/{dx * dx + dy * dy!r}))"
    y, x = f"({a[1]}+{t}*({dy!r}))", f"({a[0]}+{t}*({dx!r}))"
    return f"2*6371000.0*asin(least(1.0, sqrt(pow(sin(radians({y}-lat)/2),2)+cos(radians(lat))*cos(radians({y}))*pow(sin(radians({x}-lon)/2),2))))"


@query(f"WITH {P}, d AS (SELECT id, name, least({', '.join(_segment(a, b) for a, b in zip(LINE, LINE[1:]))}) AS d FROM p WHERE lat IS NOT NULL) SELECT id, name, round(d, 1) AS distance_m FROM d WHERE d <= 400 ORDER BY round(exp(-coalesce(nullif(d, 0.0), 400)/(400/3.0::DOUBLE)), 9) DESC, id LIMIT 50")
def route_corridor(spark, sf_dir):
    out = s.browse(found(spark, sf_dir), s.Request(line=LINE, buffer=400.0, limit=50))
    return out.select("id", "name", F.round("distance_m", 1).alias("distance_m"))


@query(f"WITH {Q} SELECT id, name, demote FROM q WHERE list_has_all(ts, ['market', 'hall'])")
def fts_and(spark, sf_dir):
    return found(spark, sf_dir).where(s.all_words(F.col("ts"), TEXT)).select("id", "name", s.demotion().alias("demote"))


@query(f"WITH {Q} SELECT id, name FROM q WHERE list_contains(ts, 'market') AND len(list_filter(ts, lambda x: starts_with(x, 'ha'))) > 0")
def fts_prefix(spark, sf_dir):
    return found(spark, sf_dir).where(s.all_words(F.col("ts"), "market ha", prefix=True)).select("id", "name")


@query(f"WITH {P}, d AS (SELECT id, name, {similarity_sql('name', repr('Brouglyrt Market'))} AS sim FROM p WHERE name IS NOT NULL) SELECT id, name, round(sim, 4) AS sim FROM d WHERE sim >= 0.3")
def trigram_fuzzy(spark, sf_dir):
    rows = places(spark, sf_dir).where("name is not null").where(txt.like_filter("name", "Brouglyrt Market", s.SIMILAR)).withColumn("sim", txt.similarity("name", F.lit("Brouglyrt Market")))
    return rows.where(F.col("sim") >= s.SIMILAR).select("id", "name", F.round("sim", 4).alias("sim"))


@query(f"WITH {P}, c AS (SELECT DISTINCT id, geom_type, area_m2, unnest(codes) AS code FROM p) SELECT code, id, row_number() OVER (PARTITION BY code ORDER BY geom_type = 'line', area_m2 DESC NULLS LAST, id)::INTEGER AS pos FROM c")
def codes_lookup(spark, sf_dir):
    """Every code with its places in the order a lookup shows them."""
    from pyspark.sql import Window as W

    rows = places(spark, sf_dir).select("id", "geom_type", "area_m2", F.explode("codes").alias("code")).distinct()
    order = W.partitionBy("code").orderBy(F.asc(F.col("geom_type") == "line"), F.col("area_m2").desc_nulls_last(), "id")
    return rows.select("code", "id", F.row_number().over(order).alias("pos"))


@query(f"WITH {Q} SELECT id, demote FROM q")
def category_demotion(spark, sf_dir):
    return places(spark, sf_dir).select("id", s.demotion().alias("demote"))


def _hybrid_sql(text: str) -> str:
    words = text.split()
    sim = {w: similarity_sql("name", f"'{w}'") for w in [*words, text]}
    best = f"greatest({', '.join(sim[w] for w in words)})"
    cover = " + ".join(f"CASE WHEN {sim[w]} > 0.3 OR list_contains(ts, '{w}') THEN 1 ELSE 0 END" for w in words)
    return f"""WITH {Q},
x AS (SELECT *, coalesce({sim[text]}, 0.0) AS whole, coalesce({best}, 0.0) AS best, {cover} AS cover, {DEG} AS deg FROM q),
l1 AS (SELECT id, 0.98::DOUBLE AS r, 1 AS pr, row_number() OVER (ORDER BY geom_type = 'line', area_m2 DESC NULLS LAST, id) AS pos FROM x WHERE list_contains(codes, '{text}') QUALIFY pos <= 20),
l2 AS (SELECT id, 0.90::DOUBLE * demote AS r, 2 AS pr, row_number() OVER (ORDER BY deg, id) AS pos FROM x WHERE name_abbrev = '{text}' QUALIFY pos <= 20),
f AS (SELECT *, 1.5::DOUBLE * greatest(whole, best, 0.5::DOUBLE) * demote AS r FROM x WHERE list_has_all(ts, {words})),
l3 AS (SELECT id, r, 3 AS pr, row_number() OVER (ORDER BY round(r / (1 + coalesce(deg, 0.0) / 0.45::DOUBLE), 9) DESC, id) AS pos FROM f QUALIFY pos <= 20),
l4 AS (SELECT id, best * (0.3::DOUBLE + 0.7::DOUBLE * cover / {len(words)}) * demote AS r, 4 AS pr, row_number() OVER (ORDER BY round(whole, 9) DESC, id) AS pos FROM x WHERE name IS NOT NULL AND whole >= 0.3 QUALIFY pos <= 20),
m AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4),
g AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY pr, pos) = 1),
t AS (SELECT * FROM g ORDER BY pr, pos LIMIT 20),
z AS (SELECT t.id, x.name, t.pr, t.pos, t.r, {HAV.replace('lat', 'x.lat').replace('lon', 'x.lon')} AS d FROM t JOIN x USING (id))
SELECT id, name, pr AS priority, round(r, 6) AS text_rank, round(d, 1) AS distance_m FROM z
ORDER BY pr = 1 DESC, CASE WHEN pr = 1 THEN pos END, round(r / (1 + coalesce(nullif(d, 0.0), 100000.0) / 50000.0), 9) DESC, id LIMIT 20"""


@query(_hybrid_sql(TEXT))
def hybrid_search(spark, sf_dir):
    out = s.search(found(spark, sf_dir), s.Request(query=TEXT, lat=LAT, lon=LON))
    return out.select("id", "name", "priority", F.round("text_rank", 6).alias("text_rank"), F.round("distance_m", 1).alias("distance_m"))


@query("""WITH e AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT embedding AS v FROM e WHERE vec_id = 0)
SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 5) AS distance FROM e, q WHERE vec_id <> 0 ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 9), vec_id LIMIT 10""")
def vector_knn(spark, sf_dir):
    """The ten rows nearest to one vector: a scan with a bounded heap per task."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    target = rows.where("vec_id = 0").agg(F.first("v").alias("t")).scalar()
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    both = rows.where("vec_id <> 0").withColumn("t", target)
    d = 1 - dot("v", "t") / F.sqrt(dot("v", "v") * dot("t", "t"))
    return both.select("vec_id", d.alias("d")).orderBy(F.round("d", 9), "vec_id").limit(10).select("vec_id", F.round("d", 5).alias("distance"))


_EDGE = r"""r AS (SELECT id, unnest(regexp_extract_all(geom, '\(([^()]+)\)', 1)) AS ring, generate_subscripts(regexp_extract_all(geom, '\(([^()]+)\)', 1), 1) AS k FROM p WHERE geom_type = 'area' AND geom LIKE '%POLYGON%'),
v AS (SELECT id, k, unnest(regexp_extract_all(ring, '([-0-9.]+) +([-0-9.]+)', 1))::DOUBLE AS x, unnest(regexp_extract_all(ring, '([-0-9.]+) +([-0-9.]+)', 2))::DOUBLE AS y,
  generate_subscripts(regexp_extract_all(ring, '([-0-9.]+) +([-0-9.]+)', 1), 1) AS i FROM r),
e AS (SELECT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.id = b.id AND a.k = b.k AND b.i = a.i + 1)"""
_OVER = f"over_ AS (SELECT id FROM e WHERE (y1 > {LAT}) <> (y2 > {LAT}) AND {LON} < (x2-x1)*({LAT}-y1)/(y2-y1)+x1 GROUP BY id HAVING count(*) % 2 = 1)"


@query(f"WITH {P}, {_EDGE}, {_OVER} SELECT id, name, admin_level FROM p SEMI JOIN over_ USING (id)")
def contains_point(spark, sf_dir):
    return s.containing_areas(places(spark, sf_dir), LAT, LON).select("id", "name", "admin_level")


@query(f"""WITH {P}, {_EDGE}, {_OVER}, h AS (SELECT name, admin_level AS l, row_number() OVER (ORDER BY admin_level DESC, id) AS k FROM p SEMI JOIN over_ USING (id) WHERE admin_level IS NOT NULL),
a AS (SELECT (SELECT min(k) FROM h WHERE l >= 8) AS c),
b AS (SELECT c, (SELECT min(k) FROM h WHERE l >= 6 AND k <> coalesce(c, -1)) AS co FROM a),
d AS (SELECT c, co, (SELECT min(k) FROM h WHERE l >= 4 AND k NOT IN (coalesce(c, -1), coalesce(co, -1))) AS st FROM b),
g AS (SELECT c, co, st, (SELECT min(k) FROM h WHERE l >= 2 AND k NOT IN (coalesce(c, -1), coalesce(co, -1), coalesce(st, -1))) AS cy FROM d)
SELECT (SELECT name FROM h WHERE k = c) AS city, (SELECT name FROM h WHERE k = co) AS county, (SELECT name FROM h WHERE k = st) AS state, (SELECT name FROM h WHERE k = cy) AS country FROM g""")
def reverse_geocode_roles(spark, sf_dir):
    rows = s.containing_areas(places(spark, sf_dir), LAT, LON).where("admin_level is not null")
    return s.address_roles(rows)


_AREA = "(SELECT min(id) FROM p WHERE admin_level = 8 AND geom IS NOT NULL)"


@query(f"""WITH {P}, {_EDGE}, o AS (SELECT p.id FROM p JOIN e ON e.id = {_AREA} AND (y1 > lat) <> (y2 > lat) AND lon < (x2-x1)*(lat-y1)/(y2-y1)+x1 GROUP BY p.id HAVING count(*) % 2 = 1)
SELECT id, name, array_to_string(categories, '|') AS categories FROM p SEMI JOIN o USING (id) WHERE id <> {_AREA} AND tags['building:part'] IS NULL ORDER BY name IS NULL, len(categories) = 0, name NULLS LAST, id LIMIT 50""")
def children_of_area(spark, sf_dir):
    df = found(spark, sf_dir)
    area = df.where("admin_level = 8 and geom is not null").agg(F.min("id")).first()[0]
    return s.children_of(df, area, limit=50).select("id", "name", F.array_join("categories", "|").alias("categories"))


@query(f"WITH {P} SELECT id, osm_type, name, array_to_string(categories, '|') AS categories, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN geom_type <> 'point' THEN geom END AS full_geometry FROM p WHERE id = (SELECT min(id) FROM p WHERE geom_type = 'area')")
def place_lookup(spark, sf_dir):
    df = found(spark, sf_dir)
    first = df.where("geom_type = 'area'").agg(F.min("id")).first()[0]
    return df.where(F.col("id") == first).select("id", "osm_type", "name", F.array_join("categories", "|").alias("categories"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.when(F.col("geom_type") != "point", F.col("geom")).alias("full_geometry"))


@query(f"""WITH {P}, n AS (SELECT id, name, round({HAV}, 6) AS d, CASE WHEN tags['addr:street'] IS NOT NULL AND tags['addr:housenumber'] IS NOT NULL THEN tags['addr:housenumber'] || ' ' || tags['addr:street'] END AS own
 FROM p WHERE name IS NOT NULL AND {HAV} <= 400 ORDER BY round({HAV}, 6), id LIMIT 5)
SELECT id, name, round(d, 1) AS distance_m, coalesce(own, (SELECT own FROM n WHERE own IS NOT NULL ORDER BY d, id LIMIT 1)) AS address_line FROM n""")
def reverse_geocode(spark, sf_dir):
    out = s.reverse_geocode(found(spark, sf_dir), LAT, LON, radius=400.0)
    return out.select("id", "name", F.round("distance_m", 1).alias("distance_m"), "address_line")


@query(f"""WITH {P}, a AS (SELECT tags['addr:housenumber'] AS n, tags['addr:street'] AS st, lat AS la, lon AS lo FROM p WHERE tags['addr:street'] IS NOT NULL AND tags['addr:housenumber'] IS NOT NULL AND lat IS NOT NULL ORDER BY id LIMIT 1)
SELECT id, name FROM p, a WHERE tags['addr:housenumber'] = n AND lower(tags['addr:street']) = lower(st) AND 2*6371000.0*asin(least(1.0, sqrt(pow(sin(radians(la-lat)/2),2)+cos(radians(lat))*cos(radians(la))*pow(sin(radians(lo-lon)/2),2)))) <= 40
ORDER BY geom_type = 'area' DESC, id LIMIT 1""")
def address_match(spark, sf_dir):
    df = found(spark, sf_dir)
    t = F.col("tags")
    one = df.where(t["addr:street"].isNotNull() & t["addr:housenumber"].isNotNull() & F.col("lat").isNotNull()).orderBy("id").select(t["addr:housenumber"].alias("n"), t["addr:street"].alias("s"), "lat", "lon").first()
    return s.at_address(df, one.n, one.s, one.lat, one.lon).select("id", "name")


@query("""SELECT id, label FROM boundary_catalog WHERE label ILIKE '%ra%' OR id ILIKE '%ra%' OR list_contains(iso3166_1, 'RA') OR list_contains(iso3166_2, 'RA')
ORDER BY lower(label) = 'ra' DESC, (list_contains(iso3166_1, 'RA') OR list_contains(iso3166_2, 'RA')) DESC, label ILIKE 'ra%' DESC, length(id), label, id LIMIT 25""")
def boundary_search(spark, sf_dir):
    q = "ra"
    iso = F.array_contains("iso3166_1", q.upper()) | F.array_contains("iso3166_2", q.upper())
    rows = table(spark, sf_dir, "boundary_catalog").where(F.col("label").ilike(f"%{q}%") | F.col("id").ilike(f"%{q}%") | iso)
    order = [F.desc(F.lower("label") == q), F.desc(F.coalesce(iso, F.lit(False))), F.desc(F.col("label").ilike(f"{q}%")), F.length("id"), F.col("label"), F.col("id")]
    return rows.orderBy(*order).limit(25).select("id", "label")


@query("SELECT count(*) AS regions, min(bbox[1]) AS west, min(bbox[2]) AS south, max(bbox[3]) AS east, max(bbox[4]) AS north FROM boundary_catalog WHERE geom IS NOT NULL AND len(bbox) = 4")
def bbox_union(spark, sf_dir):
    rows = table(spark, sf_dir, "boundary_catalog").where("geom is not null and size(bbox) = 4")
    side = lambda f, k, name: f(F.get("bbox", F.lit(k))).alias(name)
    return rows.agg(F.count("*").alias("regions"), side(F.min, 0, "west"), side(F.min, 1, "south"), side(F.max, 2, "east"), side(F.max, 3, "north"))


@query(f"WITH {P} SELECT id, name FROM p WHERE name IS NOT NULL ORDER BY name, id LIMIT 40 OFFSET 80")
def paginate(spark, sf_dir):
    return places(spark, sf_dir).where("name is not null").select("id", "name").orderBy("name", "id").offset(80).limit(40)


@query(f"WITH {P} SELECT id FROM p WHERE name IS NOT NULL AND id NOT IN (SELECT id FROM p WHERE list_contains(categories, 'highway/bus_stop'))")
def anti_list(spark, sf_dir):
    df = places(spark, sf_dir).where("name is not null").select("id", "categories")
    return df.join(df.where(F.array_contains("categories", "highway/bus_stop")).select("id"), "id", "left_anti").select("id")


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, max((props->>'$.k')::BIGINT) AS most FROM events GROUP BY event_type")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


@query(f"WITH {P} SELECT split_part(categories[1], '/', 1) AS kind, count(*) AS n FROM p WHERE len(list_filter(categories, lambda c: c = 'amenity' OR starts_with(c, 'amenity/') OR starts_with(c, 'shop/'))) > 0 GROUP BY 1")
def category_prefix(spark, sf_dir):
    df = places(spark, sf_dir).where(s.has_category("amenity") | s.has_category("shop"))
    return df.groupBy(F.split(F.get("categories", F.lit(0)), "/")[0].alias("kind")).agg(F.count("*").alias("n"))
