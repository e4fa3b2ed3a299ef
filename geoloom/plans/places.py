"""Queries over places: tag derivations, enrichment, brands and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import tags as tag
from geoloom.functions import text as txt
from geoloom.functions.geo import point_geojson, point_of
from geoloom.operators.enrich import CONTEXT_CATEGORIES, ROAD_CATEGORIES, brand_catalogue, geometry_area_m2, newest, parent_context, rings, road_crossings
from geoloom.operators.pipeline import number_rows, store_places
from geoloom.operators.search import searchable
from geoloom.util import scratch, shared_dir, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(table(spark, sf_dir, "geo_places"))


_STORED: dict[tuple, str] = {}


def stored_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search table: newest versions with coordinates and search words, in the order of a Z-curve. It is written
    once per session and state of the input, into the shared folder; what is asked of a box reads its row groups only."""
    rows = table(spark, sf_dir, "geo_places")
    state = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/geo_places.parquet")
    written = state.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(state).getModificationTime()
    key = (spark.sparkContext.applicationId, sf_dir, written, shared_dir(spark))
    if key not in _STORED:
        path = scratch(spark, "places")
        store_places(searchable(newest(rows)), path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


# The same rows in SQL, with coordinates.
P = r"""p AS (
  SELECT * EXCLUDE (updated_at), TRY_CAST(regexp_extract(centroid, 'POINT *\( *([-0-9.]+) +([-0-9.]+)', 1) AS DOUBLE) AS lon,
         TRY_CAST(regexp_extract(centroid, 'POINT *\( *([-0-9.]+) +([-0-9.]+)', 2) AS DOUBLE) AS lat
  FROM (SELECT * FROM geo_places QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1))"""


def _category_sql() -> str:
    parts = []
    for key in tag.CATEGORY_KEYS:
        bare = f" WHEN tags['{key}'] = 'yes' AND tags['name'] IS NOT NULL THEN '{key}'" if key in tag.BARE_KEYS else ""
        parts.append(f"CASE WHEN tags['{key}'] NOT IN ('yes', 'no') THEN '{key}/' || tags['{key}']{bare} END")
    dishes = r"list_transform(list_filter(string_split(tags['cuisine'], ';'), lambda x: x <> ''), lambda x: 'cuisine/' || regexp_replace(x, '^\s+|\s+$', '', 'g'))"
    return f"list_concat(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), coalesce({dishes}, []))"


@query(f"WITH {P} SELECT id, array_to_string({_category_sql()}, '|') AS categories FROM p")
def osm_categories(spark, sf_dir):
    return places(spark, sf_dir).select("id", F.array_join(tag.categories("tags"), "|").alias("categories"))


@query(f"""WITH {P}, n AS (SELECT id, list_filter(list_concat([{', '.join(f"tags['{k}']" for k in tag.NAME_KEYS)}],
  list_transform(list_sort(list_filter(map_entries(tags), lambda e: starts_with(e.key, 'name:'))), lambda e: e.value)), lambda x: x IS NOT NULL) AS l FROM p)
SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS names FROM n""")
def osm_names(spark, sf_dir):
    return places(spark, sf_dir).select("id", F.array_join(tag.names("tags"), "|").alias("names"))


@query(f"""WITH {P} SELECT id, CASE osm_type WHEN 'N' THEN 'node' WHEN 'W' THEN 'way' WHEN 'R' THEN 'relation' ELSE 'intersection' END || '/' || osm_id AS made_id,
  CASE WHEN tags['boundary'] = 'administrative' THEN TRY_CAST(tags['admin_level'] AS INTEGER) END AS level FROM p""")
def osm_ids(spark, sf_dir):
    return places(spark, sf_dir).select("id", tag.object_id("osm_type", "osm_id").alias("made_id"), tag.admin_level("tags").alias("level"))


@query(f"""WITH {P} SELECT id, CASE WHEN tags['addr:street'] IS NOT NULL OR tags['addr:housenumber'] IS NOT NULL THEN
  concat_ws('|', {', '.join(f"coalesce(tags['addr:{k}'], '')" for k in tag.ADDRESS_PARTS)}) END AS address,
  nullif(concat_ws('|', tags['phone'], tags['contact:phone'], tags['contact:mobile']), '') AS phones,
  nullif(concat_ws('|', tags['website'], tags['contact:website'], tags['url']), '') AS websites, tags['opening_hours'] AS hours FROM p""")
def address_contacts(spark, sf_dir):
    a = tag.address("tags")
    joined = F.when(a.isNotNull(), F.concat_ws("|", *[F.coalesce(a[k], F.lit("")) for k in tag.ADDRESS_PARTS]))
    return places(spark, sf_dir).select(
        "id", joined.alias("address"), F.array_join(tag.phones("tags"), "|").alias("phones"), F.array_join(tag.websites("tags"), "|").alias("websites"), F.col("tags")["opening_hours"].alias("hours")
    )


@query(f"""WITH {P} SELECT id, infra, state FROM (SELECT id, tags['highway'] AS h, tags['bicycle'] AS b,
  CASE WHEN tags['highway'] IN ('proposed', 'construction') THEN NULL WHEN tags['highway'] = 'cycleway' THEN 'cycleway'
   WHEN tags['bicycle'] = 'designated' AND tags['highway'] IN ('path', 'footway', 'bridleway') THEN 'path_bicycle'
   WHEN tags['highway'] = 'steps' AND (tags['ramp:bicycle'] = 'yes' OR tags['bicycle'] IN ('yes', 'designated')) THEN 'steps_bicycle'
   WHEN tags['bicycle'] = 'designated' AND tags['highway'] IS NOT NULL THEN 'bicycle_designated'
   WHEN tags['bicycle'] = 'yes' AND tags['highway'] IS NOT NULL THEN 'bicycle_yes' END AS infra, CAST(NULL AS VARCHAR) AS state FROM p)""")
def bicycle_class(spark, sf_dir):
    """Cycleway tags do not occur in these tables; the fixture tests cover the whole ladder."""
    c = tag.bicycle_class("tags")
    return places(spark, sf_dir).select("id", c["infra"].alias("infra"), c["state"].alias("state"))


_RINGS = r"""r AS (SELECT id, unnest(regexp_extract_all(geom, '\(([^()]+)\)', 1)) AS ring, generate_subscripts(regexp_extract_all(geom, '\(([^()]+)\)', 1), 1) AS k, geom FROM p WHERE geom LIKE '%POLYGON%'),
o AS (SELECT id, unnest(regexp_extract_all(geom, '\( *\(([^()]+)\)', 1)) AS ring FROM p WHERE geom LIKE '%POLYGON%'),
v AS (SELECT id, k, ring, unnest(regexp_extract_all(ring, '([-0-9.]+) +([-0-9.]+)', 1))::DOUBLE AS x, unnest(regexp_extract_all(ring, '([-0-9.]+) +([-0-9.]+)', 2))::DOUBLE AS y,
  generate_subscripts(regexp_extract_all(ring, '([-0-9.]+) +([-0-9.]+)', 1), 1) AS i FROM r),
a AS (SELECT v.id, v.k, v.ring, abs(sum(radians(w.x - v.x) * (2 + sin(radians(v.y)) + sin(radians(w.y))))) * 6371000.0 * 6371000.0 / 2 AS area
  FROM v JOIN v w ON w.id = v.id AND w.k = v.k AND w.i = v.i + 1 GROUP BY ALL)"""


@query(f"""WITH {P}, {_RINGS}
SELECT id, round(sum(CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.id = a.id AND o.ring = a.ring) THEN area ELSE -area END), 1) AS area_m2 FROM a GROUP BY id""")
def area_m2(spark, sf_dir):
    out = places(spark, sf_dir).where(F.col("geom").rlike("(?i)POLYGON")).select("id", F.round(geometry_area_m2("geom"), 1).alias("area_m2"))
    return out.where("area_m2 is not null")


_FID = "osm_id * 4 + CASE osm_type WHEN 'N' THEN 0 WHEN 'W' THEN 1 ELSE 2 END"


@query(f"""WITH {P}
SELECT 'building' AS layer, {_FID} AS fid, id, name, coalesce(tags['railway'], '') AS railway, coalesce(tags['public_transport'], '') AS public_transport, coalesce(tags['operator'], '') AS operator
FROM p WHERE geom_type = 'area' AND (tags['building'] = 'train_station' OR tags['public_transport'] = 'station' OR tags['railway'] = 'station')
UNION ALL
SELECT 'platform', {_FID}, id, name, coalesce(tags['railway'], ''), coalesce(tags['public_transport'], ''), coalesce(tags['operator'], '')
FROM p WHERE geom_type IN ('area', 'line') AND (tags['public_transport'] = 'platform' OR tags['railway'] = 'platform')
UNION ALL
SELECT 'entrance', {_FID}, id, name, coalesce(tags['railway'], ''), coalesce(tags['public_transport'], ''), coalesce(tags['operator'], '')
FROM p WHERE tags['railway'] IN ('subway_entrance', 'train_station_entrance')""")
def transit_layers(spark, sf_dir):
    t = F.col("tags")
    fid = F.col("osm_id") * 4 + F.when(F.col("osm_type") == "N", 0).when(F.col("osm_type") == "W", 1).otherwise(2)
    area = F.col("geom_type") == "area"
    kinds = F.array_compact(F.array(
        F.when(area & ((t["building"] == "train_station") | (t["public_transport"] == "station") | (t["railway"] == "station")), "building"),
        F.when(F.col("geom_type").isin("area", "line") & ((t["public_transport"] == "platform") | (t["railway"] == "platform")), "platform"),
        F.when(t["railway"].isin("subway_entrance", "train_station_entrance"), "entrance"),
    ))
    shown = [F.coalesce(t[k], F.lit("")).alias(k) for k in ("railway", "public_transport", "operator")]
    return places(spark, sf_dir).select(F.explode(kinds).alias("layer"), fid.alias("fid"), "id", "name", *shown)


@query(f"""WITH {P} SELECT id, '{{"type":"Point","coordinates":[' || lon || ',' || lat || ']}}' AS geometry FROM p WHERE lon IS NOT NULL""")
def geojson_points(spark, sf_dir):
    at = point_of("centroid")
    return places(spark, sf_dir).where(at.isNotNull()).select("id", point_geojson(at["lon"], at["lat"]).alias("geometry"))


@query(f"""WITH {P} SELECT id, concat_ws(' · ', nullif(name, ''), nullif(array_to_string(categories, ', '), ''), nullif(tags['description'], ''), nullif(tags['cuisine'], ''), nullif(tags['operator'], ''),
  nullif(coalesce(nullif(parent_context, ''), concat_ws(' ', nullif(address->>'$.city', ''), nullif(address->>'$.country', ''))), '')) AS input FROM p""")
def embedding_input(spark, sf_dir):
    t = F.col("tags")
    blank = lambda c: F.nullif(c, F.lit(""))
    local = F.concat_ws(" ", *[blank(F.get_json_object("address", f"$.{k}")) for k in ("city", "country")])
    parts = [blank(F.col("name")), blank(F.array_join("categories", ", ")), blank(t["description"]), blank(t["cuisine"]), blank(t["operator"]), blank(F.coalesce(blank(F.col("parent_context")), local))]
    return places(spark, sf_dir).select("id", F.concat_ws(" · ", *parts).alias("input"))


@query(r"""SELECT id, CASE WHEN name LIKE '%/%' THEN array_to_string(list_transform(string_split(replace(string_split(name, '/')[-1], '-', ' '), ' '),
  lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE name END AS label FROM boundary_catalog""")
def region_labels(spark, sf_dir):
    return table(spark, sf_dir, "boundary_catalog").select("id", txt.pretty_label("name").alias("label"))


_CODE_PARTS = "list_concat(" + ", ".join(f"string_split(coalesce(tags['{k}'], ''), ';')" for k in txt.CODE_TAGS) + ")"


@query(f"""WITH {P}, c AS (SELECT id, list_sort(list_distinct(list_filter(list_transform({_CODE_PARTS}, lambda x: lower(trim(x, ' '))), lambda x: x <> ''))) AS codes FROM p)
SELECT id, array_to_string(codes, '|') AS codes FROM c WHERE len(codes) > 0""")
def codes_gen(spark, sf_dir):
    return places(spark, sf_dir).select("id", F.array_join(txt.codes("tags"), "|").alias("codes")).where("codes is not null")


_STOP = ", ".join(f"'{w}'" for w in txt.STOP_WORDS)


@query(rf"""WITH {P}, w AS (SELECT id, list_filter(regexp_split_to_array(name, '\s+'), lambda x: x <> '' AND lower(x) NOT IN ({_STOP})) AS l
  FROM p WHERE regexp_full_match(name, '[\p{{L}}\p{{M}}\p{{N}}_\s\-''.&]+'))
SELECT id, lower(array_to_string(list_transform(l, lambda x: x[1]), '')) AS abbrev FROM w WHERE len(l) >= 2""")
def abbrev_gen(spark, sf_dir):
    return places(spark, sf_dir).select("id", txt.abbreviation("name").alias("abbrev")).where("abbrev is not null")


@query(rf"""WITH {P}, t AS (SELECT id, list_filter(regexp_split_to_array(lower(strip_accents(replace(concat_ws(' ', replace(coalesce(name, ''), ' & ', ' and et und y e '), coalesce(name_abbrev, ''),
  translate(array_to_string(categories, ' '), '/_', '  '), coalesce(parent_context, '')), chr(39), ''))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS l FROM p)
SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS ts FROM t""")
def search_words(spark, sf_dir):
    ts = txt.search_tokens("name", "names", "name_abbrev", "categories", "parent_context", F.col("osm_type") == "X")
    return places(spark, sf_dir).select("id", F.array_join(ts, " ").alias("ts"))


_BRANDS = rf"""b AS (
  SELECT coalesce(nullif(tags['brand:wikidata'], ''), 'name:' || lower(regexp_replace(trim(tags['brand'], ' '), '\s+', ' ', 'g'))) AS brand_key,
         nullif(tags['brand:wikidata'], '') AS wikidata, tags['brand'] AS brand, categories[1] AS category, lat, lon
  FROM p WHERE name IS NOT NULL AND tags['brand'] IS NOT NULL),
m AS (SELECT brand_key, brand FROM (SELECT brand_key, brand, count(*) AS n FROM b WHERE brand IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY brand_key ORDER BY n DESC, brand) = 1),
k AS (SELECT brand_key, category FROM (SELECT brand_key, category, count(*) AS n FROM b WHERE category IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY brand_key ORDER BY n DESC, category) = 1),
brands AS (
  SELECT b.brand_key, any_value(m.brand) AS name, max(b.wikidata) AS wikidata, count(*)::INTEGER AS location_count, any_value(k.category) AS category,
         round(avg(b.lat), 5) AS rep_lat, round(avg(b.lon), 5) AS rep_lon
  FROM b LEFT JOIN m USING (brand_key) LEFT JOIN k USING (brand_key) GROUP BY b.brand_key HAVING count(*) >= 2)"""


def _brands(spark, sf_dir):
    out = brand_catalogue(places(spark, sf_dir))
    return out.withColumn("rep_lat", F.round("rep_lat", 5)).withColumn("rep_lon", F.round("rep_lon", 5))


@query(f"WITH {P}, {_BRANDS} SELECT * FROM brands")
def brand_catalog(spark, sf_dir):
    return _brands(spark, sf_dir)


def _trigram_sql(x: str) -> str:
    """Distinct trigrams of a text, in SQL."""
    words = rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def similarity_sql(a: str, b: str) -> str:
    x, y = _trigram_sql(a), _trigram_sql(b)
    return f"coalesce(len(list_intersect({x}, {y})) / nullif(len(list_distinct(list_concat({x}, {y}))), 0)::DOUBLE, 0.0)"


BRAND_QUERY = "sky market"


@query(f"""WITH {P}, {_BRANDS}, l AS (SELECT value_id, canonical FROM canon_values WHERE tag_key = 'brand'),
s AS (SELECT brands.*, l.value_id AS logo_id, name ILIKE '{BRAND_QUERY}%' AS starts, {similarity_sql('name', f"'{BRAND_QUERY}'")} AS sim FROM brands LEFT JOIN l ON l.canonical = brands.name)
SELECT brand_key, name, location_count, logo_id, round(sim, 4) AS sim FROM s WHERE starts OR sim >= 0.3 ORDER BY starts DESC, s.sim DESC, location_count DESC, brand_key LIMIT 8""")
def brand_search(spark, sf_dir):
    """Brands by prefix or likeness, with their entry of the reference list; the best eight."""
    logos = table(spark, sf_dir, "canon_values").where("tag_key = 'brand'").select(F.col("canonical").alias("name"), F.col("value_id").alias("logo_id"))
    sim = txt.similarity("name", F.lit(BRAND_QUERY))
    found = _brands(spark, sf_dir).withColumn("sim", sim).withColumn("starts", F.col("name").ilike(f"{BRAND_QUERY}%")).where("starts or sim >= 0.3")
    out = found.join(logos, "name", "left").orderBy(F.desc("starts"), F.desc("sim"), F.desc("location_count"), "brand_key").limit(8)
    return out.select("brand_key", "name", "location_count", "logo_id", F.round("sim", 4).alias("sim"))


@query(f"WITH {P}, {_BRANDS} SELECT brand_key, name FROM brands WHERE NOT EXISTS (SELECT 1 FROM canon_values c WHERE c.tag_key = 'brand' AND c.canonical = brands.name)")
def brand_logo_missing(spark, sf_dir):
    known = table(spark, sf_dir, "canon_values").where("tag_key = 'brand'").select(F.col("canonical").alias("name"))
    return _brands(spark, sf_dir).join(known, "name", "left_anti").select("brand_key", "name")


_CONTEXT = ", ".join(f"'{c}'" for c in CONTEXT_CATEGORIES)
_EDGES = r"""ar AS (SELECT id, name, area_m2, geom FROM p WHERE geom_type = 'area' AND name IS NOT NULL AND (admin_level IS NOT NULL OR list_has_any(categories, [%s]))),
rr AS (SELECT id, unnest(regexp_extract_all(geom, '\(([^()]+)\)', 1)) AS ring, generate_subscripts(regexp_extract_all(geom, '\(([^()]+)\)', 1), 1) AS k FROM ar),
vv AS (SELECT id, k, unnest(regexp_extract_all(ring, '([-0-9.]+) +([-0-9.]+)', 1))::DOUBLE AS x, unnest(regexp_extract_all(ring, '([-0-9.]+) +([-0-9.]+)', 2))::DOUBLE AS y,
  generate_subscripts(regexp_extract_all(ring, '([-0-9.]+) +([-0-9.]+)', 1), 1) AS i FROM rr),
ee AS (SELECT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM vv a JOIN vv b ON a.id = b.id AND a.k = b.k AND b.i = a.i + 1)""" % _CONTEXT


@query(f"""WITH {P}, {_EDGES},
inn AS (SELECT q.id, ee.id AS area_id FROM p q JOIN ee ON q.name IS NOT NULL AND (ee.y1 > q.lat) <> (ee.y2 > q.lat)
  AND q.lon < (ee.x2 - ee.x1) * (q.lat - ee.y1) / (ee.y2 - ee.y1) + ee.x1 GROUP BY ALL HAVING count(*) % 2 = 1),
lab AS (SELECT inn.id, string_agg(ar.name, ' ' ORDER BY ar.area_m2 ASC NULLS LAST, ar.id) AS labels FROM inn JOIN ar ON ar.id = inn.area_id GROUP BY inn.id)
SELECT p.id, nullif(trim(concat_ws(' ', coalesce(address->>'$.street', ''), coalesce(address->>'$.city', ''), coalesce(address->>'$.state', ''), coalesce(address->>'$.postcode', ''), coalesce(labels, '')), ' '), '') AS parent_context
FROM p LEFT JOIN lab USING (id) WHERE name IS NOT NULL""")
def resolve_context(spark, sf_dir):
    return parent_context(places(spark, sf_dir))


@query(r"""WITH k AS (SELECT s_suppkey AS k FROM supplier),
lines AS (SELECT k AS id, CASE WHEN k % 2 = 0 THEN 'East ' ELSE 'North ' END || (k % 40) AS name, part,
  CASE WHEN k % 2 = 0 THEN [[-55.4 + part * 0.02, 25 + k * 0.0007], [-55.39 + part * 0.02, 25.0004 + k * 0.0007], [-55.381 + part * 0.02, 25 + k * 0.0007]]
  ELSE [[-55.4 + k * 0.0011 % 0.04, 25.0 + part * 0.03], [-55.3991 + k * 0.0011 % 0.04, 25.02 + part * 0.03]] END AS l FROM k, (SELECT unnest([0, 1]) AS part)),
v AS (SELECT id, part, name, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM lines),
s AS (SELECT a.name, a.p[1]::DOUBLE AS x1, a.p[2]::DOUBLE AS y1, b.p[1]::DOUBLE AS x2, b.p[2]::DOUBLE AS y2 FROM v a JOIN v b ON a.id = b.id AND a.part = b.part AND b.i = a.i + 1),
m AS (SELECT a.name AS na, b.name AS nb, a.x1, a.y1, a.x2, a.y2,
  ((b.x1-a.x1)*(b.y2-b.y1)-(b.y1-a.y1)*(b.x2-b.x1))/((a.x2-a.x1)*(b.y2-b.y1)-(a.y2-a.y1)*(b.x2-b.x1)) AS t,
  ((b.x1-a.x1)*(a.y2-a.y1)-(b.y1-a.y1)*(a.x2-a.x1))/((a.x2-a.x1)*(b.y2-b.y1)-(a.y2-a.y1)*(b.x2-b.x1)) AS u
  FROM s a JOIN s b ON a.name < b.name AND (a.x2-a.x1)*(b.y2-b.y1)-(a.y2-a.y1)*(b.x2-b.x1) <> 0),
pt AS (SELECT na, nb, round(x1 + t*(x2-x1), 5) AS lon, round(y1 + t*(y2-y1), 5) AS lat FROM m WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
n AS (SELECT lon, lat, na AS road FROM pt UNION SELECT lon, lat, nb FROM pt),
g AS (SELECT lon, lat, string_agg(road, ' & ' ORDER BY road) AS name FROM n GROUP BY lon, lat)
SELECT 'intersection/' || row_number() OVER (ORDER BY lat DESC, lon) AS id, lon, lat, name FROM g""")
def intersections_grid(spark, sf_dir):
    """Crossings of roads of two parts each, laid out from the suppliers' keys (the tables' own lines do not cross),
    numbered from north to south."""
    k = F.col("s_suppkey")

    def wkt(parts: list[list[tuple]]):
        text = [F.lit("MULTILINESTRING(")]
        for n, part in enumerate(parts):
            text.append(F.lit("," if n else ""))
            for i, (x, y) in enumerate(part):
                text += [F.lit(", " if i else "("), x.cast("double").cast("string"), F.lit(" "), y.cast("double").cast("string")]
            text.append(F.lit(")"))
        return F.concat(*text, F.lit(")"))

    num = lambda v: F.lit(v).cast("decimal(18,6)")
    up, off = num(25) + k * F.lit(0.0007).cast("decimal(18,6)"), (k * F.lit(0.0011).cast("decimal(18,6)")) % F.lit(0.04).cast("decimal(18,6)")
    east = wkt([[(num(-55.4 + p * 0.02), up), (num(-55.39 + p * 0.02), up + num(0.0004)), (num(-55.381 + p * 0.02), up)] for p in (0, 1)])
    north = wkt([[(num(-55.4) + off, num(25.0 + p * 0.03)), (num(-55.3991) + off, num(25.02 + p * 0.03))] for p in (0, 1)])
    even = k % 2 == 0
    roads = table(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(F.when(even, "East ").otherwise("North "), (k % 40).cast("string")).alias("name"), F.when(even, east).otherwise(north).alias("geom"))
    points = road_crossings(roads.select("id", "name", F.explode(rings("geom")).alias("line")))
    numbered = number_rows(points.select("lon", "lat", "name"), F.desc("lat"), F.asc("lon"))
    return numbered.select(F.concat(F.lit("intersection/"), "n").alias("id"), "lon", "lat", "name")


@query(f"""WITH {P} SELECT count(*) AS total, count(*) FILTER (WHERE name IS NOT NULL) AS named, count(*) FILTER (WHERE codes IS NOT NULL) AS with_codes, count(*) FILTER (WHERE parent_context IS NOT NULL) AS with_context,
  count(*) FILTER (WHERE len(embedding) > 0) AS with_embedding, count(*) FILTER (WHERE address IS NOT NULL) AS with_address, count(DISTINCT osm_type) AS types FROM p""")
def coverage_counts(spark, sf_dir):
    has = lambda c: F.count_if(F.col(c).isNotNull())
    return places(spark, sf_dir).agg(
        F.count("*").alias("total"), has("name").alias("named"), has("codes").alias("with_codes"), has("parent_context").alias("with_context"),
        F.count_if(F.size("embedding") > 0).alias("with_embedding"), has("address").alias("with_address"), F.countDistinct("osm_type").alias("types"),
    )


@query()
def coverage_sample(spark, sf_dir):
    """Shares from a row sample, scaled to the whole (the sampling is the feature)."""
    rows = table(spark, sf_dir, "geo_places")
    sample = rows.sample(0.05, seed=7).agg(F.count("*").alias("s"), F.count_if(F.col("name").isNotNull()).alias("named"), F.count_if(F.col("parent_context").isNotNull()).alias("with_context"))
    total = rows.agg(F.count("*").alias("total"))
    scaled = lambda c: F.coalesce(F.round(F.col(c) / F.nullif(F.col("s"), F.lit(0)) * F.col("total")).cast("long"), F.lit(0)).alias(c)
    return sample.join(total).select("total", scaled("named"), scaled("with_context"), F.round(F.lit(100.0) * F.col("named") / F.nullif(F.col("s"), F.lit(0)), 2).alias("named_pct"))
