"""Registered queries of the training-data operators and the DuckDB statements SQL can offer for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.geo import point_of
from geoloom.llm.canon import canon_entries, map_places
from geoloom.llm.chunking import LIMIT, piece_table, split_documents, split_files, write_files
from geoloom.llm.entity import match_entities
from geoloom.llm.leaks import LEAST_RUN, find_leaks
from geoloom.llm.mixing import Mix, mix_sources
from geoloom.llm.neighbours import nearest_of_queries, similar_vectors
from geoloom.operators.hierarchy import clean_key
from geoloom.util import table

WANT_ENTROPY = 1.7  # nats
CANON_KEYS = ("addr:city", "brand", "operator")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = map_places(table(spark, sf_dir, "geo_places"), table(spark, sf_dir, "canon_values"), CANON_KEYS)
    return mapped.select("id", "tag_key", "value_id")


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report by value: where each goes, how sure, and how many places have it."""
    mapped = map_places(table(spark, sf_dir, "geo_places"), table(spark, sf_dir, "canon_values"), CANON_KEYS)
    return mapped.groupBy("tag_key", "value", "value_id", "how").agg(F.count("*").alias("places"), F.round(F.max("similarity"), 4).alias("similarity"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors(table(spark, sf_dir, "geo_places"), "id", "embedding", k=5, least=0.95)
    return near.select(F.least("key_a", "key_b").alias("id_a"), F.greatest("key_a", "key_b").alias("id_b")).distinct()


def p2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar places of each place whose osm_id is divisible by 20, against all places."""
    places = table(spark, sf_dir, "geo_places")
    near = nearest_of_queries(places, places.where("osm_id % 20 = 0"), "id", "embedding", k=5)
    return near.select(F.col("key_a").alias("id"), F.col("key_b").alias("other"), "cosine", "rank")


def stop_like(tags: Column) -> Column:
    """Whether a place is a stop or station by its tags; what stands next to one is not."""
    has = lambda key, *values: F.coalesce(tags[key].isin(*values), F.lit(False))
    return (
        has("railway", "station", "halt", "platform", "stop", "tram_stop") | has("public_transport", "station", "platform", "stop_position", "stop_area")
        | has("highway", "bus_stop") | has("amenity", "bus_station", "ferry_terminal")
    )


def entity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "geo_places").where(stop_like(F.col("tags")))
    at = point_of("centroid")
    places = places.select(F.col("id").alias("key"), "name", at["lat"].alias("lat"), at["lon"].alias("lon"))
    stops = table(spark, sf_dir, "gtfs_stops").where(clean_key("parent_station").isNull() & F.col("feed_id").isNotNull() & F.col("stop_id").isNotNull())
    stops = stops.groupBy("feed_id", "stop_id").agg(F.min(F.trim("stop_name")).alias("name"), F.min("stop_lat").alias("lat"), F.min("stop_lon").alias("lon"))
    towns = canon_entries(table(spark, sf_dir, "canon_values").where("tag_key = 'addr:city'"))  # its size is checked there
    names = [x for _, name, aliases in towns.get("addr:city", []) for x in (name, *aliases)]
    return match_entities(places, stops.select(F.struct("feed_id", "stop_id").alias("key"), F.col("feed_id").alias("scope"), "name", "lat", "lon"), localities=names)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_matches(spark, sf_dir).select(F.col("a").alias("id"), F.col("b.feed_id").alias("feed_id"), F.col("b.stop_id").alias("stop_id"))


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = entity_matches(spark, sf_dir)
    return out.select(F.col("a").alias("id"), F.col("b.feed_id").alias("feed_id"), F.col("b.stop_id").alias("stop_id"), F.round("confidence", 4).alias("confidence"), F.round("score", 4).alias("score"), F.round("dist", 1).alias("dist_m"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.where(F.col("run") >= LEAST_RUN).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole, partial and reworded leaks with their evidence."""
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    told = (F.col("run") >= LEAST_RUN) | (F.col("subsequence") >= 0.6 * F.col("item_words"))
    return leaks.where(told).select("doc_id", "item_id", "run", "subsequence", "item_words", "answer", F.round("cosine", 3).alias("cosine"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix in its order, at the largest size at which each source has its target share within its limit."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).order


def _report(mix: Mix) -> DataFrame:
    return mix.shares.select(
        "source", "target_share", "max_repeats", F.round("weight", 6).alias("weight"), "documents", "tokens", "most_copies", F.round("actual_share", 6).alias("actual_share"),
        F.lit(round(mix.exponent, 6)).alias("exponent"),
    )


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mix between the sources' sizes and their targets: the exponent is bisected to a wanted entropy."""
    return _report(mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), want_entropy=WANT_ENTROPY))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    ends = piece_table(docs).where("last")
    return ends.select(F.col("key").alias("doc_id"), (F.col("longest_run") > LIMIT).cast("int").alias("hard_cut"))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pieces from files, read in ranges that are far smaller than the longest texts."""
    files = write_files(table(spark, sf_dir, "documents"), "doc_id", "text")
    return split_files(files, range_bytes=16 << 10).join(files, "path").drop("path", "text_tokens", "longest_run")


QUERIES = {f.__name__: f for f in (p1_found, p1_values, p2_found, p2_topk, p5_found, p5_matches, p8_found, p8_leaks, p9_mix, p9_shares, p9_tempered, p10_found, p10_pieces, p10_files)}
ORACLES: dict = {
    "p2_topk": """WITH v AS (SELECT id, any_value(osm_id) AS osm_id, any_value(embedding)::DOUBLE[] AS e FROM geo_places WHERE len(embedding) > 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 GROUP BY id),
s AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.e, b.e), 9) AS c FROM v a JOIN v b ON a.osm_id % 20 = 0 AND a.id <> b.id)
SELECT id, other, c AS cosine, row_number() OVER (PARTITION BY id ORDER BY c DESC, other)::INTEGER AS rank FROM s QUALIFY rank <= 5""",
    "p2_found": """WITH v AS (SELECT id, any_value(embedding)::DOUBLE[] AS e FROM geo_places WHERE len(embedding) > 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 GROUP BY id),
s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 9) AS c FROM v a JOIN v b ON a.id <> b.id),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM k WHERE c >= 0.95""",
}
