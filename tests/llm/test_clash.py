"""Extra columns whose names the operators use inside do no harm."""

from pyspark.sql import functions as F

from geoloom.llm.canon import map_places
from geoloom.llm.chunking import split_documents
from geoloom.llm.entity import match_entities
from geoloom.llm.leaks import find_leaks
from geoloom.llm.mixing import mix_sources
from geoloom.llm.neighbours import nearest_of_queries, similar_vectors

NAMES = ("key", "value", "rid", "cell", "term", "a", "b", "k", "next", "copy", "salt", "code", "rank", "words", "word", "n", "block", "group", "passes", "n_tokens", "piece", "more", "size", "vec", "n_claims", "similarity")


def crowded(df):
    return df.withColumns({c: F.lit("taken") for c in NAMES if c not in df.columns})


def test_llm_operators(spark):
    docs = crowded(spark.createDataFrame([(1, "s", "lorem ipsum dolor " * 2000), (2, None, None), (3, "s", "")], "doc_id bigint, source string, text string"))
    assert split_documents(docs, "doc_id", "text").where("doc_id = 1").count() > 1
    targets = crowded(spark.createDataFrame([("s", 1.0, 2)], "source string, target_share double, max_repeats int"))
    assert [r.copies for r in mix_sources(docs, targets).documents.collect()] == [2]
    items = crowded(spark.createDataFrame([(7, "lorem ipsum dolor " * 8, None)], "item_id bigint, item_text string, answer string"))
    assert [r.item_id for r in find_leaks(docs, items).collect()] == [7]
    places = crowded(spark.createDataFrame([("p", {"brand": "Fo0"})], "id string, tags map<string,string>"))
    canon = crowded(spark.createDataFrame([(4, "brand", "Foo", [])], "value_id int, tag_key string, canonical string, aliases array<string>"))
    assert map_places(places, canon, ("brand",)).first().value_id == 4
    vectors = crowded(spark.createDataFrame([("a1", [1.0, 0.0, 0.1]), ("b1", [1.0, 0.0, 0.1])], "id string, v array<float>"))
    assert similar_vectors(vectors, "id", "v").count() == 2 and nearest_of_queries(vectors, vectors, "id", "v").count() == 2
    one = spark.createDataFrame([("x", "f", "Tarn Hall", 5.0, 5.0)], "key string, scope string, name string, lat double, lon double").withColumns({c: F.lit("taken") for c in NAMES if c != "key"})
    assert match_entities(one, one).count() == 1
