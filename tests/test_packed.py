import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.operators.packed import _batch_items, packed_tags, read_packed, split_packed

CASES = {
    "": [], " ; ;": [], "a": ["a"], "a; b ,c": ["a", "b", "c"], '"a; b";c': ["a; b", "c"], '"say ""x""";y': ['say "x"', "y"], "a\\;b;c": ["a;b", "c"],
    "“p, q”、r": ["p, q", "r"], 'a;"b;c': ["a", "b", "c"], "fish & chips\ntea": ["fish & chips", "tea"], '“a "b" c”;d': ['a "b" c', "d"], "x" * 70000 + ";y": ["x" * 70000, "y"],
}


@pytest.mark.parametrize("text,want", CASES.items(), ids=range(len(CASES)))
def test_rules(text, want):
    assert read_packed(text) == want
    assert _batch_items(pa.array([text])).to_pylist() == [want]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet='ab ;,"“”\\\'é、\n', max_size=12)), max_size=8))
def test_buffers_follow_the_rules(texts):
    assert _batch_items(pa.array(texts, pa.string())).to_pylist() == [read_packed(t or "") for t in texts]


def test_split(spark):
    rows = [(1, "a;b", "k"), (1, "a;b", "k"), (2, None, None), (3, "", "z"), (4, "one", "z")]
    df = spark.createDataFrame(rows, "id int, v string, extra string")
    got = sorted(map(tuple, split_packed(df, "v").collect()), key=str)
    assert got == [(1, "k", 1, "a"), (1, "k", 1, "a"), (1, "k", 2, "b"), (1, "k", 2, "b"), (4, "z", 1, "one")]
    assert split_packed(df, "v", least=2).count() == 4
    assert split_packed(df.limit(0), "v").count() == 0
    with pytest.raises(ValueError):
        split_packed(df.withColumnRenamed("extra", "item"), "v")


def test_tags(spark):
    df = spark.createDataFrame([("p", {"ref": "1;2", "name": "x;y"}), ("p", {"ref": "1;2", "name": "x;y"}), ("q", None)], "id string, tags map<string,string>")
    assert sorted(map(tuple, packed_tags(df, ("ref",)).collect())) == [("p", "ref", 1, "1"), ("p", "ref", 2, "2")]
