import pytest

from geoloom.llm import canon as C

ENTRIES = [(1, "Lake Doren", ["Pelistad"]), (2, "Doren", []), (3, "Upper Velsk", []), (4, "Korvik Rail Corporation", ["KRC"]), (5, "Bandel Rail Corporation", []), (6, "Muster & Sons", []), (7, "Tilo Rail Corporation", [])]
CASES = {
    "DOREN": 2, " döreñ ": 2, "City of Doren": 2, "Doren 55120": 2, "D0ren": 2, "Lk Doren": 1, "Doren, Lake": 1, "Lakee Doren": 1, "PELISTAD": 1, "Upr. Velsk": 3, "Uppe Velsk": 3,
    "K.R.C.": 4, "Korvik Rail Corp.": 4, "KorvikRailCorporation": 4, "Korvk Rial Corporation": 4, "Zambor Rail Corporation": -1, "unknown": -1, "": -1, "???": -1, "Muster and Sons": 6, "Mustre + Sons": 6, "x" * 5000: -1,
    "The Korvik Rail Corporation (public)": 4,
}


@pytest.mark.parametrize("value,want", CASES.items(), ids=range(len(CASES)))
def test_cases(value, want):
    assert C.match_values([value], C.Canon(ENTRIES))[0][0] == want


def brute(a, b):
    d = {}
    for i in range(-1, len(a) + 1):
        d[i, -1] = i + 1
    for j in range(-1, len(b) + 1):
        d[-1, j] = j + 1
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_edit_distance_matches_brute_force():
    import random

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 9)))
    a, b = [word() for _ in range(600)], [word() for _ in range(600)]
    assert C.edit_distance(a, b).tolist() == [brute(x, y) for x, y in zip(a, b)]


def test_frames(spark):
    places = spark.createDataFrame([("p", {"brand": "K.R.C."}), ("p", {"brand": "K.R.C."}), ("q", {"brand": "Korvik Rail Corporation"}), ("r", {"brand": None, "x": "y"}), ("s", {"brand": ""}), ("t", None)], "id string, tags map<string,string>")
    canon = spark.createDataFrame([(i, "brand", n, a) for i, n, a in ENTRIES] + [(9, None, None, None)], "value_id int, tag_key string, canonical string, aliases array<string>")
    got = sorted((r.id, r.value_id) for r in C.map_places(places, canon, ("brand", "operator")).collect())
    assert got == [("p", 4), ("s", -1)]
    assert C.map_places(places, canon.limit(0), ("brand",)).where("value_id >= 0").count() == 0
    assert C.map_places(places.limit(0), canon, ("brand",)).count() == 0


def test_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_ENTRIES", 2)
    canon = spark.createDataFrame([(i, "brand", n, a) for i, n, a in ENTRIES], "value_id int, tag_key string, canonical string, aliases array<string>")
    with pytest.raises(ValueError):
        C.canon_entries(canon)
