import random

import numpy as np

from geoloom.llm import entity as E

PLACE, STOP = "key string, name string, lat double, lon double", "key string, scope string, name string, lat double, lon double"


def run(spark, places, stops, **options):
    out = E.match_entities(spark.createDataFrame(places, PLACE), spark.createDataFrame(stops, STOP), **options)
    return sorted((r.a, r.b) for r in out.collect())


def test_variants():
    known = frozenset({"velsk"})
    assert ("tarn", "street", "morel", "avenue") in E.variants("Tarn St. @ Morel Av, Velsk (bus) #12", known)
    assert E.variants("Morel Sttaion") == [("morel",)] and E.variants(None) == [] and E.variants("  ") == []
    assert E.variants("Velsk, Tarn Street", known) == [("tarn", "street")]


def test_similarity_rules():
    sim = lambda a, b: float(E.name_similarity([[" ".join(v) for v in E.variants(a)]], [[" ".join(v) for v in E.variants(b)]])[0])
    assert sim("Tarn Road & Morel Street", "MOREL ST / TARN RD") == 1
    assert sim("Tarn Road North", "Tarn Road South") == 0 and sim("Tarn Road", "Tarn Road East") == 0
    assert sim("Prataipoundel Lane", "Prataipoundel Road") == 0 and sim("Prataipoundel Laen", "Pratapoundle Lane") > 0.8
    assert sim("Karpen Terminal", "Kapren Terminal") > 0.8 and sim("Karpen Terminal", "Solvig Terminal") == 0


def test_matches(spark):
    places = [("p1", "TARN RD (bus)", 50.0, 8.0), ("p2", "Morel Museum", 50.01, 8.0), ("p3", "Solvig Harbour", 50.02, 8.02), ("p4", None, 50.0, 8.0), ("p5", "  ", 50.0, 8.0), ("p6", "Unike Terminal", 40.0, 9.0), ("p7", "Far Hall", 10.0, 10.0)]
    stops = [
        ("s1", "f", "Tarn Road", 50.0005, 8.0), ("s2", "g", "Tarn Road", 50.0, 8.0005), ("s3", "f", "Morel Museum", 50.0102, 8.0), ("s4", "f", "Morel Museun", 50.0105, 8.0), ("s5", "f", "Solvig Harbor", 8.02, 50.02),
        ("s6", "f", "Unike Termnial", 0.0, 0.0), ("s9", "f", "Aaa Hall", 40.01, 9.01), ("s10", "f", "Bbb Hall", 40.02, 9.02), ("s11", "f", "Ccc Hall", 40.03, 9.03), ("s12", "g", "Unike Terminal", None, None), ("s7", "f", "Far Hall", 20.0, 20.0), ("s8", "f", None, 50.0, 8.0),
    ]
    assert run(spark, places, stops) == [("p1", "s1"), ("p1", "s2"), ("p2", "s3"), ("p3", "s5"), ("p6", "s6")]


def test_hot_cell_loses_nothing(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("bdfgklmnprstv") + rnd.choice("aeiou") for _ in range(4))
    names = list(dict.fromkeys(f"{word().title()} {rnd.choice(['Road', 'Street', 'Terminal'])}" for _ in range(150)))
    places = [(f"p{i}", n, 50 + rnd.uniform(0, 0.002), 8 + rnd.uniform(0, 0.002)) for i, n in enumerate(names)] + [("copy", *("Same Stop Hall", 50.0, 8.0)), ("copy2", *("Same Stop Hall", 50.0, 8.0))]
    stops = [(f"s{i}", "f", n.upper(), 50 + rnd.uniform(0, 0.002), 8 + rnd.uniform(0, 0.002)) for i, n in enumerate(names)]
    whole = run(spark, places, stops)
    for rows in (7, 40):
        monkeypatch.setattr(E, "PART_ROWS", rows)
        monkeypatch.setattr(E, "BLOCK_ROWS", 2 * rows)
        monkeypatch.setattr(E, "SLICE", 50)
        assert run(spark, places, stops) == whole and len(whole) >= 0.97 * len(names)


def test_empty(spark):
    assert run(spark, [], []) == [] and run(spark, [("p", "X", 1.0, 1.0)], []) == []


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 2))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    w = E.fit_logistic(x, y)
    assert (((x @ w[:2] + w[2]) > 0) == (y > 0)).mean() > 0.97


def test_hot_cell_keeps_slips_in_short_names(spark, monkeypatch):
    monkeypatch.setattr(E, "PART_ROWS", 2)
    places = [("p1", "Gufyl Station", 50.0, 8.0), ("p2", "Brogom Station", 50.001, 8.0), ("p3", "Tarn Road", 50.0, 8.001), ("p4", "Morel Hall", 50.001, 8.001)]
    stops = [("s1", "f", "Guyfl Station", 50.0, 8.0), ("s2", "f", "Broom Station", 50.001, 8.0), ("s3", "f", "Tarn Road", 50.0, 8.001), ("s4", "f", "Morel Hall", 50.001, 8.001)]
    assert run(spark, places, stops) == [("p1", "s1"), ("p2", "s2"), ("p3", "s3"), ("p4", "s4")]


def test_rare_short_names_do_not_depend_on_crowding(spark, monkeypatch):
    places = [("p0", "Oak", 50.0, 8.0)] + [(f"p{i}", f"Tarn Road {chr(97 + i)}el", 50 + i / 1e5, 8.0) for i in range(1, 12)]
    stops = [("s0", "f", "Oka", 50.0001, 8.0)] + [(f"s{i}", "f", f"Tarn Road {chr(97 + i)}el", 50 + i / 1e5, 8.0) for i in range(1, 12)]
    whole = run(spark, places, stops)
    assert ("p0", "s0") in whole
    monkeypatch.setattr(E, "PART_ROWS", 1)
    assert run(spark, places, stops) == whole


def test_name_pairs_are_those_of_brute_force():
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcde") for _ in range(n))

    def slipped(text):
        t = list(text)
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(t))
            kind = rnd.randrange(4)
            if kind == 0 and len(t) > 1:
                del t[k]
            elif kind == 1:
                t.insert(k, rnd.choice("abcde"))
            elif kind == 2:
                t[k] = rnd.choice("abcde")
            elif k + 1 < len(t):
                t[k], t[k + 1] = t[k + 1], t[k]
        return "".join(t).strip() or "a"

    a = [" ".join(word(rnd.randint(1, 9)) for _ in range(rnd.randint(1, 3))) for _ in range(150)]
    b = [" ".join(slipped(rnd.choice(a)).split()) for _ in range(150)] + [word(1), word(2), word(2), "aaaaaaaaaaaaaaaaaaaa"]
    ia, ib = E.name_pairs(np.zeros(len(a), np.int64), np.arange(len(a)), [[x] for x in a], np.zeros(len(b), np.int64), np.arange(len(b)), [[x] for x in b])
    found = set(zip(ia.tolist(), ib.tolist()))
    grid = [(i, j) for i in range(len(a)) for j in range(len(b))]
    sim = E.name_similarity([[a[i]] for i, _ in grid], [[b[j]] for _, j in grid])
    assert {p for p, s in zip(grid, sim) if s > 0} <= found and len(found) < 0.5 * len(grid)


def test_variants_of_long_crossings_are_all_kept():
    ways = E.variants("Ab, Tarn Street & Ab, Morel Road & Ab, Solvig Lane & Ab, Karpen Court")
    assert ("tarn", "street", "morel", "road", "solvig", "lane", "karpen", "court") in ways and len(ways) == 3


def test_many_stops_of_one_name_in_one_cell(spark, monkeypatch):
    monkeypatch.setattr(E, "SLICE", 500)
    places = [(f"p{i:03}", "Central Hall", 50 + (i % 20) / 1e4, 8 + (i // 20) / 1e4) for i in range(200)]
    stops = [(f"s{i:03}", "f", "Central Hall", 50 + (i % 20) / 1e4 + 1e-6, 8 + (i // 20) / 1e4) for i in range(200)]
    out = run(spark, places, stops)
    assert all(p[1:] == s[1:] for p, s in out) and len({p for p, _ in out}) == len(out)
