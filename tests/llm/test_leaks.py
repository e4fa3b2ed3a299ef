import random

import numpy as np

from geoloom.llm import leaks as L

RND = random.Random(11)


def word():
    return "".join(RND.choice("bdfgklmnprstvz") + RND.choice("aeiou") for _ in range(3))


POOL = [word() for _ in range(500)]
OTHER = [word() + "x" for _ in range(800)] + ["the", "of", "a", "and"] * 40
ITEMS = [(i, " ".join(RND.choice(POOL + ["the", "of"] * 40) for _ in range(RND.randrange(20, 70))) + ".", RND.choice(POOL)) for i in range(30)]


def docs():
    out, true = [], set()
    for d in range(160):
        text = [RND.choice(OTHER) for _ in range(RND.randrange(5, 500))]
        for _ in range(RND.choice([0, 0, 1, 2])):
            item, size = RND.choice(ITEMS), RND.randrange(8, 20)
            words = item[1].split()
            s = RND.randrange(max(1, len(words) - size))
            at = RND.randrange(len(text) + 1)
            part = words[s : s + size]
            style = RND.randrange(4)
            if style == 1:
                part = [w.upper() for w in part]
            if style == 2 and len(part[0]) > 5:
                part[0] = part[0][:3] + "-\n" + part[0][3:]
            if style == 3:
                part = [f"<i>{w}</i>" if k % 3 == 0 else w + "​," for k, w in enumerate(part)]
            text[at:at] = part
        out.append((d, " ".join(text)))
    grams = {}
    for i, t, _ in ITEMS:
        w = L.words_of(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    for d, t in out:
        w = L.words_of(t)
        for k in range(len(w) - 11):
            true |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    return out, true


def test_words():
    assert L.words_of("The ﬁne <b>co-\nal</b>, Ａb​c&lt;i&gt;x&lt;/i&gt; spring-loaded") == ["the", "fine", "coal", "abcx", "spring", "loaded"]
    assert L.words_of(None) == [] and L.words_of("") == []


def test_checks_match_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(1, 5, rng.integers(1, 15))
        best = max((n for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if (a[i : i + n] == b[j : j + n]).all()), default=0)
        lcs = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                lcs[i + 1, j + 1] = lcs[i, j] + 1 if a[i] == b[j] else max(lcs[i, j + 1], lcs[i + 1, j])
        assert L.longest_run(a, b) == best and L.common_subsequence(a, b) == lcs[-1, -1]


def test_leaks_match_brute_force(spark):
    rows, true = docs()
    d = spark.createDataFrame([*rows, (900, None), (901, ""), (902, rows[0][1])], "doc_id bigint, text string")
    i = spark.createDataFrame([*ITEMS, (77, None, None), (78, "", "x"), (ITEMS[0][0], None, None)], "item_id bigint, item_text string, answer string")
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(d, i).where("run >= 12").collect()}
    assert {p for p in got if p[0] < 900} == true and len(true) > 30


def test_answer_and_paraphrase(spark):
    words = ITEMS[3][1].rstrip(".").split()
    swapped = [w if k % 6 else RND.choice(OTHER) for k, w in enumerate(words)]
    d = spark.createDataFrame([(1, " ".join(swapped) + " " + ITEMS[3][2])], "doc_id bigint, text string")
    i = spark.createDataFrame(ITEMS, "item_id bigint, item_text string, answer string")
    rows = [r for r in L.find_leaks(d, i).collect() if r.item_id == 3]
    assert rows and rows[0].answer and rows[0].run < 12 and rows[0].subsequence >= 0.7 * rows[0].item_words


def test_recall_of_planted_paraphrases(spark):
    rnd = random.Random(23)
    rows, planted = [], set()
    for d in range(150):
        text = [rnd.choice(OTHER) for _ in range(rnd.randrange(5, 400))]
        item = rnd.choice([i for i in ITEMS if len(i[1].split()) >= 30])
        told = []
        for w in item[1].rstrip(".").split():
            told += [rnd.choice(OTHER)] if rnd.random() < 0.25 else [w]
            told += [rnd.choice(OTHER)] * (rnd.random() < 0.25)  # spread out by words in between
        at = rnd.randrange(len(text) + 1)
        text[at:at] = told
        rows.append((d, " ".join(text)))
        planted.add((d, item[0], len(item[1].split())))
    found = L.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, item_text string, answer string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len({(d, i) for d, i, _ in planted} & got) >= 0.95 * len(planted)
    assert sum(r.run < L.LEAST_RUN for r in found) > 50


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, item_text string, answer string")
    assert L.find_leaks(d, i).count() == 0
    assert L.find_leaks(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), i.limit(0)).count() == 0
