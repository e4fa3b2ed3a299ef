import math
import random

import pytest

from geoloom.llm import mixing as M


def frame(spark, seed=1):
    rnd = random.Random(seed)
    rows = [(k, "abd"[min(2, k % 5)] if k % 7 else None, " ".join(["word"] * rnd.randrange(1, 60))) for k in range(900)]
    rows += [(9001, "a", None), (9002, "a", ""), (9003, "none", "text")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_are_met(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_BLOCK", 64)
    mix = M.mix_sources(frame(spark), targets(spark, [("a", 0.5, 3), ("b", 0.2, 2), ("d", 0.2, 1), ("missing", 0.1, 5), ("zero", 0.0, 1)]))
    shares = {r.source: r for r in mix.shares.collect()}
    total = sum(r.tokens for r in shares.values())
    for s, want in (("a", 5 / 9), ("b", 2 / 9), ("d", 2 / 9)):
        assert abs(shares[s].tokens - want * mix.size) <= 31 and abs(shares[s].actual_share - shares[s].tokens / total) < 1e-9
        assert shares[s].most_copies <= shares[s].max_repeats
    assert shares["missing"].tokens == 0 and shares["zero"].tokens == 0
    docs = mix.documents.collect()
    assert len({r.doc_id for r in docs}) == len(docs) and not {9001, 9002, 9003} & {r.doc_id for r in docs}
    assert {r.source: sum(x.n_tokens * x.copies for x in docs if x.source == r.source) for r in docs} == {s: shares[s].tokens for s in "abd"}


def test_order_holds_every_use_once_and_is_even(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_BLOCK", 100)
    mix = M.mix_sources(frame(spark), targets(spark, [("a", 0.3, 3), ("b", 0.4, 4), ("d", 0.3, 1)]))
    order, docs = mix.order.collect(), mix.documents.collect()
    assert sorted((r.doc_id, r.copy) for r in order) == sorted((r.doc_id, c) for r in docs for c in range(1, r.copies + 1))
    assert len({(r.block, r.place) for r in order}) == len(order)
    blocks = sorted({r.block for r in order})
    assert len(blocks) > 4
    for b in blocks:  # each block has about the make-up of the whole
        size = sum(r.n_tokens for r in order if r.block == b)
        for s, want in (("a", 0.3), ("b", 0.4), ("d", 0.3)):
            assert abs(sum(r.n_tokens for r in order if r.block == b and r.source == s) / size - want) < 0.2
    passes = [[r.doc_id for r in sorted(order, key=lambda r: (r.block, r.place)) if r.source == "b" and r.copy == c] for c in (1, 2)]
    assert sorted(passes[0])[:5] == sorted(passes[1])[:5] and passes[0] != passes[1]


def test_a_binding_limit_is_bisected(spark):
    docs, goal = frame(spark), targets(spark, [("a", 0.6, 1), ("b", 0.2, 2), ("d", 0.2, 2)])
    free = M.mix_sources(docs, goal)
    tight = M.mix_sources(docs, goal, size=free.size * 1.1)
    assert free.exponent == 1 and 0 < tight.exponent < 1
    shares = {r.source: r for r in tight.shares.collect()}
    assert all(r.most_copies <= r.max_repeats for r in shares.values()) and abs(sum(r.tokens for r in shares.values()) - tight.size) < 100


def test_exponent():
    sizes, goal, reps = {"a": 1000, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}
    a, size = M.solve_exponent(sizes, goal, reps, None, None)
    assert a == 1 and size == pytest.approx(400)
    a, size = M.solve_exponent(sizes, goal, reps, 800, None)
    w = M.tempered(sizes, goal, a)
    assert 0 < a < 1 and size == 800 and w["b"] * 800 <= 200 + 1e-6 and w["b"] * 800 > 199.9
    a, _ = M.solve_exponent(sizes, goal, reps, None, 0.6)
    assert M.entropy(M.tempered(sizes, goal, a)) == pytest.approx(0.6, abs=1e-6)
    assert M.entropy({"a": 0.5, "b": 0.5}) == pytest.approx(math.log(2))


def test_empty(spark):
    mix = M.mix_sources(frame(spark).limit(0), targets(spark, [("a", 1.0, 1)]))
    assert mix.documents.count() == 0 and mix.order.count() == 0 and mix.shares.collect()[0].tokens == 0
