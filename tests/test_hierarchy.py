import random

from geoloom import util
from geoloom.operators import hierarchy as H
from geoloom.operators.hierarchy import clean_key, descendants, resolve_hierarchy


def brute(links):
    parent = {}
    for tab, scope, node, up in links:
        if node is not None:
            old = parent.get((tab, scope, node))
            parent[tab, scope, node] = min(x for x in (old, up) if x is not None) if (old or up) else None
    out = {}
    for (tab, scope, node), _ in parent.items():
        path, cur, endless = [node], node, False
        while True:
            up = parent[tab, scope, cur]
            if up is None or (tab, scope, up) not in parent:
                break
            if up in path:
                endless = True
                break
            path.append(up)
            cur = up
        out[tab, scope, node] = ("-", -1, None) if endless else (cur, len(path) - 1, path)
    return out


def check(spark, links):
    df = spark.createDataFrame(links, "tab string, scope string, node_id string, parent_id string")
    got = resolve_hierarchy(df, paths=True)
    assert {(r.tab, r.scope, r.node_id): (r.root_id, r.depth, r.path) for r in got.collect()} == brute(links)
    return got


def test_random_forest_with_cycles(spark):
    rnd = random.Random(3)
    links = [("t", f"s{i % 3}", f"n{i}", f"n{rnd.randrange(max(1, i))}" if rnd.random() < 0.9 else rnd.choice([None, "missing"])) for i in range(150)]
    links += [("t", "s0", "x", "y"), ("t", "s0", "y", "x"), ("t", "s0", "z", "y"), ("t", "s1", "self", "self"), ("t", None, "a", "b"), ("t", None, "b", None)]
    links += [links[5], ("t", "s0", "n9", None), ("t", "s0", None, "n1")]
    check(spark, links)


def test_long_chain_and_long_cycle(spark):
    chain = [("t", "", f"c{i:03}", f"c{i + 1:03}" if i < 179 else None) for i in range(180)]
    ring = [("t", "", f"r{i}", f"r{(i + 1) % 70}") for i in range(70)]
    got = check(spark, chain + ring)
    below = descendants(got)
    assert below.where("ancestor_id = 'c179'").count() == 179
    assert below.where("ancestor_id like 'r%'").count() == 0


def test_empty_and_blank(spark):
    empty = spark.createDataFrame([], "tab string, scope string, node_id string, parent_id string")
    assert resolve_hierarchy(empty).count() == 0
    df = spark.createDataFrame([(" a ",), ("",), ("  ",), (None,), (" b\t",)], "p string")
    assert [r[0] for r in df.select(clean_key("p")).collect()] == ["a", None, None, None, "b"]


def test_one_parent_of_most_rows(spark):
    links = [("t", "", "root", None)] + [("t", "", f"k{i}", "root") for i in range(500)]
    check(spark, links)


def test_walk_that_ends_at_a_root(spark):
    # Chains a little longer than a walk: in some of them its last step reaches the root, or a splitter, untested.
    links = [("t", f"s{c}", f"{c}-{i}", f"{c}-{i - 1}" if i else None) for c in range(300) for i in range(16)]
    links += [("t", "ring", f"r{i}", f"r{(i + 1) % 20}") for i in range(20)]
    check(spark, links)


def test_a_cycle_adds_no_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(H, "materialise", lambda df: (written.append(1), util.materialise(df))[1])
    tree = [("t", "", f"n{i}", f"n{(i - 1) // 2}" if i else None) for i in range(300)]
    ring = [("t", "ring", f"r{i}", f"r{(i + 1) % 40}") for i in range(40)]
    check(spark, tree)
    alone = len(written)
    written.clear()
    check(spark, tree + ring)
    assert len(written) <= alone + H.WALK_ROUNDS + 2


def test_tables_written_between_rounds_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(util, "SMALL_BYTES", -1)
    df = spark.createDataFrame([("t", "", f"n{i}", f"n{i - 1}" if i else None) for i in range(60)], "tab string, scope string, node_id string, parent_id string")
    out = resolve_hierarchy(df, paths=True)
    assert out.count() == 60 and "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
