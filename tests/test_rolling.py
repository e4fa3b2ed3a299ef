import datetime as dt
import random

from geoloom.operators.rolling import latest_versions, rolling_totals

FIRST, LAST = dt.date(2025, 2, 1), dt.date(2025, 4, 30)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for k in range(800):
        user = "hot" if k % 3 == 0 else f"u{rnd.randrange(7)}"
        rows.append((user, dt.date(2025, 1, 1) + dt.timedelta(days=rnd.randrange(140)), rnd.randrange(-5, 50), None if rnd.random() < 0.1 else rnd.randrange(9)))
    rows += [(None, FIRST, 1, 1), ("idle", dt.date(2024, 1, 1), 5, 5), ("u1", None, 1, 1)]
    df = spark.createDataFrame(rows, "e string, d date, x int, y int")
    got = {(r.e, r.d): (r.x_7, r.x_30, r.y_7, r.y_30, r.avg_x_7) for r in rolling_totals(df, "e", "d", ["x", "y"], first=FIRST, last=LAST).collect()}
    users = {r[0] for r in rows if r[0] and r[1]}
    assert len(got) == len(users) * ((LAST - FIRST).days + 1)
    for (user, day), have in got.items():
        total = lambda c, w: sum(r[c] or 0 for r in rows if r[0] == user and r[1] and day - dt.timedelta(days=w - 1) <= r[1] <= day)  # noqa: E731, B023
        assert have == (total(2, 7), total(2, 30), total(3, 7), total(3, 30), total(2, 7) / 7)


def test_versions_and_empty(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [("k", t, 1), ("k", t + dt.timedelta(1), 5), ("k", t + dt.timedelta(1), 5), ("k", None, 9), ("n", None, None), (None, t, 3)]
    df = spark.createDataFrame(rows, "key string, v timestamp, x int")
    assert {(r.key, r.x) for r in latest_versions(df, ["key"], "v", ["x"]).collect()} == {("k", 5), ("n", 0), (None, 3)}
    empty = spark.createDataFrame([], "e string, d date, x int")
    assert rolling_totals(empty, "e", "d", ["x"], first=FIRST, last=LAST).count() == 0
