"""Velocity counts of the stream against a plain count over all returns."""

import random
from datetime import date, timedelta

import pytest

from parcelwise.streaming.velocity import ARRIVAL, close_days, update_history, velocity

START = date(2024, 1, 1)


def plain(rows):
    """Counts of earlier returns of the user within 30 and 90 days, row by row."""
    out = {}
    for i, user, day, ordered in rows:
        if day is None:
            out[i] = (None, None)
            continue
        before = [d for j, u, d, o in rows if user is not None and u == user and d is not None and (d, o, j) < (day, ordered, i)]
        out[i] = tuple(sum((day - d).days < k for d in before) for k in (30, 90))
    return out


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / x) for x in ("in", "history", "checkpoint")]


def arrive(spark, rows, source):
    spark.createDataFrame(rows, ARRIVAL).coalesce(1).write.mode("append").parquet(source)


def counts(df):
    return {r["return_id"]: (r["returns_last_30d"], r["returns_last_90d"]) for r in df.collect()}


def test_late_repeated_and_hot_returns(spark, places):
    draw = random.Random(5)
    rows = []
    for i in range(400):
        user = 7 if draw.random() < 0.4 else draw.choice([1, 2, 3, None])
        day = START + timedelta(days=draw.choice([0, 1, 29, 30, 31, 60, 89, 90, 91, 120, 150, 310]))
        rows.append((f"r{i:03}", user, day, day - timedelta(days=draw.randint(1, 4))))
    rows.append(("none", 7, None, START))
    # Five days of delay at most: arrival order is mixed, and every 4th comes twice.
    timed = sorted(rows, key=lambda r: (r[2] or START) + timedelta(days=draw.randint(0, 5)))
    parts = [timed[:130], timed[110:260] + timed[100:130:4], timed[260:]]
    source = places[0]
    for n, part in enumerate(parts):
        arrive(spark, part, source)
        if n == 2:
            close_days(spark, source, "2025-06-01")
        update_history(spark, *places)
    history = spark.read.parquet(places[1])
    days = {(r["user_id"], r["day"]) for r in history.collect()}
    assert history.count() == len(days)  # each day is told once
    df = spark.createDataFrame(rows, ARRIVAL)
    want = plain(rows)
    assert counts(velocity(df, history)) == want
    hot = df.where("user_id = 7").select("user_id", "return_request_date").distinct().where("return_request_date IS NOT NULL")
    assert counts(velocity(df, history, hot)) == want
    update_history(spark, *places)  # nothing new, nothing told again
    assert spark.read.parquet(places[1]).count() == len(days)


def test_days_stay_open_until_the_watermark(spark, places):
    rows = [("a", 1, START, START), ("b", 1, START + timedelta(days=20), START)]
    arrive(spark, rows, places[0])
    update_history(spark, *places)
    found = counts(velocity(spark.createDataFrame(rows, ARRIVAL), spark.read.parquet(places[1])))
    assert found == {"a": (0, 0), "b": (None, None)}
    # Later than the delay allows: not counted, and a told day is not told again.
    arrive(spark, [("late", 1, START + timedelta(days=1), START), ("c", 1, START + timedelta(days=40), START)], places[0])
    close_days(spark, places[0], "2024-04-01")
    update_history(spark, *places)
    told = {r["day"] - (START - date(1970, 1, 1)).days: r["before_short"] for r in spark.read.parquet(places[1]).where("user_id = 1").collect()}
    assert told == {0: 0, 20: 1, 40: 1}


def test_empty_source(spark, places):
    arrive(spark, [], places[0])
    update_history(spark, *places)
    history = spark.createDataFrame([], "user_id long, day int, before_short long, before_long long")
    assert velocity(spark.createDataFrame([], ARRIVAL), history).count() == 0


def test_many_users_share_few_states(spark, places):
    """Users of one group, and returns of nobody, keep their own counts from batch to batch. The
    state is called once a group and batch, not once a user."""
    draw = random.Random(8)
    users = [2**60 + 1, 2**60 + 2, *range(40)]
    rows = []
    for i in range(600):
        day = START + timedelta(days=draw.randrange(300))
        rows.append((f"r{i:03}", draw.choice([*users, None]), day, day))
    rows.sort(key=lambda r: r[2])
    for n, part in enumerate([rows[:200], rows[200:420], rows[420:]]):
        arrive(spark, part, places[0])
        if n == 2:
            close_days(spark, places[0], "2025-06-01")
        update_history(spark, *places, groups=2)
    history = spark.read.parquet(places[1])
    assert history.where("user_id is null").count() > 0
    assert counts(velocity(spark.createDataFrame(rows, ARRIVAL), history)) == plain(rows)
