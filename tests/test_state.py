"""State at the time of a return against brute force."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from parcelwise.operators.scale import LONE, hot_keys, lone
from parcelwise.operators.state import as_of_state, as_of_state_by_user, excluded_by_cell, gap_chain, return_state

START = date(2024, 1, 1)


def day(n):
    return START + timedelta(days=int(n))


def returns(spark, n, lag_low, lag_high, seed, hot_share=0.3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        user = 1 if rng.random() < hot_share else int(rng.integers(2, 15))
        ordered = int(rng.integers(0, 120))
        asked = ordered + int(rng.integers(lag_low, lag_high + 1))
        rows.append((f"r{i:04d}", user, int(rng.integers(0, 3)), day(ordered), day(asked), float(rng.integers(1, 99))))
    schema = "return_id string, user_id long, seller_id long, order_date date, return_request_date date, order_value double"
    return spark.createDataFrame(rows, schema), rows


def brute(rows):
    out = {}
    for r in rows:
        before = [q for q in rows if q[1] == r[1] and (q[3], q[4], q[0]) < (r[3], r[4], r[0])]
        recent = sum((r[4] - q[4]).days <= 30 for q in before)
        out[r[0]] = (len(before), recent, sum(q[2] == r[2] for q in before))
    return out


def collected(df):
    return {
        r["return_id"]: (
            r["total_returns_at_time"], r["returns_30d_by_order"], r["seller_returns_at_time"]
        )
        for r in df.collect()
    }


@pytest.mark.parametrize("lags", [(0, 30), (0, 80), (-10, 60)])
@pytest.mark.parametrize("split", [False, True])
def test_return_state(spark, lags, split):
    df, rows = returns(spark, 250, *lags, seed=5)
    hot = hot_keys(df, ["user_id"], min_rows=40) if split else None
    assert (hot is not None) == split
    assert collected(return_state(df, hot)) == brute(rows)


def brute_excluded(cells):
    return {
        (u, o, r): sum(m for v, p, q, m in cells if v == u and (p, q) < (o, r) and r - q > 30)
        for u, o, r, _ in cells
    }


@pytest.mark.parametrize("min_cells,span", [(20_000, 32), (40, 32), (0, 1), (0, 7), (0, 10_000)])
def test_excluded_cells_of_any_blocks(spark, min_cells, span):
    """Users above and below the limit, requests before and long after orders, days below zero."""
    rng = np.random.default_rng(8)
    cells = {}
    for _ in range(700):
        o = int(rng.integers(-40, 160))
        cells[(int(rng.integers(1, 5)) if rng.random() < 0.5 else 9, o, o + int(rng.integers(-20, 120)))] = int(rng.integers(1, 6))
    cells = [(*k, n) for k, n in cells.items()] + [(7, 5, 90, 2)]
    df = spark.createDataFrame(cells, "user_id long, order_day long, request_day long, n long")
    got = {(r.user_id, r.order_day, r.request_day): r.excluded for r in excluded_by_cell(df, min_cells, span).collect()}
    assert got == brute_excluded(cells)


def test_a_user_of_a_million_cells(spark):
    """One user's cells go to many groups, and the counts are those of a whole grid."""
    cells = spark.range(1_000_000).selectExpr("1L user_id", "id div 1000 order_day", "id % 1000 request_day", "id % 7 + 1 n")
    got = excluded_by_cell(cells).repartition(4).toPandas()
    n = (np.arange(1_000_000) % 7 + 1).reshape(1000, 1000).cumsum(0).cumsum(1)
    want = np.zeros((1000, 1000), dtype="int64")
    want[:, 31:] = n[:, :-31]
    assert len(got) == 1_000_000
    assert (got["excluded"].to_numpy() == want[got["order_day"], got["request_day"]]).all()
    groups = cells.selectExpr("order_day div 32 AS b").distinct().count()
    assert groups > 30


def test_as_of_counts_the_same_day_and_falls_back(spark):
    orders = spark.createDataFrame(
        [(1, day(0), 10.0), (1, day(5), 20.5), (1, day(5), 1.25), (1, day(9), 7.0), (2, day(50), 5.0)],
        "user_id long, order_date date, order_value double",
    )
    asked = spark.createDataFrame(
        [
            ("a", 1, day(5), 3.0), ("b", 1, day(4), 3.0), ("c", 2, day(10), 30.0),
            ("d", 2, day(60), 40.0), ("e", 3, day(1), 8.0), ("f", None, day(1), 8.0), ("g", 4, day(1), None),
        ],
        "return_id string, user_id long, return_request_date date, order_value double",
    )
    got = {
        r["return_id"]: (r["total_orders_at_time"], r["orders_value_at_time"])
        for r in as_of_state(asked, orders).collect()
    }
    assert got == {
        "a": (3, 31.75), "b": (1, 10.0), "c": (1, 35.0), "d": (1, 5.0), "e": (1, 8.0),
        "f": (1, 1.0), "g": (1, 1.0),
    }


def test_as_of_by_user_is_as_of(spark):
    """With missing users, days and amounts, and repeated rows."""
    rng = np.random.default_rng(2)
    pick = lambda *some: some[rng.integers(len(some))]
    days = [None, *map(day, range(0, 40, 3))]
    orders = [(pick(None, 1, 2, 3), pick(*days), pick(None, 1.5, 7.25)) for _ in range(60)]
    asked = [(f"r{i}", pick(None, 1, 2, 3, 4, 5), pick(*days), pick(None, 2.0, 3.5)) for i in range(80)]
    orders = spark.createDataFrame(orders, "user_id long, order_date date, order_value double")
    asked = spark.createDataFrame(asked + asked[:9], "return_id string, user_id long, return_request_date date, order_value double")
    want = as_of_state(asked, orders)
    got = as_of_state_by_user(asked.withColumn(LONE, lone(["user_id"], "return_id")), orders, 11).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_gap_chain_stops_at_the_end_date(spark):
    rows = [(1, i, day(0), 10) for i in range(5)] + [(2, i, day(100), 1) for i in range(3)]
    df = spark.createDataFrame(rows, "user_id long, n int, first date, gap int")
    out = gap_chain(df, "user_id", ["n"], ["n"], "first", "gap", day(30)).toPandas()
    one = out[out["user_id"] == 1].sort_values("n")
    assert one["event_date"].tolist() == [day(0), day(10), day(20)]
    # The first event stays even when it is past the end.
    assert out[out["user_id"] == 2]["event_date"].tolist() == [day(100)]
    hot = hot_keys(df, ["user_id"], min_rows=4)
    again = gap_chain(df, "user_id", ["n"], ["n"], "first", "gap", day(30), hot).toPandas()
    key = ["user_id", "n"]
    pd.testing.assert_frame_equal(
        out.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True)
    )
