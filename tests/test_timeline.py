"""Per-key history: ties, first rows, null keys, and hot keys cut into blocks."""

from datetime import date, timedelta

import pandas as pd
from pyspark.sql import functions as F

from parcelwise.operators.features import history_features
from parcelwise.operators.scale import (
    Timeline, global_rank, hot_keys, kth_row, range_blocks, running_total, top_n,
)

START = date(2024, 1, 1)
SCHEMA = (
    "return_id string, user_id long, seller_id long, category string, order_value double, "
    "order_date date, return_request_date date, total_returns_at_time long"
)


def rows(spark, specs):
    """specs: (id, user, seller, category, value, request day)."""
    out = []
    for rid, user, seller, category, value, day in specs:
        asked = None if day is None else START + timedelta(days=day)
        out.append((rid, user, seller, category, value, START, asked, 2))
    return spark.createDataFrame(out, SCHEMA)


def history(spark, specs, hot=None, **kw):
    frame = history_features(rows(spark, specs), hot, **kw).toPandas()
    return frame.set_index("return_id").sort_index()


def test_day_windows_stop_at_the_row_among_equal_dates(spark):
    # One user: neighbours at -90, -89, -31, -30, -29 days and four on one day.
    days = [10, 11, 69, 70, 71, 100, 100, 100, 100]
    specs = [(f"r{i}", 1, 1, "Books", 10.0, d) for i, d in enumerate(days)]
    out = history(spark, specs)
    # Window of 30 days up to day 100 starts at day 71; rows after the row itself do not count.
    assert out["returns_last_30d"].tolist()[5:] == [1, 2, 3, 4]
    assert out["returns_last_90d"].tolist()[5:] == [4, 5, 6, 7]


def test_velocity_against_pandas_rolling(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    specs = [
        (f"r{i:04d}", int(rng.integers(0, 12)), 1, "Books", 10.0, int(rng.integers(0, 200)))
        for i in range(600)
    ]
    out = history(spark, specs)
    frame = pd.DataFrame(specs, columns=["return_id", "user_id", "s", "c", "v", "day"])
    frame["t"] = pd.Timestamp(START) + pd.to_timedelta(frame["day"], unit="D")
    frame = frame.sort_values(["user_id", "t", "return_id"])
    for days, column in ((30, "returns_last_30d"), (90, "returns_last_90d")):
        counted = (
            frame.set_index("t").assign(one=1).groupby("user_id")["one"].rolling(f"{days}D").sum() - 1
        )
        want = pd.Series(counted.to_numpy(), index=frame["return_id"].to_numpy()).sort_index()
        assert (out[column] == want).all()


def test_first_return_defaults(spark):
    specs = [("a", 1, 1, "Books", 50.0, 0), ("b", 1, 1, "Books", 200.0, 5)]
    out = history(spark, specs)
    assert out.loc["a", "days_since_last_return"] == -1
    assert out.loc["a", "order_value_ratio"] == 1.0
    assert out.loc["b", "user_avg_order_value"] == 50.0
    assert out.loc["b", "is_high_value_return"] == 1
    assert out.loc["b", "past_seller_returns"] == 1
    open_ratio = history(spark, specs, first_ratio="null")
    assert pd.isna(open_ratio.loc["a", "order_value_ratio"])
    assert open_ratio.loc["b", "order_value_ratio"] == 4.0


def test_null_category_and_null_user(spark):
    specs = [
        ("a", 1, 1, None, 50.0, 0), ("b", 1, 1, None, 50.0, 1), ("c", 1, 1, "Toys", 50.0, 2),
        ("d", None, 1, "Toys", 50.0, 0), ("e", None, 1, "Toys", 50.0, 1), ("f", 1, None, "Toys", 50.0, 3),
        ("g", 1, None, "Toys", 50.0, 4),
    ]
    out = history(spark, specs)
    assert out.loc[["a", "b", "c"], "is_same_category"].tolist() == [0, 0, 0]
    # Rows without a user have no history, however many there are.
    assert out.loc[["d", "e"], "past_returns_count"].tolist() == [0, 0]
    assert out.loc[["f", "g"], "past_seller_returns"].tolist() == [0, 0]


def test_hot_users_give_the_same_result(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    cats = ["Books", "Toys", None]
    specs = []
    for i in range(900):
        user = 1 if i % 3 == 0 else int(rng.integers(2, 40))
        day = int(rng.integers(0, 60)) if rng.random() > 0.02 else None
        specs.append(
            (f"r{i:04d}", user, int(rng.integers(0, 4)), cats[int(rng.integers(0, 3))],
             float(rng.integers(1, 500)), day)
        )
    hot = hot_keys(rows(spark, specs), ["user_id"], min_rows=100)
    assert [r["user_id"] for r in hot.collect()] == [1]
    pd.testing.assert_frame_equal(history(spark, specs), history(spark, specs, hot))


def test_hot_plan_never_windows_a_whole_hot_key(spark):
    specs = [(f"r{i}", 1, 1, "Books", 10.0, i % 50) for i in range(200)]
    hot = hot_keys(rows(spark, specs), ["user_id"], min_rows=50)
    plan = history_features(rows(spark, specs), hot)._jdf.queryExecution().optimizedPlan().toString()
    assert "_cut_return_request_date" in plan


def test_hot_keys_none_when_all_small(spark):
    assert hot_keys(spark.range(100).selectExpr("id % 10 as k"), ["k"], min_rows=10) is None


def test_cut_must_lead_the_order(spark):
    import pytest

    with pytest.raises(ValueError):
        Timeline.of(spark.range(1), ["id"], ["a", "b"], ["b"])


def test_global_rank_and_running_total(spark):
    frame = spark.range(5000).selectExpr("id", "(id * 7919) % 5000 as v")
    ranked = global_rank(frame, ["v"], "rank").toPandas()
    assert (ranked["rank"] == ranked["v"] + 1).all()
    blocked = range_blocks(frame, [F.col("v").desc()])
    total = running_total(blocked, [F.col("v").desc()], {"s": F.col("v")}).toPandas()
    total = total.sort_values("v", ascending=False)
    assert (total["s"] == total["v"].cumsum()).all()


def test_kth_row_matches_sorting(spark):
    frame = pd.DataFrame(
        {"a": [i % 7 for i in range(300)], "b": [i % 3 for i in range(300)], "k": [f"{i:03d}" for i in range(300)]}
    )
    df = spark.createDataFrame(frame)
    ordered = frame.sort_values(["a", "b", "k"], ascending=[False, True, True]).reset_index(drop=True)
    for k in (1, 2, 77, 299, 300):
        got = kth_row(df, [("a", False), ("b", True)], "k", k)
        assert got == ordered.loc[k - 1].to_dict()
    assert kth_row(df, [("a", True)], "k", 0) is None
    assert kth_row(df, [("a", True)], "k", 301) is None


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 2 as k", "id as v").repartition(8)
    best = top_n(df, ["k"], [F.desc("v")], 3, "rank")
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert sorted(r["v"] for r in best.collect()) == [994, 995, 996, 997, 998, 999]
