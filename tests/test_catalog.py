"""Catalogue steps, profiles and integrity."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelwise.functions.columns import blank_to_null, parse_date
from parcelwise.operators import catalog, profile


def test_discounted_value_rounds_half_to_even(spark):
    rows = [(10.0, 12.5, 8.75), (0.25, 50.0, 1.0), (1.25, 10.0, 1.12), (1.15, 10.0, 1.04), (100.0, 0.1, 99.9)]
    df = spark.createDataFrame(rows, "price double, pct double, want double")
    for r in df.select("want", catalog.discounted_value(F.col("price"), F.col("pct")).alias("v")).collect():
        assert r["v"] == r["want"]


def test_returnable(spark):
    df = spark.createDataFrame([(1, 0, 7), (1, 1, 7), (1, 0, 0), (0, 0, 7)], "r int, n int, w int")
    got = [r[0] for r in df.select(catalog.returnable(F.col("r"), F.col("n"), F.col("w"))).collect()]
    assert got == [1, 0, 0, 0]


@pytest.mark.parametrize("total", [3, 10, 97, 1000, 12345])
def test_apportion_sums_to_the_total(spark, total):
    rng = np.random.default_rng(total)
    weights = rng.integers(1, 50, 60)
    df = spark.createDataFrame([(i, int(w)) for i, w in enumerate(weights)], "k int, w int")
    out = catalog.apportion(df, "k", "w", total, "n").toPandas().sort_values("k")
    scaled = np.maximum(np.round(weights * total / weights.sum()).astype(int), 1)
    drift = total - scaled.sum()
    order = np.lexsort((np.arange(60), -scaled))[: abs(drift)]
    scaled[order] += np.sign(drift)
    assert out["n"].tolist() == scaled.tolist()
    if total >= 97:
        assert out["n"].sum() == total


def test_renumber(spark):
    df = spark.createDataFrame([("c", 2), ("a", 2), ("b", 1)], "k string, d int")
    out = {r["k"]: r["n"] for r in catalog.renumber(df, ["d", "k"], "X", 3, "n").collect()}
    assert out == {"b": "X001", "a": "X002", "c": "X003"}


def test_price_band_relaxes_an_empty_range(spark):
    products = spark.createDataFrame([(1, "A", 5.0), (2, "A", 15.0), (3, "B", 7.0)], "product_id int, category string, price double")
    bands = spark.createDataFrame([("low", "A", 0.0, 10.0), ("high", "A", 100.0, 200.0), ("low", "B", 7.0, 7.0)], "segment string, category string, price_lo double, price_hi double")
    got = {(r["segment"], r["category"], r["product_id"], r["relaxed"]) for r in catalog.price_band(products, bands).collect()}
    assert got == {("low", "A", 1, 0), ("high", "A", 1, 1), ("high", "A", 2, 1), ("low", "B", 3, 0)}


def test_eligibility_shares_sum_to_one_with_fallback(spark):
    sellers = spark.createDataFrame([(1, ["A", "B"], 3), (2, ["A"], 1)], "seller_id int, categories array<string>, order_weight long")
    wanted = spark.createDataFrame([("A",), ("B",), ("C",)], "category string")
    out = catalog.seller_eligibility(sellers, wanted).toPandas()
    assert out.groupby("category")["share"].sum().tolist() == [1.0, 1.0, 1.0]
    assert out[out["fallback"] == 1]["category"].unique().tolist() == ["C"]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"g": rng.choice(["x", "y", "z"], 500, p=[0.9, 0.08, 0.02]), "v": rng.integers(0, 60, 500) / 4})
    got = profile.describe_by_group(spark.createDataFrame(frame), "g", "v").toPandas().set_index("g")
    want = frame.groupby("g")["v"].describe()
    for ours, theirs in (("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("mean", "mean"), ("std", "std")):
        assert np.allclose(got[ours].sort_index(), want[theirs].sort_index())


def test_describe_whole_table(spark):
    df = spark.range(1, 101).selectExpr("id * 2 as v")
    row = profile.describe(df, "v").first()
    assert (row["count"], row["min"], row["p25"], row["p50"], row["p75"], row["max"]) == (100, 2, 51.5, 101, 150.5, 200)


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 180, 181, 730, 731, 9999, 10000)], "v int")
    got = [r[0] for r in df.select(profile.bin_label(F.col("v"))).collect()]
    assert got == [None, "new", "new", "mid", "mid", "veteran", "veteran", None]


def test_integrity_counts(spark):
    ids = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} int")
    orders = spark.createDataFrame(
        [("o1", 1, 1, 1, 1), ("o2", 9, 1, 1, 1), ("o2", 9, 1, 8, 0), ("o3", None, 7, 1, 0)],
        "order_id string, user_id int, product_id int, seller_id int, is_returned int",
    )
    returns = spark.createDataFrame([("r1", "o1"), ("r1", "o1"), ("r2", "o3")], "return_id string, order_id string")
    got = {
        r["check"]: r["violations"]
        for r in profile.integrity_report(ids("user_id", [1]), ids("seller_id", [1]), ids("product_id", [1]), orders, returns).collect()
    }
    assert got == {
        "orders_without_user": 3, "orders_without_product": 1, "orders_without_seller": 1,
        "returns_of_unreturned_orders": 1, "duplicate_return_ids": 1, "duplicate_order_ids": 1,
        "orders_with_null_keys": 1,
    }


def test_dates_in_mixed_formats(spark):
    texts = ["2024-02-29", "2024-02-29 12:00:00", "2024-02-29T01:02:03", " 2024/02/29 ", "29-02-2024", "02/29/2024", "2023-02-29", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_date(F.col("t"))).collect()]
    assert got == [date(2024, 2, 29)] * 6 + [None] * 3


@pytest.mark.parametrize(
    "text, want",
    [
        ("05-01-2024", date(2024, 5, 1)), ("13-01-2024", date(2024, 1, 13)), ("1/5/2024", date(2024, 1, 5)),
        ("2024-1-5", date(2024, 1, 5)), ("Jan 5, 2024", date(2024, 1, 5)), ("5 January 2024", date(2024, 1, 5)),
        ("2024-01-05T01:02:03.456+05:30", date(2024, 1, 5)), ("20240105", date(2024, 1, 5)), ("13/13/2024", None),
        ("5 Jam 2024", None), ("2024-01/05", None), ("2024-01-05 noon", None),
    ],
)
def test_one_date(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_date(F.col("t"))).first()[0] == want


def test_blank_to_null(spark):
    df = spark.createDataFrame([(" x ",), ("\t\n",), ("",), ("　",), (None,)], "t string")
    assert [r[0] for r in df.select(blank_to_null(F.col("t"))).collect()] == ["x", None, None, None, None]


def test_window_fields(spark):
    d = date(2024, 1, 1)
    rows = [(d + timedelta(days=n), d, w) for n, w in ((7, 7), (8, 7), (7, 0), (9, 0), (10, 10))]
    df = spark.createDataFrame(rows, "return_request_date date, delivery_date date, return_window_days int")
    got = [(r["within_window"], r["days_left"]) for r in catalog.window_fields(df).collect()]
    assert got == [(1, 0), (0, 0), (1, 0), (0, 0), (1, 0)]


def test_apportion_takes_fractional_weights(spark):
    df = spark.createDataFrame([(i, 0.5 + 0.25 * i) for i in range(1, 9)], "k long, w double")
    rows = catalog.apportion(df, "k", "w", 100, "n").collect()
    assert sum(r.n for r in rows) == 100
    assert all(abs(r.n - 100 * r.w / 13) <= 1 for r in rows)


def test_shares_of_nothing_are_null(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 3)], "g string, w long")
    assert {(r.g, r.s) for r in catalog.normalised(df, "g", "w", "s").collect()} == {("a", None), ("b", 1.0)}
