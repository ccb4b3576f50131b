"""Split, curves and reports against direct computation."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.operators import evaluate, scoring


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 400)
    scores = np.round(np.clip(0.4 * labels + rng.random(400) * 0.7, 0, 1), 2)
    rows = [
        (f"r{i:03d}", int(l), float(s), date(2024, 1, 1) + timedelta(days=i % 9), date(2023, 12, 1) + timedelta(days=i % 4))
        for i, (l, s) in enumerate(zip(labels, scores))
    ]
    return spark.createDataFrame(
        rows, "return_id string, y int, s double, return_request_date date, order_date date"
    ).cache()


def pairwise(df):
    rows = df.select("y", "s").collect()
    pos, neg = [r["s"] for r in rows if r["y"]], [r["s"] for r in rows if not r["y"]]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return won / (len(pos) * len(neg))


def test_auc_counts_pairs(points):
    auc = evaluate.roc_auc(evaluate.score_curve(points, "s", "y")).first()["roc_auc"]
    assert auc == pytest.approx(pairwise(points), abs=1e-12)


def test_auc_ignores_monotone_change_and_layout(points):
    changed = points.withColumn("s", F.exp("s") * 3).repartition(7)
    a = evaluate.roc_auc(evaluate.score_curve(points, "s", "y")).first()["roc_auc"]
    b = evaluate.roc_auc(evaluate.score_curve(changed, "s", "y")).first()["roc_auc"]
    assert a == b


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.6)], "y int, s double")
    assert evaluate.roc_auc(evaluate.score_curve(df, "s", "y")).first()["roc_auc"] is None


def test_recall_at_fpr(points):
    rows = points.select("y", "s").collect()
    p, n = sum(r["y"] for r in rows), sum(1 - r["y"] for r in rows)
    best = 0.0
    for t in {r["s"] for r in rows}:
        fp = sum(1 for r in rows if not r["y"] and r["s"] >= t)
        if fp / n <= 0.05:
            best = max(best, sum(r["y"] for r in rows if r["s"] >= t) / p)
    got = evaluate.recall_at_fpr(evaluate.score_curve(points, "s", "y")).first()
    assert got["recall"] == pytest.approx(best)
    assert got["fpr"] <= 0.05


def test_report(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 0)] * 1 + [(1, 1)] * 4
    df = spark.createDataFrame(rows, "y int, p int")
    got = {r["class"]: r for r in evaluate.classification_report(df, "y", "p").collect()}
    assert got["legitimate"]["precision"] == 5 / 6 and got["legitimate"]["recall"] == 5 / 7
    assert got["fraud"]["precision"] == 4 / 6 and got["fraud"]["recall"] == 4 / 5
    assert got["accuracy"]["f1"] == 9 / 12 and got["fraud"]["support"] == 5
    never = evaluate.classification_report(df.where("p = 0"), "y", "p").collect()
    assert {r["class"]: r["precision"] for r in never}["fraud"] == 0.0


@pytest.mark.parametrize("share", [0.0, 0.5, 0.8, 1.0])
def test_split_is_exact_and_chronological(points, share):
    got = evaluate.temporal_split(points, share).collect()
    got.sort(key=lambda r: (r["return_request_date"], r["order_date"], r["return_id"]))
    cut = int(400 * share)
    assert [r["split"] for r in got] == ["train"] * cut + ["test"] * (400 - cut)


def test_split_with_null_dates_first(spark):
    rows = [("a", None, None), ("b", None, date(2024, 1, 1)), ("c", date(2024, 1, 1), None), ("d", date(2024, 1, 2), None)]
    df = spark.createDataFrame(rows, "return_id string, return_request_date date, order_date date")
    for k in range(5):
        got = {r["return_id"]: r["split"] for r in evaluate.temporal_split(df, k / 4).collect()}
        assert [got[i] for i in "abcd"] == ["train"] * k + ["test"] * (4 - k)


def test_sample_is_stable(points):
    a = [r["return_id"] for r in evaluate.sample_rows(points, "return_id", 20).collect()]
    b = [r["return_id"] for r in evaluate.sample_rows(points.repartition(5), "return_id", 20).collect()]
    assert a == b and len(set(a)) == 20
    assert a != [r["return_id"] for r in evaluate.sample_rows(points, "return_id", 20, seed=1).collect()]


@pytest.mark.parametrize("n", [0, 1, 57, 400, 500])
def test_large_samples_are_exact_and_stable(points, n):
    a = evaluate.sample_rows(points, "return_id", n) if n else None
    if n == 0:
        assert evaluate.sample_rows(points, "return_id", 0).count() == 0
        return
    b = evaluate.sample_rows(points.repartition(3), "return_id", n)
    ids = {r["return_id"] for r in a.collect()}
    assert len(ids) == a.count() == min(n, 400)
    assert ids == {r["return_id"] for r in b.collect()}


def test_threshold_matches_plain_bisection(spark):
    scores = np.random.default_rng(2).normal(3, 1.5, 500)
    df = spark.createDataFrame([(float(s),) for s in scores], "v double")
    got = scoring.calibrate_threshold(df, "v")
    low, high = -20.0, 40.0
    for _ in range(50):
        mid = (low + high) / 2
        mean = (1 / (1 + np.exp(np.clip(-(scores - mid) / 0.9, -50, 50)))).mean()
        low, high = (mid, high) if mean > 0.4 else (low, mid)
    assert got == pytest.approx((low + high) / 2, abs=1e-9)


def test_histograms_of_parts_add_up(spark):
    scores = [*np.random.default_rng(3).normal(1, 4, 900), -1e9, 1e9, float("inf"), float("-inf"), -20.0, 40.0]
    df = spark.createDataFrame([(float(s), i) for i, s in enumerate(scores)] + [(None, 0), (float("nan"), 1)], "v double, i long")
    parts = [scoring.score_moments(df.where(F.col("i") % 2 == k), "v", 0.9, -20.0, 40.0) for k in (0, 1)]
    names = ["n", *[f"m{k}" for k in range(1, 7)]]
    merged = parts[0].union(parts[1]).groupBy("bin").agg(*[F.sum(c).alias(c) for c in names])
    whole = {r["bin"]: r for r in scoring.score_moments(df, "v", 0.9, -20.0, 40.0).collect()}
    found = {r["bin"]: r for r in merged.collect()}
    assert whole.keys() == found.keys() and sum(r["n"] for r in whole.values()) == len(scores)
    for b, r in whole.items():
        assert [found[b][c] for c in names] == pytest.approx([r[c] for c in names], abs=1e-12)


@pytest.mark.parametrize("target", [0.001, 0.2, 0.4, 0.9])
def test_threshold_with_far_scores(spark, target):
    """The mean probability at the threshold is the target, scores far outside included."""
    draw = np.random.default_rng(4)
    scores = np.concatenate([draw.normal(2, 3, 400), draw.normal(0, 0.01, 300), [-500.0, 1e6, 5000.0]])
    got = scoring.calibrate_threshold(spark.createDataFrame([(float(s),) for s in scores], "v double"), "v", target)
    mean = (1 / (1 + np.exp(np.clip((got - scores) / 0.9, -50, 50)))).mean()
    if target > 3 / len(scores):
        assert mean == pytest.approx(target, abs=1e-11)
    else:  # three scores above every threshold: none is high enough
        assert got == pytest.approx(40.0, abs=1e-9)


def test_no_scores(spark):
    with pytest.raises(ValueError):
        scoring.calibrate_threshold(spark.createDataFrame([(None,)], "v double"), "v")


def test_seeded_draw_is_uniform_and_stable(spark):
    df = spark.range(20000).withColumn("u", scoring.seeded_uniform("id", 42))
    stats = df.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(stats[0] - 0.5) < 0.01 and stats[1] >= 0 and stats[2] < 1
