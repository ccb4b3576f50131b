"""Additive fraud score, label threshold and labels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from parcelwise.config import (
    FRAUD_SCORE_NORMALIZATION, FRAUD_SCORE_WEIGHTS, ScoringParams,
)
from parcelwise.functions.columns import at_least_one, ratio, sigmoid


def score_inputs(df: DataFrame) -> DataFrame:
    """Ratios used by the score from the stored point-in-time counts."""
    orders = at_least_one(F.col("total_orders_at_time"))
    returns = at_least_one(F.col("total_returns_at_time"))
    average = F.col("orders_value_at_time") / orders.cast("double")
    return df.withColumns(
        {
            "rtor_at_time": ratio(F.col("total_returns_at_time"), orders),
            "value_ratio_at_time": F.col("order_value") / F.greatest(average, F.lit(1.0)),
            "seller_ratio_at_time": ratio(F.col("seller_returns_at_time"), returns),
        }
    )


def fraud_score(
    weights: dict = FRAUD_SCORE_WEIGHTS, norm: dict = FRAUD_SCORE_NORMALIZATION
) -> Column:
    """Weighted sum of eleven signals, each scaled to [0, 1]."""

    def d(value) -> Column:
        return F.lit(float(value))

    def up_to_one(column: Column) -> Column:
        return F.least(column, d(1))

    def positive(column: Column) -> Column:
        return F.greatest(column, d(0))

    days = F.col("days_since_delivered").cast("double")
    early = norm["early_return_days"]
    signals = {
        "return_to_order_ratio": up_to_one(F.col("rtor_at_time") / d(norm["rtor_saturation"])),
        "high_value_ratio": up_to_one(
            positive((F.col("value_ratio_at_time") - d(1)) / d(norm["value_ratio_saturation"]))
        ),
        "new_account": positive(
            d(1) - F.col("account_age_days").cast("double") / d(norm["age_saturation_days"])
        ),
        "no_image": d(1) - F.col("image_uploaded").cast("double"),
        "seller_repeat_ratio": up_to_one(F.col("seller_ratio_at_time")),
        "high_return_freq": up_to_one(
            F.col("returns_30d_by_order").cast("double") / d(norm["freq_saturation_returns"])
        ),
        "early_return": F.when(days <= d(early), positive(d(1) - days / d(early))).otherwise(d(0)),
        "unverified_account": d(1) - F.col("email_verified").cast("double"),
        "changed_mind_reason": F.coalesce(
            (F.col("reason_category") == "changed_mind").cast("double"), d(0)
        ),
        "shared_device": F.col("shared_device_flag").cast("double"),
        "high_discount": positive(F.col("discount_pct") / d(100) - d(norm["high_discount_floor"])),
    }
    total = None
    for name, signal in signals.items():
        term = d(weights[name]) * signal
        total = term if total is None else total + term
    return total


def fraud_probability(score: Column, threshold, scale: float = ScoringParams.noise_scale) -> Column:
    return sigmoid((score - threshold) / F.lit(float(scale)))


#: Bins of a score histogram are so many scales wide, and hold so many power sums.
BIN_SCALES = 1 / 16
MOMENTS = 6
#: A sigmoid this many scales from its middle is 0 or 1 to within e**-40.
FLAT_SCALES = 40


def score_moments(df: DataFrame, score: str, scale: float, low: float, high: float) -> DataFrame:
    """(bin, n, m1 .. m6): histogram of scores around the thresholds low to high, with the sums of
    powers of each score's distance, in scales, from the middle of its bin.

    Histograms of parts of a table add up to the histogram of the whole. Scores too far
    from every threshold to be told from a step lie in the two outermost bins, so
    the number of bins has a bound whatever the scores. Null and NaN are left out.
    """
    s, width = F.col(score), scale * BIN_SCALES
    end = int(FLAT_SCALES / BIN_SCALES)
    last = int((high - low) / width) + end
    scaled = (s - F.lit(float(low))) / F.lit(width)
    inner = scaled.between(F.lit(float(-end)), F.lit(float(last)))
    place = F.when(inner, F.floor(scaled)).when(scaled < 0, F.lit(-end - 1)).otherwise(F.lit(last + 1))
    away = F.when(inner, (scaled - F.floor(scaled) - F.lit(0.5)) * F.lit(BIN_SCALES)).otherwise(F.lit(0.0))
    rows = df.where(s.isNotNull() & ~F.isnan(s)).select(place.cast("long").alias("bin"), away.alias("u"))
    powers, sums = F.lit(1.0), []
    for k in range(1, MOMENTS + 1):
        powers = powers * F.col("u")
        sums.append(F.sum(powers).alias(f"m{k}"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), *sums)


def _sigmoid_terms(count: int) -> list[np.polynomial.Polynomial]:
    """Taylor coefficients of the sigmoid as polynomials in its value y, as dy = y (1 - y)."""
    step = np.polynomial.Polynomial([0.0, 1.0, -1.0])
    terms, found = [np.polynomial.Polynomial([0.0, 1.0])], []
    for k in range(count + 1):
        found.append(terms[-1] / math.factorial(k))
        terms.append(terms[-1].deriv() * step)
    return found


def calibrate_threshold(
    df: DataFrame,
    score: str,
    target: float = ScoringParams.target_ratio,
    scale: float = ScoringParams.noise_scale,
    low: float = -20.0,
    high: float = 40.0,
    halvings: int = 50,
) -> float:
    """Threshold at which the mean fraud probability equals `target`, by bisection.

    The scores are read once, into a histogram of bounded size (`score_moments`). Within a
    bin the sigmoid is its Taylor polynomial around the middle: at 1/32 scale from
    it and with six power sums the rest is below 1e-13, for each score and so for the mean.
    """
    rows = score_moments(df, score, scale, low, high).collect()
    if not rows:
        raise ValueError("no scores to calibrate on")
    table = np.array(sorted(tuple(map(float, r)) for r in rows))
    middle = low + (table[:, 0] + 0.5) * scale * BIN_SCALES
    share = table[:, 1:] / table[:, 1].sum()
    terms = _sigmoid_terms(MOMENTS)
    for _ in range(halvings):
        tried = (low + high) / 2.0
        y = 1.0 / (1.0 + np.exp(np.clip((tried - middle) / scale, -50.0, 50.0)))
        mean = sum(float((term(y) * share[:, k]).sum()) for k, term in enumerate(terms))
        low, high = (tried, high) if mean > target else (low, tried)
    return (low + high) / 2.0


def seeded_uniform(key: str, seed: int) -> Column:
    """Uniform in [0, 1) fixed by the key and seed, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(2**40)) / F.lit(float(2**40))


def label_by_draw(probability: Column, draw: Column) -> Column:
    return F.when(draw < probability, "fraud").otherwise("legitimate")


def combined_score(
    model: Column, rules: Column, params: ScoringParams = ScoringParams()
) -> Column:
    return F.lit(params.model_weight) * model + F.lit(params.rule_weight) * rules
