"""Weighted fraud rules as one array of hits per case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelwise.config import RULE_NAMES, RuleParams, WARDROBE_CATEGORIES, WARDROBE_REASONS
from parcelwise.functions.columns import all_of, nan_to_null, percent_text, ratio
from parcelwise.sources.schema import RULE_HIT

# Inputs and the value a missing input counts as (fixed values).
RULE_INPUTS = {
    "is_non_returnable": 0, "within_return_window": 1, "account_age_days": 9999,
    "order_value": 0.0, "category": "", "order_value_ratio": 0.0, "discount_pct": 0.0,
    "reason_category": "", "returns_last_30d": 0, "total_returns_at_time": 0,
    "return_to_order_ratio": 0.0, "days_left_to_return": 999, "seller_return_rate": 0.0,
    "shared_device_flag": 0, "days_since_delivered": -1,
}


def _input(df: DataFrame, name: str) -> Column:
    default = F.lit(RULE_INPUTS[name])
    return F.coalesce(F.col(name), default) if name in df.columns else default


def _text(df: DataFrame, name: str, missing: str) -> Column:
    if name not in df.columns:
        return F.lit(missing)
    return F.coalesce(F.col(name).cast("string"), F.lit(missing))


def _rules(df: DataFrame, p: RuleParams, flags: dict[str, str]) -> list[tuple[str, Column, Column]]:
    """(rule id, condition, description) in evaluation order."""
    v = {name: _input(df, name) for name in RULE_INPUTS}
    rules = [
        (
            "R0_NON_RETURNABLE",
            v["is_non_returnable"] == 1,
            F.concat(
                F.lit("Product category '"), _text(df, "category", "None"),
                F.lit("' is marked non-returnable. Return policy does not allow returns for this item."),
            ),
        ),
        (
            "R0_OUT_OF_WINDOW",
            v["within_return_window"] == 0,
            F.concat(
                F.lit("Return requested outside the "), _text(df, "return_window_days", "?"),
                F.lit("-day return window. Days since delivery: "),
                _text(df, "days_since_delivered", "?"), F.lit("."),
            ),
        ),
        (
            "R1",
            (v["reason_category"] == "not_delivered") & (v["days_since_delivered"] >= 0),
            F.lit("Customer claims non-delivery but scan exists."),
        ),
        (
            "R3",
            (v["returns_last_30d"] >= p.multiple_returns)
            & (v["order_value_ratio"] > p.high_value_ratio),
            F.concat(
                v["returns_last_30d"].cast("bigint").cast("string"),
                F.lit(" recent returns with high value ratio."),
            ),
        ),
        (
            "R4",
            (v["return_to_order_ratio"] < p.trusted_ratio)
            & (v["returns_last_30d"] >= p.spike_returns),
            F.lit("Historically trusted account with sudden spike in returns."),
        ),
        (
            "R5",
            (v["days_left_to_return"] == 0) & (v["total_returns_at_time"] >= p.multiple_returns),
            F.lit("Repeatedly returning items on the last eligible day."),
        ),
        (
            "R6",
            (v["account_age_days"] < p.new_account_age) & (v["order_value"] > p.high_value),
            F.lit("New account placing unusually high-value order."),
        ),
        (
            "R7",
            v["seller_return_rate"] > p.seller_return_rate,
            F.concat(
                F.lit("Seller has a suspiciously high return rate ("),
                percent_text(v["seller_return_rate"]), F.lit(")."),
            ),
        ),
        (
            "R8",
            v["shared_device_flag"] == 1,
            F.lit("Device linked to multiple accounts (potential farming/collusion)."),
        ),
        (
            "R9",
            all_of(
                [
                    v["category"].isin(*WARDROBE_CATEGORIES),
                    v["order_value_ratio"] >= 1.0,
                    v["discount_pct"] > 0,
                    v["reason_category"].isin(*WARDROBE_REASONS),
                ]
            ),
            F.lit("Discounted lifestyle item returned for fit/preference."),
        ),
    ]
    # R2, R10 and R11 need evidence outside the tables; a caller may supply a flag.
    for rule_id in ("R2", "R10", "R11"):
        if rule_id in flags:
            rules.append((rule_id, F.col(flags[rule_id]) == 1, F.lit(RULE_NAMES[rule_id] + ".")))
    return rules


def with_rules(
    df: DataFrame, params: RuleParams = RuleParams(), flags: dict[str, str] | None = None
) -> DataFrame:
    """Add triggered_rules, rule_score, hard_rule_triggered, total_rules_checked,
    rules_triggered_count.

    flags: rule id -> 0/1 column for the rules the tables cannot decide.
    """
    df = nan_to_null(df)
    hits = []
    for rule_id, condition, description in _rules(df, params, flags or {}):
        hit = F.struct(
            F.lit(rule_id).alias("rule_id"),
            F.lit(RULE_NAMES[rule_id]).alias("rule_name"),
            description.alias("description"),
            F.lit(params.weights[rule_id]).alias("score"),
        )
        hits.append(F.when(F.coalesce(condition, F.lit(False)), hit))
    soft = [r for r in params.weights if not r.startswith("R0_")]
    soft_max = sum(params.weights[r] for r in soft)
    df = df.withColumn(
        "triggered_rules",
        F.filter(F.array(*hits), lambda h: h.isNotNull()).cast(f"array<{RULE_HIT.simpleString()}>"),
    )
    rules = F.col("triggered_rules")
    hard = F.exists(rules, lambda h: h["rule_id"].startswith("R0_"))
    soft_sum = F.aggregate(
        rules,
        F.lit(0.0),
        lambda total, h: total + F.when(h["rule_id"].startswith("R0_"), 0.0).otherwise(h["score"]),
    )
    return df.withColumns(
        {
            "hard_rule_triggered": hard.cast("int"),
            "rule_score": F.when(hard, 1.0).otherwise(F.least(soft_sum / soft_max, F.lit(1.0))),
            "total_rules_checked": F.lit(len(params.weights)),
            "rules_triggered_count": F.size(rules),
        }
    )


def rule_hits(scored: DataFrame) -> DataFrame:
    """One row per case and triggered rule."""
    return scored.select("return_id", F.inline("triggered_rules"))


def rule_summary(scored: DataFrame) -> DataFrame:
    """How many cases each rule fired on, and its share of all cases.

    Every case adds one mark besides its hits, so the total comes from the same pass.
    """
    marks = F.concat(
        F.array(F.lit("")), F.transform("triggered_rules", lambda h: h["rule_id"])
    )
    counts = (
        scored.select(F.explode(marks).alias("rule_id"))
        .groupBy("rule_id")
        .agg(F.count(F.lit(1)).alias("cases"))
    )
    # One row per rule.
    total = F.max(F.when(F.col("rule_id") == "", F.col("cases"))).over(Window.partitionBy())
    return counts.withColumn("share", ratio(F.col("cases"), total)).where("rule_id <> ''")


def fired(rule_id: str) -> Column:
    return F.exists("triggered_rules", lambda h: h["rule_id"] == rule_id)
