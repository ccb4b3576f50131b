"""Verdicts from risk, policy and evidence signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelwise.config import PolicyParams
from parcelwise.functions.columns import all_of, any_of, ratio, yes
from parcelwise.operators.scale import Timeline

APPROVE, REJECT, ESCALATE = "Auto-Approve", "Auto-Reject", "Escalate"


def risk_band(score: Column, p: PolicyParams = PolicyParams()) -> Column:
    return (
        F.when(score < p.low_risk, "low").when(score > p.high_risk, "high").otherwise("ambiguous")
    )


def score_only_band(score: Column, p: PolicyParams = PolicyParams()) -> Column:
    """The alternative bands that decide on the combined score alone."""
    return (
        F.when(score < p.auto_approve_max, APPROVE)
        .when(score > p.auto_reject_min, REJECT)
        .otherwise(ESCALATE)
    )


def confidence_band(confidence: Column, p: PolicyParams = PolicyParams()) -> Column:
    return (
        F.when(confidence > p.auto_confidence, "auto")
        .when(confidence >= p.min_confidence, "validate")
        .otherwise("human")
    )


def escalation_reasons(p: PolicyParams = PolicyParams()) -> list[Column]:
    """The eight conditions that send a case to a person.

    Columns: risk_score, confidence, order_value, and 0/1 flags evidence_missing,
    evidence_inconsistent, policy_ambiguous, policy_violation, rule_escalation (a rule
    fired that only a person may settle); hard_signals counts confirmed hard fraud signals.
    """
    risk = F.col("risk_score")
    return [
        (risk >= p.low_risk) & (risk <= p.high_risk),
        F.col("evidence_missing") == 1,
        F.col("policy_ambiguous") == 1,
        (F.col("order_value") > p.evidence_value) & (F.col("evidence_missing") == 1),
        F.col("evidence_inconsistent") == 1,
        F.col("confidence") < p.min_confidence,
        (F.col("hard_signals") == 1) & (F.col("policy_violation") == 0),
        F.col("rule_escalation") == 1,
    ]


def decide(df: DataFrame, p: PolicyParams = PolicyParams()) -> DataFrame:
    """Add escalation_count and verdict.

    In this order: any escalation condition goes to a person; so does whatever is not
    above the confidence for automatic decisions. Then a confirmed policy violation
    rejects at any risk, since no score outweighs eligibility; a high score rejects
    only with two hard signals; low risk with satisfied policy approves. The rest is
    left to a person.
    """
    reasons = [yes(r) for r in escalation_reasons(p)]
    count = sum(reasons[1:], reasons[0])
    corroborated = all_of(
        [
            F.col("risk_score") > p.high_risk,
            F.col("hard_signals") >= 2,
        ]
    )
    clear = all_of([F.col("risk_score") < p.low_risk, F.col("policy_ok") == 1])
    sure = yes(F.col("confidence") > p.auto_confidence)
    verdict = (
        F.when((count > 0) | (sure == 0), ESCALATE)
        .when(F.col("policy_violation") == 1, REJECT)
        .when(corroborated, REJECT)
        .when(clear, APPROVE)
        .otherwise(ESCALATE)
    )
    return df.withColumns({"escalation_count": count, "verdict": verdict})


def deciding_signal(p: PolicyParams = PolicyParams()) -> Column:
    """The strongest evidence present, in order of precedence."""
    ranked = [
        (F.col("policy_violation") == 1, "policy"),
        (F.col("hard_signals") > 0, "metadata"),
        (F.col("risk_score") >= p.low_risk, "model"),
        (any_of([F.col("evidence_missing") == 1, F.col("evidence_inconsistent") == 1]), "evidence"),
        (F.col("behaviour_flags") > 0, "behaviour"),
        (F.col("text_flag") == 1, "text"),
    ]
    return F.coalesce(*[F.when(c, name) for c, name in ranked], F.lit("none"))


def trusted_account(p: PolicyParams = PolicyParams()) -> Column:
    return all_of(
        [
            F.col("account_age_days") > p.trusted_age_days,
            F.col("return_to_order_ratio") < p.trusted_ratio,
            F.col("past_fraud") == 0,
            F.col("order_value") < p.trusted_value,
        ]
    )


def trusted_override(p: PolicyParams = PolicyParams()) -> Column:
    """1 where a trusted account may be approved despite one minor flag.

    Excluded: rules R1 or R3 fired, a sudden spike (R4), value at the limit or
    above, risk outside the low band.
    """
    excluded = any_of([F.col("r1") == 1, F.col("r3") == 1, F.col("r4") == 1])
    return yes(
        all_of(
            [
                trusted_account(p),
                F.col("text_flag") == 1,
                F.col("behaviour_flags") == 0,
                F.col("risk_score") < p.low_risk,
                ~excluded,
            ]
        )
    )


def boundary_escalation(p: PolicyParams = PolicyParams()) -> Column:
    """1 where the window was missed by one day by a trusted account."""
    late_by_one = F.col("days_since_delivered") == F.col("return_window_days") + 1
    return yes(all_of([late_by_one, trusted_account(p)]))


def same_item_burst(df: DataFrame, p: PolicyParams = PolicyParams()) -> DataFrame:
    """Returned units of one high-value product by one user in a short window.

    Counted per (user, product, day) first, so a window holds days, not returns.
    """
    daily = (
        df.where(F.col("order_value") > p.trusted_value)
        .groupBy("user_id", "product_id", "return_request_date")
        .agg(F.count(F.lit(1)).alias("units"))
    )
    days = F.expr(
        "sum(units) over (partition by user_id, product_id order by return_request_date "
        f"range between {p.burst_days - 1} preceding and current row)"
    )
    return daily.withColumn("units_in_window", days).withColumn(
        "burst", yes(F.col("units_in_window") >= p.burst_units)
    )


def last_day_pattern(
    df: DataFrame, p: PolicyParams = PolicyParams(), hot: DataFrame | None = None
) -> DataFrame:
    """Add how often the user returned on the last eligible day before, and a flag."""
    order = ["return_request_date", "order_date", "return_id"]
    last_day = yes((F.col("days_left_to_return") == 0) & (F.col("within_return_window") == 1))
    t = Timeline.of(df.withColumn("is_last_day", last_day), ["user_id"], order, order[:2], hot)
    out = t.before(sums={"prior_last_day": F.col("is_last_day").cast("bigint")}).result()
    repeated = F.col("prior_last_day") + F.col("is_last_day") >= p.last_day_repeats
    return out.withColumn("last_day_pattern", yes((F.col("is_last_day") == 1) & repeated))


def pair_concentration(df: DataFrame) -> DataFrame:
    """Returns per user and seller, and their share of the user's and seller's returns."""
    pairs = df.groupBy("user_id", "seller_id").agg(F.count(F.lit(1)).alias("pair_returns"))
    users = pairs.groupBy("user_id").agg(F.sum("pair_returns").alias("user_returns"))
    sellers = pairs.groupBy("seller_id").agg(F.sum("pair_returns").alias("seller_returns"))
    return (
        pairs.join(users, "user_id")
        .join(sellers, "seller_id")
        .withColumns(
            {
                "share_of_user": ratio(F.col("pair_returns"), F.col("user_returns")),
                "share_of_seller": ratio(F.col("pair_returns"), F.col("seller_returns")),
            }
        )
    )


AUDIT_FIELDS = ["verdict", "policy_clause", "risk_score", "evidence", "reasoning"]


def audit_check(df: DataFrame) -> DataFrame:
    """Add the names of required audit fields a decision lacks, and a 0/1 result.

    Escalated cases need a dossier too.
    """

    def missing(name: str) -> Column:
        value = F.col(name).cast("string")
        return F.coalesce(F.trim(value) == "", F.lit(True))

    gaps = [F.when(missing(name), name) for name in AUDIT_FIELDS]
    gaps.append(F.when((F.col("verdict") == ESCALATE) & missing("dossier"), "dossier"))
    names = F.array_join(F.filter(F.array(*gaps), lambda g: g.isNotNull()), ",")
    return df.withColumn("missing_fields", names).withColumn(
        "complete", yes(F.col("missing_fields") == "")
    )


def probe_eval(cases: DataFrame, targets: DataFrame) -> DataFrame:
    """Cases per probe bucket against the target, and how many got the expected verdict.

    cases: bucket, expected_verdict, verdict. targets: bucket, target.
    """
    found = cases.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("cases"),
        F.sum(yes(F.col("verdict") == F.col("expected_verdict")).cast("bigint")).alias("as_expected"),
    )
    counts = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("cases", "as_expected")}
    joined = targets.join(found, "bucket", "left").withColumns(counts)
    return joined.withColumn("covered", yes(F.col("cases") >= F.col("target")))
