"""From stored tables to decided cases in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelwise.config import PolicyParams, RuleParams, ScoringParams
from parcelwise.functions.columns import yes
from parcelwise.operators.features import full_features
from parcelwise.operators.policy import (
    boundary_escalation, decide, deciding_signal, risk_band, same_item_burst, trusted_override,
)
from parcelwise.operators.rules import fired, with_rules
from parcelwise.operators.scoring import combined_score
from parcelwise.operators.text import case_columns, dossier_text
from parcelwise.sources.schema import Tables

PHOTO_REASONS = ["damaged", "quality_issue", "wrong_item"]
REQUIRED = [
    "return_id", "order_id", "user_id", "product_id", "seller_id", "order_value",
    "return_request_date", "order_date", "delivery_date", "category", "reason_category",
]


def cases(
    tables: Tables, hot: DataFrame | None = None, rules: RuleParams = RuleParams()
) -> DataFrame:
    """Every return with features and rule hits."""
    return with_rules(full_features(tables, hot), rules)


def case_faults(df: DataFrame) -> Column:
    """Names of what makes a row unfit for triage, comma separated; empty when valid."""
    faults = [F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in REQUIRED]
    faults += [
        F.when(F.col("delivery_date") < F.col("order_date"), "delivered before order"),
        F.when(F.col("return_request_date") < F.col("delivery_date"), "returned before delivery"),
        F.when(F.col("order_value") <= 0, "no value"),
    ]
    return F.array_join(F.filter(F.array(*faults), lambda f: f.isNotNull()), ",")


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their faults; one bad row stops nothing."""
    checked = df.withColumn("faults", case_faults(df))
    return checked.where("faults = ''").drop("faults"), checked.where("faults <> ''")


BURST_KEYS = ["user_id", "product_id", "return_request_date"]


def burst_days(requests: DataFrame, policy: PolicyParams = PolicyParams()) -> DataFrame:
    """Users, products and days with a burst of returns of one item: few rows."""
    return same_item_burst(requests, policy).where("burst = 1").select(BURST_KEYS)


def with_signals(df: DataFrame, confidence: Column, bursts: DataFrame | None = None) -> DataFrame:
    """Policy inputs of `decide` from features, rule hits and a risk_score column.

    bursts: stored rows of `burst_days`; without them they are found among the cases,
    which then must hold all returns of their users.
    """
    marked = (burst_days(df) if bursts is None else bursts).withColumn("burst", F.lit(1))
    df = df.join(marked, BURST_KEYS, "left")
    needs_photo = F.col("reason_category").isin(*PHOTO_REASONS)
    flags = {
        "confidence": confidence,
        "r1": yes(fired("R1")),
        "r3": yes(fired("R3")),
        "r4": yes(fired("R4")),
        "policy_violation": F.col("hard_rule_triggered"),
        "policy_ok": 1 - F.col("hard_rule_triggered"),
        "policy_ambiguous": yes(F.col("days_since_delivered") == F.col("return_window_days") + 1),
        "evidence_missing": yes(needs_photo & (F.col("image_uploaded") == 0)),
        "evidence_inconsistent": yes(
            (F.col("reason_category") == "not_delivered") & (F.col("image_uploaded") == 1)
        ),
        "behaviour_flags": yes(fired("R5")) + yes(fired("R6")) + yes(fired("R7")),
        "text_flag": yes(F.col("reason_category") == "changed_mind"),
        "burst": yes(F.col("burst") == 1),
        "rule_escalation": yes(
            fired("R1") | fired("R2") | fired("R4") | fired("R8") | F.col("burst").isNotNull()
        ),
    }
    out = df.withColumns(flags)
    return out.withColumn("hard_signals", F.col("r1") + F.col("r3"))


def decide_cases(
    df: DataFrame,
    policy: PolicyParams = PolicyParams(),
    scoring: ScoringParams = ScoringParams(),
) -> DataFrame:
    """Verdict, band, deciding signal and overrides for cases with signals."""
    return decide(df, policy).withColumns(
        {
            "combined_score": combined_score(F.col("risk_score"), F.col("rule_score"), scoring),
            "risk_band": risk_band(F.col("risk_score"), policy),
            "deciding_signal": deciding_signal(policy),
            "trusted_override": trusted_override(policy),
            "boundary_escalation": boundary_escalation(policy),
        }
    )


def final_verdict(df: DataFrame) -> DataFrame:
    """Apply the two account rules on top of `decide_cases`.

    A one-day-late request of a trusted account goes to a person. A trusted account
    whose only flag is minor is approved when no escalation condition holds, also below
    the confidence for other automatic decisions, which the flag itself lowers.
    """
    late = F.col("boundary_escalation") == 1
    trusted = (
        (F.col("trusted_override") == 1)
        & (F.col("policy_ok") == 1)
        & (F.col("escalation_count") == 0)
    )
    return df.withColumn(
        "verdict",
        F.when(late, "Escalate").when(trusted, "Auto-Approve").otherwise(F.col("verdict")),
    )


def with_dossier(df: DataFrame) -> DataFrame:
    """Add policy clause, reasoning, evidence and, for escalated cases, the dossier.

    A retrieved_clause of `case_policies` follows the eligibility in the policy clause.
    """
    fired_ids = F.array_join(F.transform("triggered_rules", lambda h: h["rule_id"]), ",")
    policy = F.when(F.col("policy_violation") == 1, "return eligibility: not met").otherwise(
        "return eligibility: met"
    )
    if "retrieved_clause" in df.columns:
        cited = F.concat(F.lit(" ["), F.col("policy_source").cast("string"), F.lit("] "), F.col("retrieved_clause"))
        policy = F.concat(policy, F.coalesce(cited, F.lit("")))
    reasoning = F.concat(
        F.lit("Decided by "), F.col("deciding_signal"), F.lit("; risk band "), F.col("risk_band"),
        F.lit("; rules "), F.when(fired_ids == "", "none").otherwise(fired_ids), F.lit("."),
    )
    df = df.withColumns({"policy_clause": policy, "evidence": fired_ids, "reasoning": reasoning})
    df = df.withColumn("evidence", F.concat(F.lit("rules:"), F.col("evidence")))
    return df.withColumn(
        "dossier", F.when(F.col("verdict") == "Escalate", dossier_text(df))
    )


def one_case(df: DataFrame, return_id: str) -> DataFrame:
    """The plan restricted to one return; ValueError if there is none."""
    found = df.where(F.col("return_id") == return_id)
    if found.isEmpty():
        raise ValueError(f"return id '{return_id}' not found")
    return found


def restrict_to(tables: Tables, batch: DataFrame) -> Tables:
    """Tables with the returns of only those users who are in the batch (return_id).

    History windows need all returns of these users and of nobody else.
    """
    users = (
        tables.returns.join(batch.select("return_id"), "return_id", "left_semi")
        .join(tables.orders.select("order_id", "user_id"), "order_id")
        .select("user_id")
        .distinct()
    )
    orders = tables.orders.join(users, "user_id", "left_semi")
    returns = tables.returns.join(orders.select("order_id"), "order_id", "left_semi")
    return Tables(
        tables.users, tables.sellers, tables.products, orders, returns, tables.lookups
    )


def case_record_fields(df: DataFrame) -> list[str]:
    hidden = {"triggered_rules", "attributions", "dossier", "reasoning"}
    return [c for c in case_columns(df) if c not in hidden]

