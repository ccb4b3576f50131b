"""Verdicts, overrides and pattern checks."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from parcelwise.operators import policy

BASE = dict(
    risk_score=0.1, confidence=0.99, order_value=100.0, evidence_missing=0, evidence_inconsistent=0,
    policy_ambiguous=0, policy_violation=0, policy_ok=1, hard_signals=0, behaviour_flags=0, text_flag=0, rule_escalation=0,
)


def one(spark, **change):
    rows = [{**BASE, **change}, BASE]  # the second row gives columns of null their type
    return spark.createDataFrame(rows).limit(1)


@pytest.mark.parametrize(
    "change, verdict",
    [
        ({}, "Auto-Approve"),
        ({"risk_score": 0.2999}, "Auto-Approve"),
        ({"risk_score": 0.30}, "Escalate"),
        ({"risk_score": 0.70}, "Escalate"),
        ({"risk_score": 0.71}, "Escalate"),  # a high score alone never rejects
        ({"risk_score": 0.71, "hard_signals": 2}, "Auto-Reject"),
        ({"risk_score": 0.71, "hard_signals": 2, "confidence": 0.95}, "Escalate"),
        ({"risk_score": 0.71, "hard_signals": 1}, "Escalate"),
        ({"risk_score": 0.71, "hard_signals": 1, "policy_violation": 1}, "Auto-Reject"),
        ({"policy_violation": 1, "policy_ok": 0}, "Auto-Reject"),
        ({"policy_violation": 1, "policy_ok": 0, "confidence": 0.69}, "Escalate"),
        ({"policy_violation": 1, "policy_ok": 0, "confidence": 0.95}, "Escalate"),
        ({"policy_violation": 1, "policy_ok": 0, "risk_score": 0.5}, "Escalate"),
        ({"policy_violation": 1, "policy_ok": 0, "rule_escalation": 1}, "Escalate"),
        ({"risk_score": 0.71, "hard_signals": 2, "rule_escalation": 1}, "Escalate"),
        ({"rule_escalation": 1}, "Escalate"),
        ({"confidence": None}, "Escalate"),
        ({"confidence": 0.95}, "Escalate"),
        ({"confidence": 0.6999}, "Escalate"),
        ({"evidence_missing": 1}, "Escalate"),
        ({"evidence_inconsistent": 1}, "Escalate"),
        ({"policy_ambiguous": 1, "policy_violation": 1}, "Escalate"),
        ({"policy_ok": 0}, "Escalate"),
    ],
)
def test_verdict(spark, change, verdict):
    assert policy.decide(one(spark, **change)).first()["verdict"] == verdict


def test_high_value_without_evidence_counts_twice(spark):
    row = policy.decide(one(spark, order_value=50_000.01, evidence_missing=1)).first()
    assert row["escalation_count"] == 2


@pytest.mark.parametrize(
    "change, signal",
    [
        ({"policy_violation": 1, "hard_signals": 1}, "policy"),
        ({"hard_signals": 1, "risk_score": 0.9}, "metadata"),
        ({"risk_score": 0.3, "evidence_missing": 1}, "model"),
        ({"evidence_inconsistent": 1, "behaviour_flags": 1}, "evidence"),
        ({"behaviour_flags": 2, "text_flag": 1}, "behaviour"),
        ({"text_flag": 1}, "text"),
        ({}, "none"),
    ],
)
def test_deciding_signal(spark, change, signal):
    assert one(spark, **change).select(policy.deciding_signal().alias("s")).first()["s"] == signal


TRUSTED = dict(
    account_age_days=1096, return_to_order_ratio=0.049, past_fraud=0, order_value=9999.99, text_flag=1,
    behaviour_flags=0, risk_score=0.29, r1=0, r3=0, r4=0, days_since_delivered=8, return_window_days=7,
)


@pytest.mark.parametrize(
    "change, allowed",
    [
        ({}, 1), ({"account_age_days": 1095}, 0), ({"return_to_order_ratio": 0.05}, 0),
        ({"past_fraud": 1}, 0), ({"order_value": 10000.0}, 0), ({"risk_score": 0.30}, 0),
        ({"r1": 1}, 0), ({"r3": 1}, 0), ({"r4": 1}, 0), ({"behaviour_flags": 1}, 0), ({"text_flag": 0}, 0),
    ],
)
def test_trusted_override(spark, change, allowed):
    df = spark.createDataFrame([{**TRUSTED, **change}])
    assert df.select(policy.trusted_override().alias("o")).first()["o"] == allowed


@pytest.mark.parametrize(
    "change, late", [({}, 1), ({"days_since_delivered": 7}, 0), ({"days_since_delivered": 9}, 0), ({"past_fraud": 2}, 0)]
)
def test_one_day_late(spark, change, late):
    df = spark.createDataFrame([{**TRUSTED, **change}])
    assert df.select(policy.boundary_escalation().alias("b")).first()["b"] == late


def test_bands(spark):
    df = spark.createDataFrame([(0.29,), (0.3,), (0.7,), (0.71,)], "s double")
    got = [r["b"] for r in df.select(policy.risk_band(F.col("s")).alias("b")).collect()]
    assert got == ["low", "ambiguous", "ambiguous", "high"]
    df = spark.createDataFrame([(0.19,), (0.2,), (0.85,), (0.86,)], "s double")
    got = [r["b"] for r in df.select(policy.score_only_band(F.col("s")).alias("b")).collect()]
    assert got == ["Auto-Approve", "Escalate", "Escalate", "Auto-Reject"]
    df = spark.createDataFrame([(0.951,), (0.95,), (0.7,), (0.69,)], "s double")
    got = [r["b"] for r in df.select(policy.confidence_band(F.col("s")).alias("b")).collect()]
    assert got == ["auto", "validate", "validate", "human"]


def test_same_item_burst(spark):
    start = date(2024, 1, 1)
    rows = [(1, 9, start + timedelta(days=d), 20000.0) for d in (0, 0, 6, 7, 30)]
    rows += [(1, 9, start, 5000.0)] * 5 + [(2, 9, start, 20000.0)] * 3
    df = spark.createDataFrame(rows, "user_id long, product_id long, return_request_date date, order_value double")
    got = {
        (r["user_id"], r["return_request_date"].day): (r["units"], r["units_in_window"], r["burst"])
        for r in policy.same_item_burst(df).collect()
    }
    assert got == {
        (1, 1): (2, 2, 0), (1, 7): (1, 3, 1), (1, 8): (1, 2, 0), (1, 31): (1, 1, 0), (2, 1): (3, 3, 1)
    }


def test_audit_check(spark):
    row = dict(return_id="a", verdict="Escalate", policy_clause="p", risk_score=0.5, evidence="e", reasoning="r", dossier="d")
    rows = [row, {**row, "dossier": " "}, {**row, "verdict": "Auto-Reject", "dossier": ""}, {**row, "reasoning": "", "evidence": ""}]
    got = [r["missing_fields"] for r in policy.audit_check(spark.createDataFrame(rows)).collect()]
    assert got == ["", "dossier", "", "evidence,reasoning"]
