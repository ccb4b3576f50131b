"""Canonical tables of the returns model and their join keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

LOOKUP = {
    name: T.StructType([T.StructField(f"{key}_id", T.LongType()), T.StructField(f"{key}_name", T.StringType())])
    for name, key in {
        "reason_categories": "reason_category",
        "return_types": "return_type",
        "fraud_types": "fraud",
        "label_types": "label",
        "product_categories": "product_category",
        "seller_types": "seller_type",
        "bucket_types": "bucket_type",
        "verdict_types": "verdict_type",
    }.items()
}

RULE_HIT = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

ATTRIBUTION = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("contribution", T.DoubleType()),
        T.StructField("direction", T.StringType()),
    ]
)

DECISION_LOG = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("return_id", T.StringType()),
        T.StructField(
            "inputs",
            T.StructType(
                [
                    T.StructField("case_data", T.StringType()),
                    T.StructField("risk_score", T.DoubleType()),
                    T.StructField("attributions", T.ArrayType(ATTRIBUTION)),
                    T.StructField("rule_score", T.DoubleType()),
                    T.StructField("triggered_rules", T.ArrayType(RULE_HIT)),
                ]
            ),
        ),
        T.StructField(
            "outputs",
            T.StructType(
                [
                    T.StructField("verdict", T.StringType()),
                    T.StructField("confidence", T.StringType()),
                    T.StructField("reasoning_chain", T.StringType()),
                ]
            ),
        ),
    ]
)


#: A column of the returns that goes with them through the star join: their stored risk.
RISK = "_risk_score"


@dataclass(frozen=True)
class Tables:
    """The stored tables every triage operator starts from. parts: partitions for shuffles of
    whole tables, where there are too many rows to leave their number to the session."""

    users: DataFrame
    sellers: DataFrame
    products: DataFrame
    orders: DataFrame
    returns: DataFrame
    lookups: dict[str, DataFrame]
    parts: int | None = None
