"""Parameters of the triage operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# Rule weights, thresholds, score weights, feature names, lookup
# values and formats below must equal the source data model for equal results.

RULE_WEIGHTS = {
    "R0_NON_RETURNABLE": 50.0,
    "R0_OUT_OF_WINDOW": 50.0,
    "R1": 15.0,
    "R2": 15.0,
    "R3": 15.0,
    "R4": 15.0,
    "R5": 10.0,
    "R6": 10.0,
    "R7": 10.0,
    "R8": 20.0,
    "R9": 15.0,
    "R10": 20.0,
    "R11": 20.0,
}

RULE_NAMES = {
    "R0_NON_RETURNABLE": "Non-Returnable Product",
    "R0_OUT_OF_WINDOW": "Outside Return Window",
    "R1": "Delivery Proof Contradiction",
    "R2": "Attribute Mismatch",
    "R3": "Multiple High-Value Returns",
    "R4": "Sudden Behavior Change",
    "R5": "Return Window Manipulation",
    "R6": "New Account, High-Value",
    "R7": "High Seller Fraud Rate",
    "R8": "Shared Device Across Accounts",
    "R9": "Discount-Driven High-Value Return",
    "R10": "Logistics Fraud",
    "R11": "Duplicate Image Evidence",
}

WARDROBE_CATEGORIES = ["Clothing", "Footwear", "Beauty"]
WARDROBE_REASONS = ["not_fit", "quality_issue"]

USER_FEATURES = [
    "account_age_days", "email_verified", "shared_device_flag",
    "total_orders_at_time", "total_returns_at_time", "return_to_order_ratio",
    "days_since_last_return", "returns_last_30d", "returns_last_90d",
    "return_frequency_score",
]
ORDER_FEATURES = [
    "order_value", "is_prepaid", "discount_pct", "days_since_delivered",
    "user_avg_order_value", "order_value_ratio",
]
PRODUCT_FEATURES = ["price", "is_non_returnable", "review_count", "category_base_defect"]
SELLER_FEATURES = [
    "seller_age_days", "seller_rating", "seller_return_rate", "seller_customer_frequency",
]
RETURN_FEATURES = [
    "within_return_window", "days_left_to_return", "image_uploaded",
    "high_value_return_ratio", "same_category_return_ratio", "seller_repeat_ratio",
    "weekend_return_ratio", "requires_manual_verification",
]
NUMERIC_FEATURES = (
    USER_FEATURES + ORDER_FEATURES + PRODUCT_FEATURES + SELLER_FEATURES + RETURN_FEATURES
)
CATEGORICAL_FEATURES = ["category", "reason_category", "return_type"]
ALL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES

CATEGORY_DEFECT_RATE = {
    "Electronics": 0.04, "Clothing": 0.02, "Books": 0.01, "Appliances": 0.06,
    "Footwear": 0.03, "Beauty": 0.02, "Furniture": 0.05, "Sports": 0.03,
    "Toys": 0.04, "Grocery": 0.08,
}

FRAUD_SCORE_WEIGHTS = {
    "return_to_order_ratio": 2.5,
    "high_value_ratio": 1.8,
    "new_account": 1.2,
    "no_image": 1.0,
    "seller_repeat_ratio": 1.5,
    "high_return_freq": 2.0,
    "early_return": 0.8,
    "unverified_account": 0.7,
    "changed_mind_reason": 0.5,
    "shared_device": 0.7,
    "high_discount": 0.4,
}
FRAUD_SCORE_NORMALIZATION = {
    "rtor_saturation": 0.50,
    "value_ratio_saturation": 2.0,
    "age_saturation_days": 730,
    "freq_saturation_returns": 5,
    "early_return_days": 2,
    "high_discount_floor": 0.30,
}
FRAUD_SCORE_NOISE_SCALE = 0.90
FRAUD_TARGET_RATIO = 0.40

POSITIVE_LABELS = ["fraud", "1"]

# Probe plan: bucket -> (target count, expected verdict).
PROBE_TARGETS = {
    "R1": 5, "R2": 5, "R3": 5, "R4": 5, "R5": 4, "R6": 4, "R7": 4, "R8": 4, "R9": 5,
    "trusted_override": 5, "override_excluded": 4, "one_day_late": 4, "item_swap": 3,
    "deceptive_image": 3, "non_returnable": 3, "sarcasm": 3,
    "clean_legitimate": 5, "clean_fraud": 5,
}

HELPER_COLUMN_PREFIXES = (
    "prev_", "past_", "is_same_", "is_high_value", "is_weekend", "account_creation", "_",
)


@dataclass(frozen=True)
class RuleParams:
    new_account_age: int = 120
    high_value: float = 10_000.0
    high_value_ratio: float = 1.5
    multiple_returns: int = 3
    trusted_ratio: float = 0.05
    spike_returns: int = 5
    seller_return_rate: float = 0.15
    weights: dict = field(default_factory=lambda: dict(RULE_WEIGHTS))


@dataclass(frozen=True)
class PolicyParams:
    low_risk: float = 0.30
    high_risk: float = 0.70
    auto_approve_max: float = 0.20
    auto_reject_min: float = 0.85
    auto_confidence: float = 0.95
    min_confidence: float = 0.70
    evidence_value: float = 50_000.0
    trusted_age_days: int = 3 * 365
    trusted_ratio: float = 0.05
    trusted_value: float = 10_000.0
    burst_units: int = 3
    burst_days: int = 7
    last_day_repeats: int = 3


@dataclass(frozen=True)
class ScoringParams:
    model_weight: float = 0.60
    rule_weight: float = 0.40
    noise_scale: float = FRAUD_SCORE_NOISE_SCALE
    target_ratio: float = FRAUD_TARGET_RATIO
    top_features: int = 10


@dataclass(frozen=True)
class RetrievalParams:
    k1: float = 1.5
    b: float = 0.75
    negative_idf_share: float = 0.25
    lexical_candidates: int = 20
    vector_candidates: int = 20
    rrf_k: int = 60
    top_k: int = 5
    max_chunk_size: int = 500
    label_chars: int = 80


@dataclass(frozen=True)
class ModelParams:
    rounds: int = 300
    step: float = 0.05
    depth: int = 7
    row_share: float = 0.8
    feature_share: float = 0.8
    seed: int = 42
    max_bins: int = 64
