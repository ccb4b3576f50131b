"""The same queries as plain SQL on the raw tables, written in other ways.

Windows are stated as self-joins, splits and curves as global rankings, parsers by
their expected outcome. CTES name the shared parts; `sql` adds those a query needs.
"""

from __future__ import annotations

import re

from parcelwise.config import (
    ALL_FEATURES, CATEGORICAL_FEATURES, CATEGORY_DEFECT_RATE, NUMERIC_FEATURES,
    FRAUD_SCORE_NORMALIZATION as N,
    FRAUD_SCORE_WEIGHTS as W, PROBE_TARGETS, RULE_WEIGHTS,
)
from parcelwise.functions.columns import WHITESPACE
from parcelwise.sources.mart import (
    CATEGORIES, CATEGORY_OF_TYPE, EVIDENCE_MARKS, FRAUD_TYPES, LABEL_THRESHOLD, LONG_WINDOW, REASONS, SELLER_TYPES, VERDICT_MARKS,
)


def pick(expr: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {cases} END"


def d(value) -> str:
    return f"CAST({value!r} AS DOUBLE)"


RATE = "CASE category " + " ".join(
    f"WHEN '{c}' THEN {d(r)}" for c, r in CATEGORY_DEFECT_RATE.items()
) + " END"

ORDER_COLUMNS = """
  CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
    || '-' || strftime(l_shipdate, '%Y-%m-%d') AS order_id,
  o_custkey AS user_id, l_suppkey AS seller_id, l_partkey AS product_id,
  CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS value_e4,
  CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS BIGINT) AS is_prepaid,
  CAST(round(l_discount * 100) AS DOUBLE) AS discount_pct,
  CAST(o_orderdate AS DATE) AS order_date,
  CAST(CAST(o_orderdate AS DATE) + CAST(2 + (l_linenumber + l_partkey) % 6 AS INTEGER) AS DATE) AS delivery_date,
  CAST(l_returnflag = 'R' AS BIGINT) AS is_returned
"""

PRIOR = "(b.return_request_date, b.order_date, b.return_id) < (a.return_request_date, a.order_date, a.return_id)"
WALK = "(b.order_date, b.return_request_date, b.return_id) < (a.order_date, a.return_request_date, a.return_id)"


def _score() -> str:
    one = "CAST(1 AS DOUBLE)"
    signals = {
        "return_to_order_ratio": f"least(rtor / {d(N['rtor_saturation'])}, {one})",
        "high_value_ratio": f"least(greatest((value_ratio - {one}) / {d(N['value_ratio_saturation'])}, CAST(0 AS DOUBLE)), {one})",
        "new_account": f"greatest({one} - CAST(account_age_days AS DOUBLE) / {d(float(N['age_saturation_days']))}, CAST(0 AS DOUBLE))",
        "no_image": f"({one} - CAST(image_uploaded AS DOUBLE))",
        "seller_repeat_ratio": f"least(seller_ratio, {one})",
        "high_return_freq": f"least(CAST(returns_30d_by_order AS DOUBLE) / {d(float(N['freq_saturation_returns']))}, {one})",
        "early_return": f"(CASE WHEN days_since_delivered <= {N['early_return_days']} THEN greatest({one} - CAST(days_since_delivered AS DOUBLE) / {d(float(N['early_return_days']))}, CAST(0 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END)",
        "unverified_account": f"({one} - CAST(email_verified AS DOUBLE))",
        "changed_mind_reason": "CAST(reason_category = 'changed_mind' AS DOUBLE)",
        "shared_device": "CAST(shared_device_flag AS DOUBLE)",
        "high_discount": f"greatest(discount_pct / {d(100.0)} - {d(N['high_discount_floor'])}, CAST(0 AS DOUBLE))",
    }
    return " + ".join(f"{d(W[k])} * {v}" for k, v in signals.items())


def _sigmoid(x: str) -> str:
    return f"CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(greatest(least(-({x}), CAST(50 AS DOUBLE)), CAST(-50 AS DOUBLE))))"


def _hit(rule: str, condition: str, description: str) -> str:
    return (
        f"SELECT return_id, '{rule}' AS rule_id, {description} AS description, "
        f"{d(RULE_WEIGHTS[rule])} AS score FROM m_features WHERE {condition}"
    )


HITS = [
    ("R0_NON_RETURNABLE", "Non-Returnable Product", "is_non_returnable = 1", "'Product category ''' || category || ''' is marked non-returnable. Return policy does not allow returns for this item.'"),
    ("R0_OUT_OF_WINDOW", "Outside Return Window", "within_return_window = 0", "'Return requested outside the ' || return_window_days || '-day return window. Days since delivery: ' || days_since_delivered || '.'"),
    ("R1", "Delivery Proof Contradiction", "reason_category = 'not_delivered' AND days_since_delivered >= 0", "'Customer claims non-delivery but scan exists.'"),
    ("R3", "Multiple High-Value Returns", "returns_last_30d >= 3 AND order_value_ratio > 1.5", "returns_last_30d || ' recent returns with high value ratio.'"),
    ("R4", "Sudden Behavior Change", "return_to_order_ratio < 0.05 AND returns_last_30d >= 5", "'Historically trusted account with sudden spike in returns.'"),
    ("R5", "Return Window Manipulation", "days_left_to_return = 0 AND total_returns_at_time >= 3", "'Repeatedly returning items on the last eligible day.'"),
    ("R6", "New Account, High-Value", "account_age_days < 120 AND order_value > 10000", "'New account placing unusually high-value order.'"),
    ("R7", "High Seller Fraud Rate", "(seller_id * 13) % 55 > 15", "'Seller has a suspiciously high return rate (' || ((seller_id * 13) % 55) || '.0%).'"),
    ("R8", "Shared Device Across Accounts", "shared_device_flag = 1", "'Device linked to multiple accounts (potential farming/collusion).'"),
    ("R9", "Discount-Driven High-Value Return", "category IN ('Clothing', 'Footwear', 'Beauty') AND order_value_ratio >= 1.0 AND discount_pct > 0 AND reason_category IN ('not_fit', 'quality_issue')", "'Discounted lifestyle item returned for fit/preference.'"),
]
RULE_NAME = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{n}'" for r, n, _, _ in HITS) + " END"

CTES: dict[str, str] = {
    "m_users": """
SELECT c_custkey AS user_id, CAST(30 + (c_custkey * 37) % 2471 AS BIGINT) AS account_age_days,
  CAST(c_acctbal >= 0 AS BIGINT) AS email_verified,
  CAST(c_custkey % 16 = 0 AS BIGINT) AS shared_device_flag,
  CAST(DATE '2002-01-01' - CAST(30 + (c_custkey * 37) % 2471 AS INTEGER) AS DATE) AS registration_date,
  CAST(c_nationkey % 10 <> 0 AS BIGINT) AS phone_verified
FROM customer""",
    "m_lines": """
SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "m_value_orders": f"SELECT {ORDER_COLUMNS} FROM m_lines",
    "m_orders": """
SELECT order_id, user_id, seller_id, product_id,
  CAST(value_e4 AS DOUBLE) / CAST(10000 AS DOUBLE) AS order_value,
  is_prepaid, discount_pct, order_date, delivery_date, is_returned
FROM m_value_orders""",
    "m_part": f"""
SELECT p_partkey AS product_id,
  CASE p_type {' '.join(f"WHEN '{t}' THEN '{c}'" for t, c in CATEGORY_OF_TYPE.items())} ELSE 'Furniture' END AS category,
  p_retailprice AS price, CAST(p_size % 25 = 0 AS BIGINT) AS is_non_returnable, CAST(p_size AS BIGINT) AS sku,
  CAST(CASE WHEN p_type IN ({', '.join(f"'{t}'" for t, c in CATEGORY_OF_TYPE.items() if c in LONG_WINDOW)}) THEN 10 ELSE 7 END AS BIGINT) AS return_window_days
FROM part""",
    "m_products": f"""
SELECT product_id, category, price, is_non_returnable,
  CAST((SELECT count(*) FROM lineitem WHERE l_partkey = product_id) AS BIGINT) AS review_count, sku,
  {RATE} AS category_base_defect_rate, return_window_days, {RATE} AS base_defect_rate
FROM m_part""",
    "m_buyers": """
SELECT seller_id, CAST(sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS seller_customer_frequency
FROM (SELECT l_suppkey AS seller_id, o_custkey, count(*) AS n FROM m_lines GROUP BY 1, 2) GROUP BY 1""",
    "m_sellers": f"""
SELECT s_suppkey AS seller_id, CAST(30 + (s_suppkey * 53) % 2471 AS BIGINT) AS seller_age_days,
  1 + CAST(s_suppkey % 41 AS DOUBLE) / CAST(10 AS DOUBLE) AS seller_rating,
  CAST((s_suppkey * 13) % 55 AS DOUBLE) / CAST(100 AS DOUBLE) AS seller_return_rate,
  seller_customer_frequency,
  {pick(f's_suppkey % {len(SELLER_TYPES)}', SELLER_TYPES)} AS seller_type,
  {pick(f's_suppkey % {len(CATEGORIES)}', CATEGORIES)} AS category_specialization,
  1 + CAST(s_suppkey % 41 AS DOUBLE) / CAST(10 AS DOUBLE) AS rating,
  CAST(DATE '2002-01-01' - CAST(30 + (s_suppkey * 53) % 2471 AS INTEGER) AS DATE) AS registration_date
FROM supplier LEFT JOIN m_buyers ON s_suppkey = seller_id""",
    "m_requests": f"""
SELECT r.*, r.order_id AS return_id,
  CAST(delivery_date + days_since_delivered AS DATE) AS return_request_date,
  CAST(days_since_delivered <= return_window_days AS BIGINT) AS within_return_window,
  CAST(greatest(0, return_window_days - days_since_delivered) AS BIGINT) AS days_left_to_return,
  CAST(value_e4 AS DOUBLE) / CAST(10000 AS DOUBLE) AS order_value
FROM (
  SELECT {ORDER_COLUMNS},
    CAST((l_orderkey * 7 + l_partkey * 3 + l_suppkey) % (return_window_days + 4) AS INTEGER) AS days_since_delivered,
    return_window_days, category,
    {pick('(l_orderkey + l_linenumber) % 6', REASONS)} AS reason_category,
    CASE WHEN l_linestatus = 'O' THEN 'refund' ELSE 'replace' END AS return_type,
    CAST((l_orderkey + l_suppkey) % 2 = 0 AS BIGINT) AS image_uploaded,
    {pick(f'(l_orderkey * 5 + l_partkey) % {len(FRAUD_TYPES)}', FRAUD_TYPES)} AS fraud_type,
    CAST((l_orderkey * 7919 + l_partkey * 104729) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) AS label_draw
  FROM m_lines JOIN m_part ON l_partkey = product_id WHERE l_returnflag = 'R') r""",
    "m_asof": """
SELECT r.return_id, CAST(count(*) AS BIGINT) AS total_orders_at_time,
  CAST(sum(o.value_e4) AS DOUBLE) / CAST(10000 AS DOUBLE) AS orders_value_at_time
FROM m_requests r JOIN m_value_orders o
  ON o.user_id = r.user_id AND o.order_date <= r.return_request_date GROUP BY 1""",
    "m_walk": f"""
SELECT a.return_id, CAST(count(b.return_id) AS BIGINT) AS total_returns_at_time,
  CAST(count(b.return_id) FILTER (date_diff('day', b.return_request_date, a.return_request_date) <= 30) AS BIGINT) AS returns_30d_by_order,
  CAST(count(b.return_id) FILTER (b.seller_id = a.seller_id) AS BIGINT) AS seller_returns_at_time
FROM m_requests a LEFT JOIN m_requests b ON a.user_id = b.user_id AND {WALK} GROUP BY 1""",
    "m_scored": f"""
SELECT *, CASE WHEN label_draw < fraud_probability THEN 'fraud' ELSE 'legitimate' END AS label FROM (
SELECT *, {_sigmoid(f"(fraud_score - {d(LABEL_THRESHOLD)}) / {d(0.9)}")} AS fraud_probability FROM (
SELECT *, {_score()} AS fraud_score FROM (
SELECT r.*, total_orders_at_time, orders_value_at_time, total_returns_at_time, returns_30d_by_order,
  seller_returns_at_time, account_age_days, email_verified, shared_device_flag,
  CAST(total_returns_at_time AS DOUBLE) / CAST(total_orders_at_time AS DOUBLE) AS rtor,
  order_value / greatest(orders_value_at_time / CAST(total_orders_at_time AS DOUBLE), CAST(1 AS DOUBLE)) AS value_ratio,
  CAST(seller_returns_at_time AS DOUBLE) / CAST(greatest(total_returns_at_time, 1) AS DOUBLE) AS seller_ratio
FROM m_requests r JOIN m_asof USING (return_id) JOIN m_walk USING (return_id) JOIN m_users USING (user_id))))""",
    "m_star": f"""
SELECT s.return_id, s.order_id, s.user_id, s.product_id, s.seller_id, p.category, s.reason_category,
  s.return_type, s.image_uploaded, s.return_request_date, s.order_date, s.delivery_date, s.order_value,
  s.value_e4, s.discount_pct, s.is_prepaid, s.is_returned, u.account_age_days, u.email_verified,
  u.shared_device_flag, u.phone_verified, u.registration_date AS user_registration_date, p.price,
  p.review_count, p.sku, p.category_base_defect_rate, p.return_window_days, p.is_non_returnable,
  e.seller_age_days, e.seller_rating, e.seller_return_rate, e.seller_customer_frequency, e.seller_type,
  e.category_specialization, e.registration_date AS seller_registration_date,
  {RATE.replace('CASE category', 'CASE p.category')} AS category_base_defect, s.within_return_window,
  s.days_left_to_return, s.total_orders_at_time, s.total_returns_at_time, s.fraud_type, s.label,
  s.fraud_probability AS risk_score
FROM m_scored s JOIN m_users u USING (user_id) JOIN m_products p USING (product_id)
JOIN m_sellers e USING (seller_id)""",
    "m_prior": f"""
SELECT a.return_id, CAST(count(b.return_id) AS BIGINT) AS past_returns_count,
  CAST(coalesce(sum(b.value_e4), 0) AS BIGINT) AS past_e4,
  max(b.return_request_date) AS prev_return_date,
  CAST(count(b.return_id) FILTER (isodow(b.return_request_date) >= 6) AS BIGINT) AS past_weekend,
  CAST(count(b.return_id) FILTER (date_diff('day', b.return_request_date, a.return_request_date) < 30) AS BIGINT) AS returns_last_30d,
  CAST(count(b.return_id) FILTER (date_diff('day', b.return_request_date, a.return_request_date) < 90) AS BIGINT) AS returns_last_90d,
  CAST(count(b.return_id) FILTER (b.seller_id = a.seller_id) AS BIGINT) AS past_seller_returns
FROM m_star a LEFT JOIN m_star b ON a.user_id = b.user_id AND {PRIOR} GROUP BY 1""",
    "m_flagged": """
SELECT *, CAST(order_value > user_avg_order_value * 1.5 AS BIGINT) AS is_high_value_return,
  order_value / greatest(user_avg_order_value, CAST(1 AS DOUBLE)) AS order_value_ratio
FROM (SELECT a.*, p.* EXCLUDE (return_id),
  CASE WHEN past_returns_count = 0 THEN a.order_value
    ELSE CAST(past_e4 AS DOUBLE) / CAST(10000 * past_returns_count AS DOUBLE) END AS user_avg_order_value,
  CAST(isodow(a.return_request_date) >= 6 AS BIGINT) AS is_weekend_return,
  CAST(coalesce(a.category = lag(a.category) OVER (PARTITION BY a.user_id ORDER BY a.return_request_date, a.order_date, a.return_id), false) AS BIGINT) AS is_same_category,
  lag(a.category) OVER (PARTITION BY a.user_id ORDER BY a.return_request_date, a.order_date, a.return_id) AS prev_category
FROM m_star a JOIN m_prior p USING (return_id))""",
    "m_features": f"""
SELECT a.* EXCLUDE (past_e4, past_weekend, value_e4),
  CAST(past_e4 AS DOUBLE) / CAST(10000 AS DOUBLE) AS past_order_value_sum,
  CAST(a.return_request_date - CAST(account_age_days AS INTEGER) AS DATE) AS account_creation_date,
  CAST(date_diff('day', a.delivery_date, a.return_request_date) AS BIGINT) AS days_since_delivered,
  CAST(total_returns_at_time AS DOUBLE) / CAST(greatest(total_orders_at_time, 1) AS DOUBLE) AS return_to_order_ratio,
  CAST(coalesce(date_diff('day', prev_return_date, a.return_request_date), -1) AS BIGINT) AS days_since_last_return,
  CAST(past_weekend AS DOUBLE) / CAST(greatest(past_returns_count, 1) AS DOUBLE) AS weekend_return_ratio,
  CAST(past_high AS DOUBLE) / CAST(greatest(past_returns_count, 1) AS DOUBLE) AS high_value_return_ratio,
  CAST(past_same AS DOUBLE) / CAST(greatest(past_returns_count, 1) AS DOUBLE) AS same_category_return_ratio,
  CAST(past_seller_returns AS DOUBLE) / CAST(greatest(total_returns_at_time, 1) AS DOUBLE) AS seller_repeat_ratio,
  CAST(returns_last_30d AS DOUBLE) + CAST(returns_last_90d - returns_last_30d AS DOUBLE) * {d(0.3)} AS return_frequency_score,
  CAST(order_value_ratio > 2.0 AND image_uploaded = 0 AND CAST(total_returns_at_time AS DOUBLE) / CAST(greatest(total_orders_at_time, 1) AS DOUBLE) > {d(0.3)} AS BIGINT) AS requires_manual_verification,
  CAST(label = 'fraud' AS BIGINT) AS target
FROM m_flagged a JOIN (
  SELECT a.return_id, coalesce(sum(b.is_high_value_return), 0) AS past_high, coalesce(sum(b.is_same_category), 0) AS past_same
  FROM m_flagged a LEFT JOIN m_flagged b ON a.user_id = b.user_id AND {PRIOR} GROUP BY 1) USING (return_id)""",
    "m_hits": " UNION ALL ".join(_hit(r, c, t) for r, _, c, t in HITS),
    "m_ruled": f"""
SELECT f.*, CASE WHEN coalesce(h.hard, 0) > 0 THEN CAST(1 AS DOUBLE) ELSE least(coalesce(h.soft, 0) / {d(165.0)}, CAST(1 AS DOUBLE)) END AS rule_score,
  CAST(coalesce(h.hard, 0) > 0 AS BIGINT) AS hard_rule_triggered,
  CAST(coalesce(h.n, 0) AS BIGINT) AS rules_triggered_count, coalesce(h.ids, []) AS ids
FROM m_features f LEFT JOIN (
  SELECT return_id, sum(CASE WHEN rule_id LIKE 'R0%' THEN 1 ELSE 0 END) AS hard,
    sum(CASE WHEN rule_id LIKE 'R0%' THEN 0 ELSE score END) AS soft, count(*) AS n,
    list(rule_id ORDER BY rule_id) AS ids
  FROM m_hits GROUP BY 1) h USING (return_id)""",
    "m_decided": f"""
SELECT *, CAST({' + '.join(f'CAST({c} AS INTEGER)' for c in [
    'risk_score BETWEEN 0.3 AND 0.7', 'evidence_missing', 'policy_ambiguous',
    '(order_value > 50000 AND evidence_missing)', 'evidence_inconsistent', 'confidence < 0.7',
    '(hard_signals = 1 AND NOT policy_violation)', 'rule_escalation'])} AS BIGINT) AS escalation_count
FROM (SELECT f.*,
  CAST(50 + (product_id * 31 + seller_id * 17 + user_id) % 51 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  hard_rule_triggered = 1 AS policy_violation,
  days_since_delivered = return_window_days + 1 AS policy_ambiguous,
  reason_category IN ('damaged', 'quality_issue', 'wrong_item') AND image_uploaded = 0 AS evidence_missing,
  reason_category = 'not_delivered' AND image_uploaded = 1 AS evidence_inconsistent,
  CAST(list_contains(ids, 'R1') AS INTEGER) + CAST(list_contains(ids, 'R3') AS INTEGER) AS hard_signals,
  CAST(list_contains(ids, 'R5') AS INTEGER) + CAST(list_contains(ids, 'R6') AS INTEGER) + CAST(list_contains(ids, 'R7') AS INTEGER) AS behaviour_flags,
  reason_category = 'changed_mind' AS text_flag,
  list_has_any(ids, ['R1', 'R4', 'R8']) OR g.units IS NOT NULL AS rule_escalation,
  CAST(coalesce(p.prior_fraud, 0) AS BIGINT) AS prior_fraud
FROM m_ruled f LEFT JOIN m_burst g USING (user_id, product_id, return_request_date) LEFT JOIN (
  SELECT a.return_id, count(*) AS prior_fraud FROM m_star a JOIN m_star b
  ON a.user_id = b.user_id AND b.label = 'fraud' AND {PRIOR} GROUP BY 1) p USING (return_id))""",
    "m_verdicts": """
SELECT *, CASE WHEN escalation_count > 0 OR confidence <= 0.95 THEN 'Escalate'
    WHEN policy_violation THEN 'Auto-Reject'
    WHEN risk_score > 0.7 AND hard_signals >= 2 THEN 'Auto-Reject'
    WHEN risk_score < 0.3 THEN 'Auto-Approve' ELSE 'Escalate' END AS verdict,
  CAST(account_age_days > 1095 AND return_to_order_ratio < 0.05 AND prior_fraud = 0 AND order_value < 10000
    AND text_flag AND behaviour_flags = 0 AND risk_score < 0.3
    AND NOT (list_contains(ids, 'R1') OR list_contains(ids, 'R3') OR list_contains(ids, 'R4')) AS BIGINT) AS trusted_override,
  CAST(policy_ambiguous AND account_age_days > 1095 AND return_to_order_ratio < 0.05 AND prior_fraud = 0 AND order_value < 10000 AS BIGINT) AS boundary_escalation
FROM m_decided""",
    "m_final": """
SELECT * REPLACE (CASE WHEN boundary_escalation = 1 THEN 'Escalate'
    WHEN trusted_override = 1 AND NOT policy_violation AND escalation_count = 0 THEN 'Auto-Approve'
    ELSE verdict END AS verdict) FROM m_verdicts""",
    "m_labelled": """
SELECT return_id, return_request_date, order_date, CAST(label = 'fraud' AS BIGINT) AS target,
  floor(fraud_probability * 1000) / CAST(1000 AS DOUBLE) AS score FROM m_scored""",
    "m_split": f"""
SELECT *, CASE WHEN row_number() OVER (ORDER BY return_request_date, order_date, return_id)
  <= CAST(floor((SELECT count(*) FROM m_labelled) * {d(0.8)}) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM m_labelled""",
    "m_portfolios": f"""
SELECT seller_id, seller_type, CAST((SELECT count(*) FROM lineitem WHERE l_suppkey = seller_id) AS BIGINT) AS order_weight,
  CASE WHEN seller_type = 'general_marketplace' THEN {CATEGORIES!r}
    ELSE [{pick(f'seller_id % {len(CATEGORIES)}', CATEGORIES)}, {pick(f'(seller_id + 1) % {len(CATEGORIES)}', CATEGORIES)}] END AS categories
FROM m_sellers""",
    "m_tokens": r"""
SELECT doc_id AS chunk_id, unnest(list_filter(string_split_regex(lower(text), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda t: t <> '')) AS term FROM documents""",
    "m_postings": "SELECT chunk_id, term, count(*) AS tf FROM m_tokens GROUP BY 1, 2",
    "m_lengths": "SELECT chunk_id, count(*) AS dl FROM m_tokens GROUP BY 1",
    "m_terms": f"""
SELECT term, df, CASE WHEN raw < 0 THEN {d(0.25)} * avg(raw) OVER () ELSE raw END AS idf FROM (
  SELECT term, count(*) AS df,
    ln((SELECT count(*) FROM documents) - count(*) + {d(0.5)}) - ln(count(*) + {d(0.5)}) AS raw
  FROM m_postings GROUP BY 1)""",
    "m_query_terms": r"""
SELECT query_id, term, count(*) AS qtf FROM (
  SELECT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda t: t <> '')) AS term
  FROM benchmark) GROUP BY 1, 2""",
    "m_bm25": f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, round(sum(qtf * idf * tf * {d(2.5)} / (tf + {d(1.5)} * ({d(0.25)} + {d(0.75)} * dl /
    (SELECT CAST(sum(dl) AS DOUBLE) / (SELECT count(*) FROM documents) FROM m_lengths)))), 6) AS score
  FROM m_query_terms JOIN m_postings USING (term) JOIN m_lengths USING (chunk_id) JOIN m_terms USING (term)
  GROUP BY 1, 2) WHERE score > 0) WHERE rank <= 20""",
    "m_near": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id,
    round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)) WHERE rank <= 20""",
}


def sql(text: str) -> str:
    """The query with the shared parts it names, in order of need."""
    needed: list[str] = []

    def visit(fragment: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bm_[a-z0-9_]+\b", fragment)):
            if name in CTES and name not in needed:
                visit(CTES[name])
                needed.append(name)

    visit(text)
    if not needed:
        return text
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in needed)
    return f"WITH {parts}\n{text.strip()}"


STAR_COLUMNS = """return_id, order_id, user_id, product_id, seller_id, category, reason_category,
return_type, image_uploaded, return_request_date, order_date, delivery_date, order_value,
discount_pct, is_prepaid, account_age_days, email_verified, shared_device_flag, phone_verified,
user_registration_date, price, review_count, return_window_days, is_non_returnable,
seller_age_days, seller_rating, seller_return_rate, seller_customer_frequency, seller_type,
seller_registration_date, category_base_defect, total_orders_at_time, total_returns_at_time,
fraud_type, label"""

B = "AS BIGINT)"
SPACES = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def _orphans(name: str, child: str, parent: str, key: str) -> str:
    return (
        f"SELECT '{name}' AS \"check\", CAST(count(*) {B} AS violations FROM {child} "
        f"WHERE {key} NOT IN (SELECT {key} FROM {parent})"
    )


def _duplicates(name: str, table: str, key: str) -> str:
    return f"SELECT '{name}' AS \"check\", CAST(count(*) - count(DISTINCT {key}) {B} AS violations FROM {table}"


SIGNAL = """CASE WHEN policy_violation THEN 'policy' WHEN hard_signals > 0 THEN 'metadata' WHEN risk_score >= 0.3 THEN 'model'
  WHEN evidence_missing OR evidence_inconsistent THEN 'evidence' WHEN behaviour_flags > 0 THEN 'behaviour'
  WHEN text_flag THEN 'text' ELSE 'none' END"""


def _yes(column: str) -> str:
    return f"CASE WHEN {column} <> 0 THEN 'Yes' ELSE 'No' END"


DOSSIER = " || chr(10) || ".join(
    [
        "'[Case Summary]'",
        "'- Return ID: ' || return_id",
        "'- User ID: ' || user_id",
        "'- Category: ' || category",
        "'- Product Price: ' || format('{:,.0f}', price)",
        "'- Order Value: ' || format('{:,.0f}', order_value)",
        "'- Discount: ' || format('{:.1f}', discount_pct) || '%'",
        f"'- Prepaid Order: ' || {_yes('is_prepaid')}",
        "'- Return Reason: ' || reason_category",
        "'- Return Type: ' || return_type",
        f"'- Image Uploaded: ' || {_yes('image_uploaded')}",
        f"'- Within Return Window: ' || {_yes('within_return_window')}",
        "'- Days Left to Return: ' || days_left_to_return",
        "'- Days Since Delivered: ' || days_since_delivered",
        f"'- Product Non-Returnable Flag: ' || {_yes('is_non_returnable')}",
        "chr(10) || '[User Profile]'",
        "'- Account Age: ' || account_age_days || ' days'",
        f"'- Email Verified: ' || {_yes('email_verified')}",
        f"'- Shared Device: ' || {_yes('shared_device_flag')}",
        "'- Total Orders: ' || total_orders_at_time",
        "'- Total Prior Returns: ' || total_returns_at_time",
        "'- Return-to-Order Ratio: ' || printf('%.2f', CAST(return_to_order_ratio AS DOUBLE))",
        "'- Returns in Last 30 Days: ' || returns_last_30d",
        "chr(10) || '[Seller Profile]'",
        "'- Seller Rating: ' || seller_rating",
        "'- Seller Return Rate: ' || (seller_id * 13) % 55 || '.00%'",
        "'- Seller Age: ' || seller_age_days || ' days'",
        "chr(10) || '[Risk Assessment]'",
        "'- Fraud Probability: ' || format('{:.1f}', risk_score * 100) || '%'",
        f"'- Combined Risk Score: ' || format('{{:.3f}}', {d(0.6)} * risk_score + {d(0.4)} * rule_score)",
        "chr(10) || '[Rule Engine Results]'",
        "'- Rules Triggered: ' || rules_triggered_count || '/13'",
        "coalesce(lines, '  * No rules triggered.')",
    ]
)
CLASSES = """
SELECT count(*) FILTER (target = 0 AND score < 0.5) AS tn, count(*) FILTER (target = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (target = 1 AND score < 0.5) AS fn, count(*) FILTER (target = 1 AND score >= 0.5) AS tp FROM m_labelled"""
CLASS_ROWS = f"""
SELECT 'legitimate' AS class, CAST(tn AS DOUBLE) / (tn + fn) AS precision, CAST(tn AS DOUBLE) / (tn + fp) AS recall,
  CAST(2 * tn AS DOUBLE) / (2 * tn + fn + fp) AS f1, CAST(tn + fp {B} AS support FROM ({CLASSES})
UNION ALL SELECT 'fraud', CAST(tp AS DOUBLE) / (tp + fp), CAST(tp AS DOUBLE) / (tp + fn),
  CAST(2 * tp AS DOUBLE) / (2 * tp + fn + fp), CAST(tp + fn {B} FROM ({CLASSES})"""

RAW: dict[str, str] = {
    "scan_orders": "SELECT * FROM m_orders",
    "returns_decoded": """SELECT return_id, order_id, reason_category, return_type, image_uploaded,
return_request_date, within_return_window, days_left_to_return, total_orders_at_time,
total_returns_at_time, fraud_type, label FROM m_scored""",
    "products_decoded": "SELECT * FROM m_products",
    "sellers_decoded": "SELECT * FROM m_sellers",
    "probe_lookup": """
SELECT return_id,
  CASE WHEN n > 0 AND (product_id + n) % 2 = 0 THEN 'img/' || return_id || '-' || n || '.jpg' END AS image_path,
  CASE WHEN n > 0 AND (seller_id + n) % 3 = 2 THEN reason_category || ' text' END AS custom_reason
FROM (SELECT *, days_left_to_return % 3 AS n FROM m_requests)""",
    "drop_internal": "SELECT * FROM m_orders",
    "parse_dates": """
SELECT order_id, CASE WHEN user_id % 11 = 10 THEN NULL WHEN user_id % 11 = 3 AND day(order_date) <= 12
    THEN make_date(year(order_date), day(order_date), month(order_date)) ELSE order_date END AS order_date FROM m_orders""",
    "star_join": f"SELECT {STAR_COLUMNS} FROM m_star",
    "base_features": "SELECT return_id, account_creation_date, days_since_delivered, return_to_order_ratio FROM m_features",
    "recency_features": "SELECT return_id, prev_return_date, days_since_last_return FROM m_features",
    "user_value_features": """SELECT return_id, past_order_value_sum, past_returns_count,
user_avg_order_value, order_value_ratio, is_high_value_return FROM m_features""",
    "ratio_features": """SELECT return_id, is_weekend_return, weekend_return_ratio, is_same_category,
same_category_return_ratio, high_value_return_ratio FROM m_features""",
    "seller_repeat": "SELECT return_id, past_seller_returns, seller_repeat_ratio FROM m_features",
    "velocity_features": "SELECT return_id, returns_last_30d, returns_last_90d, return_frequency_score FROM m_features",
    "velocity_stream": "SELECT return_id, returns_last_30d, returns_last_90d, return_frequency_score FROM m_features",
    "manual_verification": "SELECT return_id, requires_manual_verification FROM m_features",
    "full_features": f"SELECT return_id, {', '.join(ALL_FEATURES)}, target FROM m_features",
    "full_features_split": f"SELECT return_id, {', '.join(ALL_FEATURES)}, target FROM m_features",
    "sample_cases": "SELECT return_id FROM m_split WHERE split = 'test' ORDER BY md5(return_id || ':42') || return_id LIMIT 100",
    "case_view": """
SELECT * EXCLUDE (prev_return_date, prev_category, past_order_value_sum, past_returns_count,
    past_seller_returns, is_same_category, is_high_value_return, is_weekend_return,
    account_creation_date, risk_score)
  REPLACE (strftime(return_request_date, '%Y-%m-%d') AS return_request_date,
    strftime(order_date, '%Y-%m-%d') AS order_date, strftime(delivery_date, '%Y-%m-%d') AS delivery_date,
    strftime(user_registration_date, '%Y-%m-%d') AS user_registration_date,
    strftime(seller_registration_date, '%Y-%m-%d') AS seller_registration_date)
FROM m_features JOIN (SELECT product_id, base_defect_rate FROM m_products) USING (product_id)
  JOIN (SELECT seller_id, rating FROM m_sellers) USING (seller_id)""",
    "returnability": f"""
SELECT order_id, CAST(CASE WHEN is_non_returnable = 1 THEN 0 ELSE is_returned END {B} AS is_returned
FROM m_orders JOIN m_products USING (product_id)""",
    "order_value_calc": f"""
SELECT order_id, greatest(CAST(CASE WHEN t % 100 > 50 OR (t % 100 = 50 AND (t // 100) % 2 = 1) THEN t // 100 + 1 ELSE t // 100 END AS DOUBLE) / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)) AS order_value
FROM (SELECT order_id, CAST(round(price * 100) {B} * (100 - CAST(discount_pct {B}) AS t
  FROM m_orders JOIN m_part USING (product_id))""",
    "window_fields": f"""
SELECT return_id, CAST(w {B} AS effective_window, CAST(days {B} AS days_after_delivery,
  CAST(days <= w {B} AS within_window, CAST(greatest(0, w - days) {B} AS days_left
FROM (SELECT return_id, days_since_delivered AS days,
  CASE WHEN product_id % 5 = 0 THEN 7 ELSE return_window_days END AS w FROM m_requests)""",
    "price_band": f"""
SELECT segment, category, product_id, price, CAST(n = 0 {B} AS relaxed FROM (
  SELECT *, price BETWEEN lo AND hi AS inside,
    sum(CASE WHEN price BETWEEN lo AND hi THEN 1 ELSE 0 END) OVER (PARTITION BY segment, category) AS n
  FROM m_products, (VALUES ('budget', 0e0, 950e0), ('mid', 940e0, 1000e0), ('premium', 1e6, 2e6)) AS s(segment, lo, hi))
WHERE inside OR n = 0""",
    "seller_eligibility": f"""
SELECT category, seller_id, order_weight, CAST(category = 'Grocery' {B} AS fallback,
  CAST(order_weight AS DOUBLE) / CAST(sum(order_weight) OVER (PARTITION BY category) AS DOUBLE) AS share
FROM (SELECT seller_id, order_weight, unnest(list_append(categories, 'Grocery')) AS category FROM m_portfolios)""",
    "portfolio_mismatch": """
SELECT order_id, seller_id, category FROM m_orders JOIN m_part USING (product_id) JOIN m_portfolios USING (seller_id)
WHERE NOT list_contains(categories, category)""",
    "popularity_weights": f"""
SELECT seller_id, popularity_rank, round(w / sum(w) OVER (), 8) AS order_weight FROM (
  SELECT *, CAST(1 AS DOUBLE) / popularity_rank * CASE WHEN seller_type = 'general_marketplace' THEN {d(1.4)} ELSE 1 END AS w
  FROM (SELECT *, row_number() OVER (ORDER BY order_weight DESC, seller_id) AS popularity_rank FROM m_portfolios))""",
    "renumber": """
SELECT order_id, 'ORD_' || lpad(CAST(row_number() OVER (ORDER BY order_date, order_id) AS VARCHAR), 8, '0') AS new_order_id
FROM m_orders""",
    "apportion": f"""
SELECT user_id, weight, CAST(s + CASE WHEN rn <= abs(drift) THEN sign(drift) ELSE 0 END {B} AS planned_orders FROM (
  SELECT *, row_number() OVER (ORDER BY s DESC, user_id) AS rn, 33000 - sum(s) OVER () AS drift FROM (
    SELECT user_id, weight, greatest(CAST(round_even(weight * CAST(33000 AS DOUBLE) / sum(weight) OVER (), 0) {B}, 1) AS s
    FROM (SELECT user_id, count(*) AS weight FROM m_orders GROUP BY 1)))""",
    "apportion_fractional": f"""
SELECT user_id, weight, CAST(s + CASE WHEN rn <= abs(drift) THEN sign(drift) ELSE 0 END {B} AS planned_orders FROM (
  SELECT *, row_number() OVER (ORDER BY s DESC, user_id) AS rn, 33000 - sum(s) OVER () AS drift FROM (
    SELECT user_id, weight, greatest(CAST(round_even(weight * CAST(33000 AS DOUBLE) / sum(weight) OVER (), 0) {B}, 1) AS s
    FROM (SELECT user_id, CAST(count(*) AS DOUBLE) * 0.25::DOUBLE + 0.5::DOUBLE AS weight FROM m_orders GROUP BY 1)))""",
    "gap_chain": f"""
SELECT order_id, user_id, position, event_date FROM (
  SELECT a.order_id, a.user_id, CAST(count(b.order_id) + 1 {B} AS position,
    CAST(any_value(u.registration_date) + CAST(coalesce(sum(1 + b.product_id % 45), 0) AS INTEGER) AS DATE) AS event_date
  FROM m_orders a JOIN m_users u USING (user_id) LEFT JOIN m_orders b
    ON a.user_id = b.user_id AND (b.order_date, b.order_id) < (a.order_date, a.order_id)
  GROUP BY 1, 2)
WHERE position = 1 OR event_date < DATE '2001-07-01'""",
    "as_of_state": "SELECT * FROM m_asof",
    "return_state": "SELECT * FROM m_walk",
    "fraud_score": "SELECT return_id, round(fraud_score, 9) AS fraud_score, round(fraud_probability, 6) AS fraud_probability, label FROM m_scored",
    "temporal_split": "SELECT return_id, split FROM m_split",
    "split_summary": f"""
SELECT split, CAST(count(*) {B} AS rows, CAST(sum(target) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS target_rate,
  CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM m_split) AS DOUBLE) AS share FROM m_split GROUP BY 1""",
    "classification_report": f"""
SELECT * FROM ({CLASS_ROWS})
UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT CAST(tn + tp AS DOUBLE) / (tn + tp + fn + fp) AS a, CAST(tn + tp + fn + fp {B} AS n FROM ({CLASSES}))
UNION ALL SELECT 'macro avg', sum(precision) / 2, sum(recall) / 2, sum(f1) / 2, CAST(sum(support) {B} FROM ({CLASS_ROWS})
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) {B} FROM ({CLASS_ROWS})""",
    "roc_auc": f"""
SELECT CAST(any_value(np) {B} AS positives, CAST(any_value(nn) {B} AS negatives,
  CAST(sum(CASE WHEN a.score > b.score THEN 2 WHEN a.score = b.score THEN 1 ELSE 0 END * a.n * b.n) AS DOUBLE) / (2 * CAST(any_value(np * nn) AS DOUBLE)) AS roc_auc
FROM (SELECT score, count(*) AS n FROM m_labelled WHERE target = 1 GROUP BY 1) a,
  (SELECT score, count(*) AS n FROM m_labelled WHERE target = 0 GROUP BY 1) b,
  (SELECT sum(target) AS np, count(*) - sum(target) AS nn FROM m_labelled)""",
    "recall_at_fpr": """
SELECT coalesce(max(tpr), 0) AS recall, coalesce(max(fpr), 0) AS fpr FROM (
  SELECT t.score, CAST(count(*) FILTER (l.target = 1) AS DOUBLE) / (SELECT count(*) FROM m_labelled WHERE target = 1) AS tpr,
    CAST(count(*) FILTER (l.target = 0) AS DOUBLE) / (SELECT count(*) FROM m_labelled WHERE target = 0) AS fpr
  FROM (SELECT DISTINCT score FROM m_labelled) t JOIN m_labelled l ON l.score >= t.score GROUP BY 1)
WHERE fpr <= 0.05""",
    "threshold_sweep": f"""
SELECT threshold, CAST(tp {B} AS tp, CAST(fp {B} AS fp, CAST(positives {B} AS positives,
  CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
  CASE WHEN positives = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / positives END AS recall
FROM (SELECT threshold, count(*) FILTER (score >= threshold AND target = 1) AS tp,
    count(*) FILTER (score >= threshold AND target = 0) AS fp, count(*) FILTER (target = 1) AS positives
  FROM m_labelled, (VALUES ({d(0.5)}), ({d(0.6)}), ({d(0.7)}), ({d(0.8)})) AS t(threshold) GROUP BY 1)""",
    "value_counts": f"""
SELECT reason_category AS value, CAST(count(*) {B} AS n,
  CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM m_requests) AS DOUBLE) AS share FROM m_requests GROUP BY 1""",
    "describe_by_group": f"""
SELECT reason_category, CAST(count(*) {B} AS count, round(avg(order_value), 4) AS mean, round(stddev_samp(order_value), 4) AS std,
  round(min(order_value), 4) AS min, round(max(order_value), 4) AS max, round(quantile_cont(order_value, 0.25), 4) AS p25,
  round(quantile_cont(order_value, 0.5), 4) AS p50, round(quantile_cont(order_value, 0.75), 4) AS p75
FROM m_requests GROUP BY 1""",
    "group_mean": "SELECT seller_type, round(avg(seller_return_rate), 6) AS mean FROM m_sellers GROUP BY 1",
    "fraud_rate_by_type": f"""
SELECT fraud_type, CAST(count(*) {B} AS n, CAST(count(*) FILTER (label = 'fraud') {B} AS hits,
  CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM m_scored) AS DOUBLE) AS share,
  CAST(count(*) FILTER (label = 'fraud') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS rate FROM m_scored GROUP BY 1""",
    "table_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count({c}) {B} AS n, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(CAST(sum({c}) AS DOUBLE), 2) AS sum, round(avg({c}), 6) AS mean, CAST(count(DISTINCT {c}) {B} AS \"distinct\" FROM m_orders"
        for c in ("order_value", "discount_pct", "is_prepaid", "is_returned")
    ),
    "age_buckets": f"""
SELECT CASE WHEN seller_age_days <= 180 THEN 'new' WHEN seller_age_days <= 730 THEN 'mid' ELSE 'veteran' END AS age_group,
  CAST(count(*) {B} AS sellers, round(avg(seller_rating), 6) AS mean_rating FROM m_sellers GROUP BY 1""",
    "integrity_report": " UNION ALL ".join(
        [
            _orphans("orders_without_user", "m_orders", "m_users", "user_id"),
            _orphans("orders_without_product", "m_orders", "m_products", "product_id"),
            _orphans("orders_without_seller", "m_orders", "m_sellers", "seller_id"),
            _orphans("returns_of_unreturned_orders", "m_requests", "m_orders WHERE is_returned = 1", "order_id"),
            _duplicates("duplicate_return_ids", "m_requests", "return_id"),
            _duplicates("duplicate_order_ids", "m_orders", "order_id"),
            f"SELECT 'orders_with_null_keys' AS \"check\", CAST(count(*) {B} AS violations FROM m_orders WHERE user_id IS NULL OR product_id IS NULL OR seller_id IS NULL",
        ]
    ),
    "category_codes": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", a.{c} AS value, CAST(count(b.{c}) {B} AS code FROM (SELECT DISTINCT {c} FROM m_requests) a LEFT JOIN (SELECT DISTINCT {c} FROM m_requests) b ON b.{c} < a.{c} GROUP BY 1, 2"
        for c in ("category", "reason_category", "return_type")
    ),
    "rule_hits": f"SELECT return_id, rule_id, {RULE_NAME} AS rule_name, description, score FROM m_hits",
    "rule_scores": f"SELECT return_id, rule_score, hard_rule_triggered, CAST(13 {B} AS total_rules_checked, rules_triggered_count FROM m_ruled",
    "rule_summary": f"""
SELECT rule_id, CAST(count(*) {B} AS cases, CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM m_features) AS DOUBLE) AS share
FROM m_hits GROUP BY 1""",
    "combined_score": f"SELECT return_id, round({d(0.6)} * risk_score + {d(0.4)} * rule_score, 6) AS combined_score FROM m_ruled",
    "risk_band": f"""
SELECT return_id, round(risk_score, 6) AS risk_score,
  CASE WHEN risk_score < 0.3 THEN 'low' WHEN risk_score > 0.7 THEN 'high' ELSE 'ambiguous' END AS risk_band,
  CASE WHEN {d(0.6)} * risk_score + {d(0.4)} * rule_score < 0.2 THEN 'Auto-Approve'
    WHEN {d(0.6)} * risk_score + {d(0.4)} * rule_score > 0.85 THEN 'Auto-Reject' ELSE 'Escalate' END AS score_only_band,
  CASE WHEN confidence > 0.95 THEN 'auto' WHEN confidence >= 0.7 THEN 'validate' ELSE 'human' END AS confidence_band
FROM m_decided""",
    "verdict": "SELECT return_id, round(risk_score, 6) AS risk_score, confidence, escalation_count, verdict FROM m_verdicts",
    "verdict_summary": f"""
SELECT CAST(count(*) FILTER (verdict = 'Auto-Approve') {B} AS approved, CAST(count(*) FILTER (verdict = 'Escalate') {B} AS escalated,
  CAST(count(*) FILTER (verdict = 'Auto-Reject') {B} AS rejected FROM m_final""",
    "escalation_queue": "SELECT return_id, user_id, round(risk_score, 6) AS risk_score, rule_score, escalation_count FROM m_final WHERE verdict = 'Escalate'",
    "deciding_signal": f"SELECT return_id, {SIGNAL} AS deciding_signal FROM m_decided",
    "trusted_override": "SELECT return_id, prior_fraud, trusted_override FROM m_verdicts",
    "boundary_escalation": "SELECT return_id, boundary_escalation FROM m_verdicts",
    "same_item_burst": f"""
SELECT a.user_id, a.product_id, a.return_request_date, a.units, CAST(sum(b.units) {B} AS units_in_window,
  CAST(sum(b.units) >= 3 {B} AS burst
FROM m_daily a JOIN m_daily b USING (user_id, product_id)
WHERE date_diff('day', b.return_request_date, a.return_request_date) BETWEEN 0 AND 6 GROUP BY 1, 2, 3, 4""",
    "last_day_pattern": f"""
SELECT return_id, is_last_day, CAST(prior {B} AS prior_last_day, CAST(is_last_day = 1 AND prior + is_last_day >= 3 {B} AS last_day_pattern
FROM (SELECT a.return_id, any_value(a.is_last_day) AS is_last_day, coalesce(sum(b.is_last_day), 0) AS prior
  FROM m_last_day a LEFT JOIN m_last_day b ON a.user_id = b.user_id AND {PRIOR} GROUP BY 1)""",
    "pair_concentration": f"""
SELECT DISTINCT user_id, seller_id, CAST(pair_n {B} AS pair_returns, CAST(user_n {B} AS user_returns, CAST(seller_n {B} AS seller_returns,
  CAST(pair_n AS DOUBLE) / CAST(user_n AS DOUBLE) AS share_of_user, CAST(pair_n AS DOUBLE) / CAST(seller_n AS DOUBLE) AS share_of_seller
FROM (SELECT user_id, seller_id, count(*) OVER (PARTITION BY user_id, seller_id) AS pair_n,
  count(*) OVER (PARTITION BY user_id) AS user_n, count(*) OVER (PARTITION BY seller_id) AS seller_n FROM m_requests)""",
    "probe_eval": f"""
SELECT bucket, target, CAST(coalesce(cases, 0) {B} AS cases, CAST(coalesce(hit, 0) {B} AS as_expected,
  CAST(coalesce(cases, 0) >= target {B} AS covered
FROM (VALUES {', '.join(f"('{k}', CAST({v} AS BIGINT))" for k, v in PROBE_TARGETS.items())}) AS t(bucket, target) LEFT JOIN (
  SELECT bucket, count(*) AS cases, sum(CASE WHEN verdict = CASE
      WHEN bucket IN ('non_returnable', 'clean_fraud') THEN 'Auto-Reject'
      WHEN bucket IN ('clean_legitimate', 'trusted_override') THEN 'Auto-Approve' ELSE 'Escalate' END THEN 1 ELSE 0 END) AS hit
  FROM (SELECT verdict, CASE WHEN list_contains(ids, 'R0_NON_RETURNABLE') THEN 'non_returnable'
      WHEN boundary_escalation = 1 THEN 'one_day_late' WHEN trusted_override = 1 THEN 'trusted_override'
      WHEN hard_rule_triggered = 1 THEN 'clean_fraud' WHEN len(ids) = 0 THEN 'clean_legitimate'
      ELSE ids[1] END AS bucket FROM m_final) GROUP BY 1) USING (bucket)""",
    "audit_check": f"""
SELECT return_id, missing AS missing_fields, CAST(missing = '' {B} AS complete FROM (
  SELECT return_id, CASE product_id % 10 WHEN 1 THEN 'policy_clause' WHEN 3 THEN 'reasoning'
    WHEN 2 THEN CASE WHEN verdict = 'Escalate' THEN 'dossier' ELSE '' END ELSE '' END AS missing FROM m_final)""",
    "audit_log": f"""
SELECT '2024-01-01 00:00:00' AS timestamp, return_id, category, strftime(order_date, '%Y-%m-%d') AS order_date, order_value,
  rule_score, array_to_string(ids, ',') AS rules, verdict, confidence,
  'Decided by ' || {SIGNAL} || '; risk band ' || CASE WHEN risk_score < 0.3 THEN 'low' WHEN risk_score > 0.7 THEN 'high' ELSE 'ambiguous' END
    || '; rules ' || CASE WHEN len(ids) = 0 THEN 'none' ELSE array_to_string(ids, ',') END || '.' AS reasoning
FROM m_final""",
    "case_dossier": f"""
SELECT return_id, {DOSSIER} AS dossier FROM m_final LEFT JOIN (
  SELECT return_id, string_agg('  * [' || rule_id || '] ' || {RULE_NAME} || ': ' || description, chr(10) ORDER BY rule_id) AS lines
  FROM m_hits GROUP BY 1) h USING (return_id)""",
    "invalid_cases": """
SELECT return_id, concat_ws(',', CASE WHEN product_id % 97 = 0 THEN 'no user_id' END,
  CASE WHEN seller_id % 53 = 0 THEN 'delivered before order' END, CASE WHEN product_id % 89 = 0 THEN 'no value' END) AS faults
FROM m_requests WHERE product_id % 97 = 0 OR seller_id % 53 = 0 OR product_id % 89 = 0""",
    "backlog_batch": """
SELECT return_id, return_request_date FROM m_requests WHERE days_left_to_return <> 0
ORDER BY return_request_date DESC, return_id LIMIT 100""",
    "parse_verdict": """
SELECT return_id, CASE product_id % 6 WHEN 0 THEN 'Auto-Approve' WHEN 1 THEN 'Auto-Reject' WHEN 2 THEN 'Escalate'
    WHEN 3 THEN 'Escalate' WHEN 4 THEN 'Auto-Reject' ELSE 'Escalate' END AS verdict,
  CASE product_id % 6 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' WHEN 4 THEN 'Low' ELSE 'Medium' END AS confidence
FROM m_requests""",
    "parse_evidence": f"""
SELECT return_id, CAST(CASE product_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 3 THEN 4 ELSE 3 END {B} AS consistency_score,
  CASE product_id % 5 WHEN 1 THEN 'blur|reuse' WHEN 3 THEN 'a' ELSE '' END AS red_flags,
  CASE product_id % 5 WHEN 0 THEN 'fits ' || return_id WHEN 1 THEN 'see: ' || return_id
    WHEN 2 THEN 'no structure for ' || return_id WHEN 3 THEN 'two' ELSE '' END AS assessment
FROM m_requests""",
    "conversation_verdicts": """
SELECT conv_id, coalesce(arg_max(verdict, turn), 'Escalate') AS verdict, coalesce(max(turn) FILTER (verdict IS NOT NULL), -1) AS verdict_turn,
  coalesce(arg_max(confidence, turn), 'Medium') AS confidence, coalesce(max(turn) FILTER (confidence IS NOT NULL), -1) AS confidence_turn
FROM (SELECT conv_id, turn, CASE lower(regexp_extract(reply, '(?i)VERDICT:\\s*(Auto-Approve|Auto-Reject|Escalate)', 1))
    WHEN 'auto-approve' THEN 'Auto-Approve' WHEN 'auto-reject' THEN 'Auto-Reject' WHEN 'escalate' THEN 'Escalate' END AS verdict,
  CASE lower(regexp_extract(reply, '(?i)CONFIDENCE:\\s*(High|Medium|Low)', 1))
    WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' WHEN 'low' THEN 'Low' END AS confidence FROM m_told_verdicts)
GROUP BY 1""",
    "conversation_evidence": f"""
SELECT conv_id, CAST(coalesce(arg_max(digit, place), 3) {B} AS consistency_score, coalesce(max(turn) FILTER (digit IS NOT NULL), -1) AS consistency_score_turn,
  coalesce(array_to_string(list_filter(list_transform(string_split(arg_max(flags, place), ','), lambda x: trim(x)), lambda x: x <> ''), '|'), '') AS red_flags,
  coalesce(max(turn) FILTER (flags IS NOT NULL), -1) AS red_flags_turn,
  arg_max(assessment, place) AS assessment, coalesce(max(turn) FILTER (assessment IS NOT NULL), -1) AS assessment_turn
FROM (SELECT conv_id, turn, turn * 10000000 + i AS place,
    CASE WHEN upper(line) LIKE 'CONSISTENCY:%' THEN TRY_CAST(left(trim(line[13:]), 1) {B} END AS digit,
    CASE WHEN upper(line) LIKE 'RED_FLAGS:%' AND lower(trim(line[11:])) <> 'none' THEN trim(line[11:]) END AS flags,
    CASE WHEN upper(line) LIKE 'ASSESSMENT:%' THEN trim(line[12:]) END AS assessment
  FROM (SELECT conv_id, turn, unnest(range(len(lines))) AS i, trim(unnest(lines)) AS line
    FROM (SELECT conv_id, turn, string_split(reply, chr(10)) AS lines FROM m_told_evidence)))
GROUP BY 1""",
    "term_stats": f"SELECT term, CAST(df {B} AS df, round(idf, 6) AS idf FROM m_terms",
    "bm25_topk": "SELECT query_id, chunk_id, score, rank FROM m_bm25",
    "pruned_bm25_topk": "SELECT query_id, chunk_id, score, rank FROM m_bm25",
    "vector_topk": f"SELECT CAST(query_id {B} AS query_id, chunk_id, score, rank FROM m_near",
    "policy_context": f"""
SELECT query_id, string_agg('[Source: ' || source || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context,
  CAST(count(*) {B} AS passages FROM m_fused JOIN documents ON doc_id = chunk_id GROUP BY 1""",
    "chunk_documents": f"""
SELECT source, CAST(0 {B} AS section_no, part_no, source || '/0/' || part_no AS chunk_id, text, left(split_part(text, chr(10), 1), 80) AS section FROM (
  SELECT source, CAST(part_no {B} AS part_no, trim(string_agg(p, chr(10) ORDER BY i), {SPACES}) AS text,
    part_no = max(part_no) OVER (PARTITION BY source) AS last
  FROM m_packed JOIN m_paragraphs USING (source, i) GROUP BY 1, 2, m_packed.part_no
  UNION ALL SELECT source, CAST(0 {B}, body, true FROM m_bodies WHERE length(body) <= 500)
WHERE text <> '' OR NOT last""",
    "calibrated_threshold": f"""
SELECT round((SELECT avg({_sigmoid('(fraud_score - (low + high) / 2) / ' + d(0.9))}) FROM m_scored), 6) AS mean_probability,
  round((low + high) / 2, 6) AS threshold FROM m_step9""",
    "feature_matrix": f"""
SELECT return_id, category AS category_str, reason_category AS reason_category_str, return_type AS return_type_str,
  {', '.join(f'CAST({c} AS FLOAT) AS {c}' for c in NUMERIC_FEATURES)},
  {', '.join(f"CAST(CASE WHEN {c} IN (SELECT {c} FROM m_train) THEN (SELECT count(DISTINCT t.{c}) FROM m_train t WHERE t.{c} < f.{c}) ELSE -1 END AS FLOAT) AS {c}" for c in CATEGORICAL_FEATURES)},
  target, split FROM m_features f JOIN (SELECT return_id, split FROM m_split) USING (return_id)""",
    "model_codes": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", a.{c} AS value, CAST(count(b.{c}) {B} AS code FROM (SELECT DISTINCT {c} FROM m_train) a LEFT JOIN (SELECT DISTINCT {c} FROM m_train) b ON b.{c} < a.{c} GROUP BY 1, 2"
        for c in ("category", "reason_category", "return_type")
    ),
    "csv_export": "SELECT * FROM m_orders",
    "split_export": "SELECT return_id, target, split FROM m_split",
    "index_round_trip": f"SELECT term, CAST(df {B} AS df, CAST((SELECT count(*) FROM documents) {B} AS chunks FROM m_terms",
    "decision_log": "SELECT return_id, verdict, rule_score FROM m_final",
    "batch_run": f"""
SELECT return_id, verdict, CAST(verdict = 'Escalate' {B} AS queued,
  CASE WHEN n > 0 AND (product_id + n) % 2 = 0 THEN 'img/' || return_id || '-' || n || '.jpg' END AS image_path
FROM (SELECT *, days_left_to_return % 3 AS n FROM m_final ORDER BY return_request_date DESC, return_id LIMIT 200)""",
    "single_case": f"""
SELECT return_id, {', '.join(ALL_FEATURES)}, rule_score, {SIGNAL} AS deciding_signal, verdict
FROM m_final ORDER BY return_request_date DESC, return_id LIMIT 1""",
    "rrf_fuse": "SELECT query_id, chunk_id, round(fused, 5) AS rrf_score, rank FROM m_fused",
    "_fused": f"""
SELECT query_id, chunk_id, fused, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, lexical_rank NULLS LAST, chunk_id) AS rank FROM (
    SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS lexical_rank,
      coalesce(CAST(1 AS DOUBLE) / (60 + a.rank), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + b.rank), 0) AS fused
    FROM m_bm25 a FULL JOIN (SELECT item_id AS query_id, chunk_id, rank FROM benchmark JOIN m_near ON item_id * 20 = query_id) b
      ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id)) WHERE rank <= 5""",
    "policy_query_text": """
SELECT return_id, category || ' ' || reason_category || ' ' || return_type || ' return '
    || CASE WHEN is_non_returnable = 1 THEN 'non-returnable' ELSE 'returnable' END || ' '
    || CASE WHEN within_return_window = 0 THEN 'outside return window' ELSE 'within return window' END
    || ' order value ' || order_value || ' days left ' || days_left_to_return AS case_query,
  category || ' ' || reason_category || ' return ' || CASE WHEN is_non_returnable = 1 THEN 'non-returnable' ELSE 'returnable' END
    || ' policy' AS policy_query
FROM m_star""",
}
CTES["m_fused"] = RAW.pop("_fused")
# The index once more, over chunks.
CTES["m_chunks"] = RAW["chunk_documents"]
CTES["m_ctokens"] = CTES["m_tokens"].replace("doc_id AS chunk_id", "chunk_id").replace("FROM documents", "FROM m_chunks")
for name in ("postings", "lengths", "terms", "bm25"):
    CTES[f"m_c{name}"] = re.sub(
        r"\bm_(tokens|postings|lengths|terms)\b", r"m_c\1", CTES[f"m_{name}"].replace("FROM documents", "FROM m_chunks")
    )
RAW["chunk_term_stats"] = f"SELECT term, CAST(df {B} AS df, round(idf, 6) AS idf FROM m_cterms"
RAW["chunk_search"] = "SELECT query_id, chunk_id, score, rank FROM m_cbm25"
CTES["m_train"] = """
SELECT category, reason_category, return_type FROM m_requests JOIN m_split USING (return_id) WHERE split = 'train'"""
CTES["m_bodies"] = f"SELECT doc_id AS source, trim(text, {SPACES}) AS body FROM documents"
CTES["m_paragraphs"] = """
SELECT source, unnest(string_split(body, chr(10))) AS p, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS i
FROM m_bodies WHERE length(body) > 500"""
CTES["m_packed"] = """
WITH RECURSIVE walk(source, i, part_no, used) AS (
  SELECT source, i, 0, length(p) FROM m_paragraphs WHERE i = 0
  UNION ALL
  SELECT w.source, w.i + 1, CASE WHEN w.used > 0 AND w.used + length(p) > 500 THEN part_no + 1 ELSE part_no END,
    CASE WHEN w.used = 0 OR w.used + length(p) > 500 THEN length(p) ELSE w.used + 1 + length(p) END
  FROM walk w JOIN m_paragraphs q ON q.source = w.source AND q.i = w.i + 1)
SELECT * FROM walk"""
CTES["m_step0"] = f"SELECT {d(-20.0)} AS low, {d(40.0)} AS high"
for step in range(1, 10):
    # Each step keeps the one of 64 parts of the interval in which the mean passes the target.
    CTES[f"m_step{step}"] = f"""
SELECT low + above * (high - low) / 64 AS low, low + (above + 1) * (high - low) / 64 AS high FROM m_step{step - 1}, (
  SELECT count(*) AS above FROM (
    SELECT i, avg({_sigmoid('(fraud_score - (low + (high - low) * i / 64)) / ' + d(0.9))}) AS mean
    FROM m_scored, m_step{step - 1}, range(1, 64) AS r(i) GROUP BY 1) WHERE mean > {d(0.4)})"""
for kind, marks in (("verdicts", VERDICT_MARKS), ("evidence", EVIDENCE_MARKS)):
    listed = ", ".join("'" + x + "'" for x in marks)
    CTES[f"m_told_{kind}"] = f"""
SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN '' WHEN n % 2 = 0 THEN mark || chr(10) || text ELSE text || chr(10) || mark END AS reply
FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text, n, ([{listed}])[n % {len(marks)} + 1] AS mark
  FROM (SELECT *, conv_id * 7 + turn * 3 AS n FROM conversations))"""
CTES["m_daily"] = f"""
SELECT user_id, product_id, return_request_date, CAST(count(*) {B} AS units FROM m_requests
WHERE order_value > 10000 GROUP BY 1, 2, 3"""
CTES["m_burst"] = """
SELECT a.user_id, a.product_id, a.return_request_date, sum(b.units) AS units FROM m_daily a JOIN m_daily b
  ON a.user_id = b.user_id AND a.product_id = b.product_id AND date_diff('day', b.return_request_date, a.return_request_date) BETWEEN 0 AND 6
GROUP BY 1, 2, 3 HAVING sum(b.units) >= 3"""
CTES["m_last_day"] = f"""
SELECT *, CAST(days_left_to_return = 0 AND within_return_window = 1 {B} AS is_last_day FROM m_requests"""

ORACLE: dict[str, str] = {name: sql(text) for name, text in RAW.items()}
