"""Named queries over a directory of the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from parcelwise.config import ALL_FEATURES, CATEGORICAL_FEATURES, ModelParams, PROBE_TARGETS
from parcelwise.functions.columns import parse_date, ratio, yes
from parcelwise.operators import block_max, catalog, evaluate, ml, policy, profile, retrieval, rules, scoring, vector_index
from parcelwise.operators import state as user_state
from parcelwise.operators import text as texts
from parcelwise.operators.features import (
    base_features, category_codes, feature_matrix, full_features, star_join,
)
from parcelwise.plans import backlog, triage
from parcelwise.session import durable, new_path, small_table, spread
from parcelwise.operators.scale import hot_keys
from parcelwise.sources import files, tables as scans
from parcelwise.sources.mart import CATEGORIES, EVIDENCE_MARKS, Mart, VERDICT_MARKS, mart
from parcelwise.sources.schema import DECISION_LOG, RISK
from parcelwise.streaming import velocity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

END_DATE = "2001-07-01"


def query(build: Callable[[Mart], DataFrame]) -> Callable[[Mart], DataFrame]:
    def run(spark: SparkSession, path: str) -> DataFrame:
        return plain(build(mart(spark, path)))

    QUERIES[build.__name__] = run
    return build


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, so that both engines report the same types."""
    wide = {
        f.name: F.col(f.name).cast("bigint")
        for f in df.schema.fields
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))
    }
    return df.withColumns(wide) if wide else df


def features(m: Mart) -> DataFrame:
    return full_features(m.tables, m.hot_users)


def ruled(m: Mart) -> DataFrame:
    return triage.cases(m.tables, m.hot_users)


def confidence():
    mixed = F.col("product_id") * 31 + F.col("seller_id") * 17 + F.col("user_id")
    return ratio(50 + mixed % 51, F.lit(100))


def signals(m: Mart) -> DataFrame:
    if m.risk_tables is not None:
        # The risk comes along with the return, whose wide row is not dealt by return_id again.
        rows = triage.cases(m.risk_tables, m.hot_users)
        names = ["return_id", *[c for c in rows.columns if c not in ("return_id", RISK)]]
        rows = rows.select(*names, F.col(RISK).alias("risk_score"))
    else:
        risk = m.scored.select("return_id", F.col("fraud_probability").alias("risk_score"))
        rows = spread(ruled(m), m.parts, "return_id").join(spread(risk, m.parts, "return_id"), "return_id")
    return triage.with_signals(rows, confidence(), bursts(m))


@lru_cache(maxsize=8)
def bursts(m: Mart) -> DataFrame:
    return durable(triage.burst_days(m.scored))


def decided(m: Mart) -> DataFrame:
    return triage.decide_cases(signals(m))


def risk():
    return F.round("risk_score", 6).alias("risk_score")


# --- scans ---------------------------------------------------------------------


@query
def scan_orders(m):
    return m.orders


@query
def returns_decoded(m):
    return scans.decode_returns(m.tables)


@query
def products_decoded(m):
    return scans.decode_products(m.tables)


@query
def sellers_decoded(m):
    return scans.decode_sellers(m.tables)


def probes(m: Mart) -> DataFrame:
    """Up to two probe rows per return, some with blank or missing fields."""
    n = F.col("days_left_to_return") % 3
    rows = m.scored.where(n > 0).withColumn("k", F.explode(F.sequence(F.lit(1), n)))
    k = F.col("k")
    path = F.concat(F.lit("  img/"), F.col("return_id"), F.lit("-"), k.cast("string"), F.lit(".jpg "))
    said = (F.col("seller_id") + k) % 3
    return rows.select(
        F.concat(F.lit("CASE-"), F.col("return_id"), F.lit("-"), (9 - k).cast("string")).alias("case_id"),
        F.col("return_id").alias("assigned_return_id"),
        F.when((F.col("product_id") + k) % 2 == 0, path).otherwise("   ").alias("image_path"),
        F.when(said == 0, "")
        .when(said == 1, F.lit(None))
        .otherwise(F.concat(F.lit(" \t"), F.col("reason_category"), F.lit(" text\n")))
        .alias("customer_custom_text"),
    )


@query
def probe_lookup(m):
    return backlog.with_probes(m.returns.select("return_id"), probes(m))


@query
def drop_internal(m):
    extra = m.orders.withColumns(
        {"_behaviour": F.lit("x"), "seller_order_weight": F.lit(1.0), "_order_dt": F.col("order_date")}
    )
    return scans.drop_internal(extra)


@query
def parse_dates(m):
    formats = [
        "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "MM/dd/yyyy", "yyyy-M-d",
        "M/d/yyyy", "MMM d, yyyy", "d MMMM yyyy", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    ]
    written = F.lit("not a date")
    for i, f in enumerate(formats):
        written = F.when(F.col("user_id") % 11 == i, F.date_format("order_date", f)).otherwise(written)
    return m.orders.select("order_id", parse_date(written).alias("order_date"))


# --- features ------------------------------------------------------------------


@query
def star_join_(m):
    return star_join(m.tables).select(
        "return_id", "order_id", "user_id", "product_id", "seller_id", "category",
        "reason_category", "return_type", "image_uploaded", "return_request_date", "order_date",
        "delivery_date", "order_value", "discount_pct", "is_prepaid", "account_age_days",
        "email_verified", "shared_device_flag", "phone_verified", "user_registration_date",
        "price", "review_count", "return_window_days", "is_non_returnable", "seller_age_days",
        "seller_rating", "seller_return_rate", "seller_customer_frequency", "seller_type",
        "seller_registration_date", "category_base_defect", "total_orders_at_time",
        "total_returns_at_time", "fraud_type", "label",
    )


QUERIES["star_join"] = QUERIES.pop("star_join_")


@query
def base_feature_columns(m):
    return base_features(star_join(m.tables)).select(
        "return_id", "account_creation_date", "days_since_delivered", "return_to_order_ratio"
    )


QUERIES["base_features"] = QUERIES.pop("base_feature_columns")


def _select(name: str, *columns: str) -> None:
    QUERIES[name] = lambda spark, path: plain(
        features(mart(spark, path)).select("return_id", *columns)
    )


_select("recency_features", "prev_return_date", "days_since_last_return")
_select(
    "user_value_features", "past_order_value_sum", "past_returns_count", "user_avg_order_value",
    "order_value_ratio", "is_high_value_return",
)
_select(
    "ratio_features", "is_weekend_return", "weekend_return_ratio", "is_same_category",
    "same_category_return_ratio", "high_value_return_ratio",
)
_select("seller_repeat", "past_seller_returns", "seller_repeat_ratio")
_select("velocity_features", "returns_last_30d", "returns_last_90d", "return_frequency_score")


@query
def velocity_stream(m):
    """The velocity counts from a stream that gets the returns in three parts by date; the
    days around a cut come twice."""
    rows = durable(star_join(m.tables).select("return_id", "user_id", "return_request_date", "order_date"))
    day = F.unix_date("return_request_date")
    cuts = rows.agg(F.percentile_approx(day, [1 / 3, 2 / 3]).alias("q"), F.max(day).alias("last")).first()
    source, history, checkpoint = (new_path(m.spark) for _ in range(3))
    edges = [None, *(cuts["q"] or [0, 0]), None]
    for low, high in zip(edges, edges[1:]):
        part = rows if low is None else rows.where(day > low - 3)
        (part if high is None else part.where(day <= high)).write.mode("append").parquet(source)
        if high is None:
            closing = date(1970, 1, 1) + timedelta(days=(cuts["last"] or 0) + 30)
            velocity.close_days(m.spark, source, closing.isoformat())
        velocity.update_history(m.spark, source, history, checkpoint)
    busy = hot_keys(rows, ["user_id", "return_request_date"])
    told = velocity.velocity(rows, m.spark.read.parquet(history), busy)
    return told.select("return_id", "returns_last_30d", "returns_last_90d", "return_frequency_score")


_select("manual_verification", "requires_manual_verification")
_select("full_features", *ALL_FEATURES, "target")


@query
def full_features_split(m):
    """The features with the histories of busier users cut into blocks."""
    busy = hot_keys(m.orders, ["user_id"], 20)
    return full_features(m.tables, busy, narrow=True).select("return_id", *ALL_FEATURES, "target")


@query
def case_view(m):
    return texts.case_view(features(m))


# --- catalogue -----------------------------------------------------------------


@query
def returnability(m):
    joined = m.orders.join(m.products, "product_id")
    kept = catalog.returnable(
        F.col("is_returned"), F.col("is_non_returnable"), F.col("return_window_days")
    )
    return joined.select("order_id", kept.alias("is_returned"))


@query
def order_value_calc(m):
    joined = m.orders.join(m.products.select("product_id", "price"), "product_id")
    value = catalog.discounted_value(F.col("price"), F.col("discount_pct"))
    return joined.select("order_id", value.alias("order_value"))


@query
def window_fields(m):
    windows = m.products.select("product_id", "return_window_days")
    rows = m.scored.select("return_id", "product_id", "return_request_date", "delivery_date")
    # Every fifth product has no window, which counts as the default one.
    windows = windows.withColumn(
        "return_window_days",
        F.when(F.col("product_id") % 5 == 0, 0).otherwise(F.col("return_window_days")),
    )
    return catalog.window_fields(rows.join(windows, "product_id")).select(
        "return_id", "effective_window", "days_after_delivery", "within_window", "days_left"
    )


@query
def price_band(m):
    limits = [("budget", 0.0, 950.0), ("mid", 940.0, 1000.0), ("premium", 1e6, 2e6)]
    rows = [(s, c, lo, hi) for s, lo, hi in limits for c in CATEGORIES]
    names = ["segment", "category", "price_lo", "price_hi"]
    bands = small_table(m.spark, {n: list(v) for n, v in zip(names, zip(*rows))})
    return catalog.price_band(scans.decode_products(m.tables), bands)


def portfolios(m: Mart) -> DataFrame:
    """Sellers with the categories they stock and their number of orders."""
    named = scans.decode_sellers(m.tables).select("seller_id", "seller_type", "category_specialization")
    names = F.lit(CATEGORIES)
    following = names[F.array_position(names, F.col("category_specialization")) % len(CATEGORIES)]
    sold = m.orders.groupBy("seller_id").agg(F.count(F.lit(1)).alias("order_weight"))
    return (
        named.withColumn(
            "categories",
            F.when(F.col("seller_type") == "general_marketplace", names).otherwise(
                F.array("category_specialization", following)
            ),
        )
        .join(sold, "seller_id", "left")
        .withColumn("order_weight", F.coalesce("order_weight", F.lit(0)))
    )


@query
def seller_eligibility(m):
    listed = small_table(m.spark, {"category": CATEGORIES + ["Grocery"]})
    return catalog.seller_eligibility(portfolios(m), listed).select(
        "category", "seller_id", "order_weight", "fallback", "share"
    )


@query
def portfolio_mismatch(m):
    return catalog.portfolio_mismatch(m.orders, scans.decode_products(m.tables), portfolios(m))


@query
def popularity_weights(m):
    boosted = F.col("seller_type") == "general_marketplace"
    order = [F.desc("sold"), F.asc("seller_id")]
    sellers = portfolios(m).select("seller_id", "seller_type", F.col("order_weight").alias("sold"))
    return catalog.popularity_weights(sellers, order, boosted).select(
        "seller_id", "popularity_rank", "order_weight"
    )


@query
def renumber(m):
    rows = m.orders.select("order_id", "order_date")
    return catalog.renumber(rows, ["order_date", "order_id"], "ORD_", 8, "new_order_id").select(
        "order_id", "new_order_id"
    )


@query
def apportion(m):
    weights = m.orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("weight"))
    return catalog.apportion(weights, "user_id", "weight", 33_000, "planned_orders")


@query
def apportion_fractional(m):
    weights = m.orders.groupBy("user_id").agg((F.count(F.lit(1)) * 0.25 + 0.5).alias("weight"))
    return catalog.apportion(weights, "user_id", "weight", 33_000, "planned_orders")


@query
def gap_chain(m):
    first = m.users.select("user_id", "registration_date")
    rows = m.orders.select(
        "order_id", "user_id", "order_date", (1 + F.col("product_id") % 45).alias("gap")
    ).join(first, "user_id")
    return user_state.gap_chain(
        rows, "user_id", ["order_date", "order_id"], ["order_date"], "registration_date", "gap",
        F.lit(END_DATE).cast("date"), m.hot_users,
    ).select("order_id", "user_id", "position", "event_date")


# --- state and scores ----------------------------------------------------------


@query
def as_of_state(m):
    return user_state.as_of_state(m.requests, m.orders).select(
        "return_id", "total_orders_at_time", "orders_value_at_time"
    )


@query
def return_state(m):
    return user_state.return_state(m.requests, m.hot_users).select(
        "return_id", "total_returns_at_time", "returns_30d_by_order", "seller_returns_at_time"
    )


@query
def fraud_score(m):
    return m.scored.select(
        "return_id", F.round("fraud_score", 9).alias("fraud_score"),
        F.round("fraud_probability", 6).alias("fraud_probability"), "label",
    )


@query
def calibrated_threshold(m):
    found = scoring.calibrate_threshold(m.scored, "fraud_score")
    share = F.avg(scoring.fraud_probability(F.col("fraud_score"), F.lit(found)))
    return m.scored.agg(F.round(share, 6).alias("mean_probability")).withColumn(
        "threshold", F.round(F.lit(found), 6)
    )


@query
def fraud_labels(m):
    draw = scoring.seeded_uniform("return_id", 42)
    label = scoring.label_by_draw(F.col("fraud_probability"), draw)
    return m.scored.select("return_id", label.alias("label"))


# --- evaluation ----------------------------------------------------------------


def labelled(m: Mart) -> DataFrame:
    """Returns with the label and a fixed score, coarse enough to have ties."""
    return m.scored.select(
        "return_id", "return_request_date", "order_date",
        yes(F.col("label") == "fraud").alias("target"),
        (F.floor(F.col("fraud_probability") * 1000) / 1000).alias("score"),
    )


@query
def temporal_split(m):
    return evaluate.temporal_split(labelled(m)).select("return_id", "split")


@query
def split_summary(m):
    return evaluate.split_summary(evaluate.temporal_split(labelled(m)), "target")


@query
def classification_report(m):
    rows = labelled(m).withColumn("predicted", yes(F.col("score") >= 0.5))
    return evaluate.classification_report(rows, "target", "predicted")


@query
def roc_auc(m):
    return evaluate.roc_auc(evaluate.score_curve(labelled(m), "score", "target"))


@query
def recall_at_fpr(m):
    return evaluate.recall_at_fpr(evaluate.score_curve(labelled(m), "score", "target"))


@query
def threshold_sweep(m):
    return evaluate.threshold_sweep(labelled(m), "score", "target")


@query
def sample_cases(m):
    test = evaluate.temporal_split(labelled(m)).where("split = 'test'")
    return evaluate.sample_rows(test.select("return_id"), "return_id", 100)


# --- profiles ------------------------------------------------------------------


@query
def value_counts(m):
    return profile.value_counts(scans.decode_returns(m.tables), "reason_category")


@query
def describe_by_group(m):
    out = profile.describe_by_group(m.scored, "reason_category", "order_value")
    numbers = [c for c in out.columns if c not in ("reason_category", "count")]
    return out.withColumns({c: F.round(c, 4) for c in numbers})


@query
def group_mean(m):
    sellers = scans.decode_sellers(m.tables)
    return profile.group_mean(sellers, "seller_type", "seller_return_rate").withColumn(
        "mean", F.round("mean", 6)
    )


@query
def fraud_rate_by_type(m):
    return profile.rate_by_type(
        scans.decode_returns(m.tables), "fraud_type", F.col("label") == "fraud"
    )


@query
def table_profile(m):
    found = profile.table_profile(
        m.orders, ["order_value", "discount_pct", "is_prepaid", "is_returned"]
    )
    return found.withColumns({"sum": F.round("sum", 2), "mean": F.round("mean", 6)})


@query
def age_buckets(m):
    sellers = scans.decode_sellers(m.tables)
    binned = sellers.withColumn("age_group", profile.bin_label(F.col("seller_age_days")))
    return binned.groupBy("age_group").agg(
        F.count(F.lit(1)).alias("sellers"), F.round(F.avg("seller_rating"), 6).alias("mean_rating")
    )


@query
def integrity_report(m):
    return profile.integrity_report(m.users, m.sellers, m.products, m.orders, m.returns)


@query
def category_codes_(m):
    return category_codes(star_join(m.tables))


QUERIES["category_codes"] = QUERIES.pop("category_codes_")


# --- rules and verdicts --------------------------------------------------------


@query
def rule_hits(m):
    return rules.rule_hits(ruled(m))


@query
def rule_scores(m):
    return ruled(m).select(
        "return_id", "rule_score", "hard_rule_triggered", "total_rules_checked",
        "rules_triggered_count",
    )


@query
def rule_summary(m):
    return rules.rule_summary(ruled(m))


@query
def combined_score(m):
    score = scoring.combined_score(F.col("risk_score"), F.col("rule_score"))
    return signals(m).select("return_id", F.round(score, 6).alias("combined_score"))


@query
def risk_band(m):
    score = scoring.combined_score(F.col("risk_score"), F.col("rule_score"))
    return signals(m).select(
        "return_id",
        risk(),
        policy.risk_band(F.col("risk_score")).alias("risk_band"),
        policy.score_only_band(score).alias("score_only_band"),
        policy.confidence_band(F.col("confidence")).alias("confidence_band"),
    )


@query
def verdict(m):
    return decided(m).select("return_id", risk(), "confidence", "escalation_count", "verdict")


@query
def verdict_summary(m):
    return profile.verdict_summary(triage.final_verdict(decided(m)))


@query
def escalation_queue(m):
    queue = triage.final_verdict(decided(m)).where(F.col("verdict") == "Escalate")
    return queue.select("return_id", "user_id", risk(), "rule_score", "escalation_count")


@query
def deciding_signal(m):
    return decided(m).select("return_id", "deciding_signal")


@query
def trusted_override(m):
    return decided(m).select("return_id", F.col("past_fraud").alias("prior_fraud"), "trusted_override")


@query
def boundary_escalation(m):
    return decided(m).select("return_id", "boundary_escalation")


@query
def same_item_burst(m):
    return policy.same_item_burst(m.scored)


@query
def last_day_pattern(m):
    return policy.last_day_pattern(m.scored, hot=m.hot_users).select(
        "return_id", "is_last_day", "prior_last_day", "last_day_pattern"
    )


@query
def pair_concentration(m):
    return policy.pair_concentration(m.scored)


@query
def probe_eval(m):
    first = F.coalesce(F.try_element_at("triggered_rules", F.lit(1))["rule_id"], F.lit(""))
    bucket = (
        F.when(first == "R0_NON_RETURNABLE", "non_returnable")
        .when(F.col("boundary_escalation") == 1, "one_day_late")
        .when(F.col("trusted_override") == 1, "trusted_override")
        .when(first.startswith("R0_"), "clean_fraud")
        .when(first == "", "clean_legitimate")
        .otherwise(first)
    )
    expected = (
        F.when(bucket.isin("non_returnable", "clean_fraud"), "Auto-Reject")
        .when(bucket.isin("clean_legitimate", "trusted_override"), "Auto-Approve")
        .otherwise("Escalate")
    )
    rows = triage.final_verdict(decided(m)).select(
        bucket.alias("bucket"), expected.alias("expected_verdict"), "verdict"
    )
    targets = small_table(
        m.spark, {"bucket": list(PROBE_TARGETS), "target": list(PROBE_TARGETS.values())}
    )
    return policy.probe_eval(rows, targets)


def documented(rows: DataFrame | Mart) -> DataFrame:
    """Decided cases, or those of a mart, with what documents them."""
    if isinstance(rows, Mart):
        rows = triage.final_verdict(decided(rows))
    return triage.with_dossier(rows.withColumn("fraud_probability", F.col("risk_score")))


@query
def audit_check(m):
    """Decisions of some products lose a field on the way, to be noticed here."""
    lost = lambda c, r: F.when(F.col("product_id") % 10 == r, F.lit(None)).otherwise(F.col(c))
    rows = documented(triage.final_verdict(decided(m))).withColumns(
        {"policy_clause": lost("policy_clause", 1), "dossier": lost("dossier", 2),
         "reasoning": lost("reasoning", 3)}
    )
    return policy.audit_check(rows).select("return_id", "missing_fields", "complete")


@query
def case_dossier(m):
    rows = documented(triage.final_verdict(decided(m)))
    return rows.select("return_id", texts.dossier_text(rows).alias("dossier"))


@query
def audit_log(m):
    rows = documented(triage.final_verdict(decided(m))).withColumn("confidence", F.col("confidence").cast("string"))
    fields = triage.case_record_fields(rows)
    records = texts.audit_record(rows, fields, F.lit("2024-01-01 00:00:00"))
    # Written as JSON and read back, as the log is.
    line = F.to_json(F.struct("*"))
    back = records.select(F.from_json(line, DECISION_LOG).alias("r")).select("r.*")
    case = F.col("inputs.case_data")
    return back.select(
        "timestamp",
        "return_id",
        F.get_json_object(case, "$.category").alias("category"),
        F.get_json_object(case, "$.order_date").alias("order_date"),
        F.get_json_object(case, "$.order_value").cast("double").alias("order_value"),
        "inputs.rule_score",
        F.array_join("inputs.triggered_rules.rule_id", ",").alias("rules"),
        "outputs.verdict",
        F.col("outputs.confidence").cast("double").alias("confidence"),
        F.col("outputs.reasoning_chain").alias("reasoning"),
    )


@query
def invalid_cases(m):
    broken = star_join(m.tables).withColumns(
        {
            "user_id": F.when(F.col("product_id") % 97 == 0, F.lit(None)).otherwise(F.col("user_id")),
            "delivery_date": F.when(
                F.col("seller_id") % 53 == 0, F.date_sub("order_date", 1)
            ).otherwise(F.col("delivery_date")),
            "order_value": F.when(F.col("product_id") % 89 == 0, F.lit(0.0)).otherwise(
                F.col("order_value")
            ),
        }
    )
    _, rejected = triage.split_valid(broken)
    return rejected.select("return_id", "faults")


@query
def backlog_batch(m):
    return backlog.next_batch(m.returns, m.returns.where("days_left_to_return = 0"), 100)


# --- replies -------------------------------------------------------------------


@query
def parse_verdict(m):
    kind = F.col("product_id") % 6
    parts = F.array(
        F.struct(F.lit("VERDICT: Auto-Reject").alias("text")),
        F.struct(F.lit(None).cast("string").alias("text")),
        F.struct(F.concat(F.lit("CONFIDENCE: Low for "), F.col("return_id")).alias("text")),
    )
    reply = (
        F.when(kind == 0, F.concat(F.lit("VERDICT: Auto-Approve\nCONFIDENCE: High\nREASONING:\n"), F.col("return_id")))
        .when(kind == 1, F.concat(F.col("return_id"), F.lit("\nverdict: \t auto-reject; confidence:low")))
        .when(kind == 2, F.concat(F.lit("nothing decided for "), F.col("return_id")))
        .when(kind == 3, F.lit("VERDICT: Maybe\nVERDICT: Escalate\nVERDICT: Auto-Approve\nCONFIDENCE: MEDIUM"))
        .when(kind == 4, texts.flatten_reply(parts))
    )
    rows = m.scored.select("return_id", reply.alias("reply"))
    return rows.withColumns(texts.parse_verdict(F.col("reply"))).drop("reply")


@query
def parse_evidence(m):
    kind = F.col("product_id") % 5
    id_ = F.col("return_id")
    reply = (
        F.when(kind == 0, F.concat(F.lit("CONSISTENCY: 5\nRED_FLAGS: none\nASSESSMENT: fits "), id_))
        .when(kind == 1, F.concat(F.lit("  consistency: 2 of 5\n red_flags: blur , ,reuse\nassessment: see: "), id_))
        .when(kind == 2, F.concat(F.lit("no structure for "), id_))
        .when(kind == 3, F.lit("CONSISTENCY: 4\nCONSISTENCY: x\nRED_FLAGS: a\nRED_FLAGS: NONE\nASSESSMENT: one\nASSESSMENT: two"))
        .otherwise(F.lit("CONSISTENCY:\nRED_FLAGS:\nASSESSMENT:"))
    )
    parsed = m.scored.select("return_id", reply.alias("reply")).withColumns(
        texts.parse_evidence(F.col("reply"))
    )
    return parsed.withColumn("red_flags", F.array_join("red_flags", "|")).drop("reply")


def marked_turns(m: Mart, marks: list[str]) -> DataFrame:
    """The conversations, with one of `marks` before or behind each whole text. The texts of the
    tables hold none of their own."""
    n = F.col("conv_id") * 7 + F.col("turn") * 3
    mark = F.element_at(F.array(*map(F.lit, marks)), (n % len(marks) + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    placed = F.when(n % 2 == 0, F.concat(mark, F.lit("\n"), text)).otherwise(F.concat(text, F.lit("\n"), mark))
    return m.raw("conversations").select("conv_id", "turn", "role", placed.alias("text"))


def no_turn(df: DataFrame) -> DataFrame:
    """-1 for a turn that isn't there, so that both engines report whole numbers."""
    return df.fillna(-1, [c for c in df.columns if c.endswith("_turn")])


@query
def conversation_verdicts(m):
    return no_turn(texts.conversation_verdicts(marked_turns(m, VERDICT_MARKS)))


@query
def conversation_evidence(m):
    found = texts.conversation_evidence(marked_turns(m, EVIDENCE_MARKS))
    return no_turn(found.withColumn("red_flags", F.array_join("red_flags", "|")))


# --- retrieval -----------------------------------------------------------------


def whole_documents(m: Mart) -> DataFrame:
    return m.raw("documents").select(F.col("doc_id").alias("chunk_id"), "source", "text")


@lru_cache(maxsize=8)
def document_index(m: Mart) -> retrieval.LexicalIndex:
    return retrieval.build_index(whole_documents(m))


def text_queries(m: Mart) -> DataFrame:
    return m.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vector_queries(m: Mart) -> DataFrame:
    """The embeddings whose id is divisible by 20, asked against all."""
    chosen = m.raw("embeddings").where("vec_id % 20 = 0")
    return chosen.select(F.col("vec_id").alias("query_id"), "embedding")


def vectors(m: Mart) -> DataFrame:
    return m.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


@query
def term_stats(m):
    return document_index(m).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_topk(m):
    return retrieval.bm25_topk(text_queries(m), document_index(m))


@lru_cache(maxsize=8)
def document_tiles(m: Mart) -> block_max.TileIndex:
    return block_max.build_tiles(document_index(m))


@query
def pruned_bm25_topk(m):
    return block_max.pruned_bm25(text_queries(m), document_tiles(m))


@query
def pruned_bm25_work(m):
    return block_max.search_work(text_queries(m), document_tiles(m))


@query
def vector_topk(m):
    return retrieval.vector_topk(vector_queries(m), vectors(m))


@lru_cache(maxsize=8)
def cell_index(m: Mart) -> vector_index.CellIndex:
    return vector_index.build_cells(vectors(m))


@query
def pruned_vector_topk(m):
    return vector_index.pruned_topk(vector_queries(m), cell_index(m))


@query
def pruned_vector_recall(m):
    """What the pruned search finds of the exhaustive one, and how many pairs it scores."""
    exact = retrieval.vector_topk(vector_queries(m), vectors(m))
    found = vector_index.pruned_topk(vector_queries(m), cell_index(m))
    work = vector_index.search_work(vector_queries(m), cell_index(m))
    # One row each.
    return vector_index.recall(found, exact).withColumn("one", F.lit(1)).join(work.withColumn("one", F.lit(1)), "one").drop("one")


def fused(m: Mart) -> DataFrame:
    """Each text query goes with a vector of its own, that of vec_id 20 * item_id if there is
    one; documents and embeddings share their ids."""
    lexical = retrieval.bm25_topk(text_queries(m), document_index(m))
    near = retrieval.vector_topk(vector_queries(m), vectors(m)).withColumn("item", F.expr("query_id div 20")).drop("query_id")
    items = text_queries(m).select("query_id")
    return retrieval.rrf_fuse(lexical, items.join(near, items["query_id"] == near["item"]).drop("item"))


@query
def rrf_fuse(m):
    return fused(m)


@query
def policy_query_text(m):
    rows = star_join(m.tables)
    return rows.select(
        "return_id",
        retrieval.case_query(rows).alias("case_query"),
        retrieval.policy_query(rows).alias("policy_query"),
    )


@query
def policy_context(m):
    return retrieval.policy_context(fused(m), whole_documents(m))


def chunks(m: Mart) -> DataFrame:
    docs = m.raw("documents").select(F.col("doc_id").alias("source"), "text")
    return retrieval.chunk_documents(docs, paragraph_mark="\n")


@query
def chunk_documents(m):
    return chunks(m)


@lru_cache(maxsize=8)
def chunk_index(m: Mart) -> retrieval.LexicalIndex:
    return retrieval.build_index(chunks(m))


@query
def chunk_term_stats(m):
    return chunk_index(m).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def chunk_search(m):
    return retrieval.bm25_topk(text_queries(m), chunk_index(m))


# --- model ---------------------------------------------------------------------


@lru_cache(maxsize=4)
def matrix(m: Mart) -> DataFrame:
    """Feature matrix with the split; codes are fit on the training rows."""
    rows = split_features(m)
    found = feature_matrix(rows, train_codes(m), ["split"])
    # Each row goes with every split of its return_id; few rows repeat one. Counted by hash: where
    # two ids have one, the join gives the same rows.
    ids = rows.select(F.xxhash64("return_id").alias("h"), F.col("return_id").isNull().alias("none"))
    counts = ids.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("none").alias("none"))
    if counts.where("n > 1 OR none").isEmpty():
        return found  # of the stored features, by lookups of few codes: not stored once more
    return durable(found.drop("split").join(rows.select("return_id", "split"), "return_id"))


@lru_cache(maxsize=4)
def split_features(m: Mart) -> DataFrame:
    needed = ["return_id", "return_request_date", "order_date", *ALL_FEATURES, *CATEGORICAL_FEATURES, "target"]
    return evaluate.temporal_split(durable(features(m).select(*dict.fromkeys(needed))))


@lru_cache(maxsize=4)
def train_codes(m: Mart) -> DataFrame:
    return durable(category_codes(split_features(m).where("split = 'train'")))


@lru_cache(maxsize=4)
def model_path(m: Mart) -> str:
    held_out = matrix(m).withColumn("held_out", F.col("split") == "test")
    path = new_path(m.spark)
    ml.save_model(ml.train(held_out, ModelParams(), "held_out"), path, train_codes(m))
    return path


@query
def feature_matrix_(m):
    return matrix(m)


QUERIES["feature_matrix"] = QUERIES.pop("feature_matrix_")


@query
def score_risk(m):
    scored = ml.score(ml.load_model(model_path(m)), matrix(m))
    return scored.select("return_id", "fraud_probability", "prediction", "target")


@query
def train_risk_model(m):
    """Hold-out report of the trained model."""
    scored = ml.score(ml.load_model(model_path(m)), matrix(m).where("split = 'test'"))
    return evaluate.classification_report(scored, "target", "prediction")


@query
def feature_importance(m):
    return ml.feature_importance(m.spark, ml.load_model(model_path(m)))


@query
def explain_risk(m):
    trees = ml.tree_table(m.spark, model_path(m))
    explained = ml.explain(matrix(m), trees)
    return explained.select("return_id", "base_value", F.inline("attributions"))


@query
def explain_fallback(m):
    importance = ml.feature_importance(m.spark, ml.load_model(model_path(m)))
    explained = ml.explain_by_importance(matrix(m), importance)
    return explained.select("return_id", F.inline("attributions"))


@query
def model_codes(m):
    """The category codes stored with the model."""
    return ml.load_codes(m.spark, model_path(m))


@query
def model_triage(m):
    """Every return encoded with the stored codes, scored, explained and decided."""
    path = model_path(m)
    # The features are stored already, with the split that is not used here.
    encoded = feature_matrix(split_features(m), ml.load_codes(m.spark, path))
    risk = ml.score(ml.load_model(path), encoded).select(
        "return_id", "fraud_probability", F.col("fraud_probability").alias("risk_score")
    )
    rows = ruled(m).join(risk, "return_id").join(ml.explain(encoded, ml.tree_table(m.spark, path)), "return_id")
    rows = triage.with_signals(rows, confidence(), bursts(m))
    rows = triage.with_dossier(triage.final_verdict(triage.decide_cases(rows)))
    return rows.select(
        "return_id", "fraud_probability", "rule_score", "combined_score", "base_value", "deciding_signal",
        "verdict", F.array_join(F.transform("attributions", lambda a: a["feature"]), ",").alias("top_features"), "dossier",
    )


# --- stored and read back --------------------------------------------------------


@query
def csv_export(m):
    path = new_path(m.spark)
    files.write_csv(m.orders, path)
    return m.spark.read.schema(m.orders.schema).option("header", True).csv(path)


@query
def split_export(m):
    path = new_path(m.spark)
    files.write_split(evaluate.temporal_split(labelled(m)).select("return_id", "target", "split"), path)
    return m.spark.read.parquet(path).select("return_id", "target", F.col("split").cast("string").alias("split"))


@query
def index_round_trip(m):
    path = new_path(m.spark)
    retrieval.save_index(document_index(m), path)
    index = retrieval.load_index(m.spark, path)
    return index.terms.select("term", "df", F.lit(index.chunks).alias("chunks"))


@query
def decision_log(m):
    """Two appends and some broken lines, read back."""
    path = new_path(m.spark)
    # Decided once and stored, as the two appends read the rows one after another.
    rows = documented(durable(triage.final_verdict(decided(m))))
    rows = rows.withColumn("confidence", F.col("confidence").cast("string"))
    records = texts.audit_record(rows, triage.case_record_fields(rows), F.lit("2024-01-01 00:00:00"))
    even = F.pmod(F.hash("return_id"), F.lit(2)) == 0
    files.append_decisions(records.where(even), path)
    files.append_decisions(records.where(~even), path)
    m.returns.select(F.concat(F.lit('{"return_id": "'), "return_id").alias("value")).write.mode("append").option("compression", "gzip").text(path)
    log = files.read_decision_log(m.spark, path)
    return log.select("return_id", "outputs.verdict", "inputs.rule_score")


@query
def batch_run(m):
    """Two batches over the newest returns, as the log and the queue hold them."""

    def decide(tables):
        rows = triage.cases(tables, m.hot_users).join(
            m.scored.select("return_id", F.col("fraud_probability").alias("risk_score")), "return_id"
        )
        rows = triage.decide_cases(triage.with_signals(rows, confidence(), bursts(m)))
        return triage.with_dossier(triage.final_verdict(rows).withColumn("fraud_probability", F.col("risk_score")))

    log, queue = new_path(m.spark), new_path(m.spark)
    for n in (120, 80):
        backlog.run_batch(m.tables, log, queue, n, decide, "2024-01-01 00:00:00", probes(m))
    queued = files.read_decision_log(m.spark, queue).select("return_id", F.lit(1).alias("queued"))
    return files.read_decision_log(m.spark, log).join(queued, "return_id", "left").select(
        "return_id", "outputs.verdict", F.coalesce("queued", F.lit(0)).alias("queued"),
        F.get_json_object("inputs.case_data", "$.image_path").alias("image_path"),
    )


@query
def single_case(m):
    """The newest return by its id, decided."""
    newest = m.returns.orderBy(F.desc("return_request_date"), "return_id").first()["return_id"]
    case = triage.one_case(triage.final_verdict(decided(m)), newest)
    return case.select("return_id", *ALL_FEATURES, "rule_score", "deciding_signal", "verdict")


# --- flagship ------------------------------------------------------------------


def flagship(spark: SparkSession, path: str) -> DataFrame:
    """Every return decided: features, rules, risk, verdict."""
    m = mart(spark, path)
    rows = triage.final_verdict(decided(m))
    return plain(
        rows.select(
            "return_id", "user_id", "order_value", "rule_score", "risk_score", "combined_score",
            "rules_triggered_count", "risk_band", "deciding_signal", "verdict",
        ).orderBy(F.desc("combined_score"), "return_id")
    )
