"""Point-in-time features of return requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelwise.config import (
    ALL_FEATURES, CATEGORICAL_FEATURES, CATEGORY_DEFECT_RATE, POSITIVE_LABELS,
)
from parcelwise.functions.columns import at_least_one, from_money, money, nan_to_null, ratio, yes
from parcelwise.operators.scale import HOT, LONE, Timeline, lone
from parcelwise.session import small_table, spread
from parcelwise.sources.schema import RISK, Tables
from parcelwise.sources.tables import PRODUCTS, RETURNS, SELLERS, decoded, undecoded

REQUEST_ORDER = ["return_request_date", "order_date", "return_id"]
REQUEST_CUT = ["return_request_date", "order_date"]
#: What the history and the flags are made of, besides model features.
HISTORY_INPUTS = [
    "return_id", "user_id", "seller_id", "category", "order_value", "return_request_date", "order_date",
    "total_returns_at_time", "label", "image_uploaded", "return_to_order_ratio", LONE, HOT,
]


def star_join(tables: Tables) -> DataFrame:
    """Returns with their order, user, product, seller and category constant."""
    return _star(tables, None).drop(LONE)


def _star(tables: Tables, parts: int | None, hot: DataFrame | None = None) -> DataFrame:
    """The star join, and LONE as `Timeline` of users has it; with `hot` also its mark HOT of these users.

    Users come last, joined in as many partitions as `parts` tells and dealt by the keys of
    the history windows, which then take the rows where they are. Names behind keys come
    after that: tables join as they are stored, so their size is known and rows move narrow.
    """
    rates = small_table(
        tables.returns.sparkSession,
        {
            "category": list(CATEGORY_DEFECT_RATE),
            "category_base_defect": list(CATEGORY_DEFECT_RATE.values()),
        },
    )
    users = tables.users.withColumnRenamed("registration_date", "user_registration_date")
    sellers = undecoded(tables.sellers, SELLERS).withColumnRenamed(
        "registration_date", "seller_registration_date"
    )
    returns, products = undecoded(tables.returns, RETURNS), undecoded(tables.products, PRODUCTS)
    # A join puts its key first: the columns as if users came behind the orders.
    names = [*RETURNS, *[c for c in returns.columns if c == RISK]]
    seller_names = [{"registration_date": "seller_registration_date"}.get(c, c) for c in SELLERS]
    sides = [
        (tables.orders.columns, "order_id"), (users.columns, "user_id"), (PRODUCTS, "product_id"),
        (seller_names, "seller_id"), (rates.columns, "category"),
    ]
    for side, key in sides:
        names = [key, *[c for c in names if c != key], *[c for c in side if c != key]]
    joined = (
        spread(returns, tables.parts, "order_id")
        .join(spread(tables.orders, tables.parts, "order_id"), "order_id", "left")
        .join(products, "product_id", "left")
        .join(sellers, "seller_id", "left")
        .withColumn(LONE, lone(["user_id"], "return_id"))
    )
    more = [LONE]
    if hot is not None:
        # The mark comes with the user, also of those that the table lacks, so rows are not dealt for it again.
        users, more = users.join(hot.withColumn(HOT, F.lit(True)), "user_id", "full"), [LONE, HOT]
    # Not a literal, or Spark would drop it from the keys.
    users = users.withColumn(LONE, F.when(F.col("user_id").isNull(), F.lit("-")).otherwise(F.lit("")))
    by_user = ["user_id", LONE]
    joined = spread(joined, parts, *by_user).join(spread(users, parts, *by_user), by_user, "left")
    joined = decoded(joined, tables.lookups, RETURNS, PRODUCTS, SELLERS).join(rates, "category", "left")
    return nan_to_null(joined.select(*names, *more))


def base_features(df: DataFrame) -> DataFrame:
    requested, age = F.col("return_request_date"), F.col("account_age_days").cast("int")
    return df.withColumns(
        {
            "account_creation_date": F.date_sub(requested, age),
            "days_since_delivered": F.datediff(requested, F.col("delivery_date")),
            "return_to_order_ratio": ratio(
                F.col("total_returns_at_time"),
                at_least_one(F.col("total_orders_at_time").cast("bigint")),
            ),
        }
    )


def history_features(
    df: DataFrame, hot: DataFrame | None = None, first_ratio: str = "self", parts: int | None = None
) -> DataFrame:
    """Per-user history of every return, from earlier rows only.

    One shuffle on the user serves all windows; columns a caller does not select
    are pruned with their windows. first_ratio: 'self' compares a user's first
    return with itself, 'null' leaves it open. parts: see `Timeline`.
    """
    t = Timeline.of(df, ["user_id"], REQUEST_ORDER, REQUEST_CUT, hot, parts)
    t = t.add({"is_weekend_return": yes(F.weekday("return_request_date") >= 5)})
    t = t.before(
        sums={
            "past_returns_count": F.lit(1).cast("bigint"),
            "past_value_e4": money(F.col("order_value")),
            "past_weekend": F.col("is_weekend_return").cast("bigint"),
            "past_fraud": confirmed_fraud(df).cast("bigint"),
        },
        lasts={
            "prev_return_date": F.col("return_request_date"),
            "prev_category": F.col("category"),
        },
        until={"past_30": 30, "past_90": 90},
    )

    count = F.col("past_returns_count")
    first = F.col("order_value") if first_ratio == "self" else F.lit(None).cast("double")
    # Whole numbers on both sides of one division.
    mean = ratio(F.col("past_value_e4"), 10000 * count)
    gap = F.datediff(F.col("return_request_date"), F.col("prev_return_date"))
    t = t.add(
        {
            "days_since_last_return": F.coalesce(gap, F.lit(-1)),
            "past_order_value_sum": from_money(F.col("past_value_e4")),
            "user_avg_order_value": F.when(count == 0, first).otherwise(mean),
            "is_same_category": yes(F.col("category") == F.col("prev_category")),
            "weekend_return_ratio": ratio(F.col("past_weekend"), at_least_one(count)),
            # Equal dates before this row count, equal dates after it do not: all
            # earlier rows minus those dated at least 30 / 90 days back.
            "returns_last_30d": count - F.col("past_30"),
            "returns_last_90d": count - F.col("past_90"),
        }
    )
    value, average = F.col("order_value"), F.col("user_avg_order_value")
    month, quarter = F.col("returns_last_30d"), F.col("returns_last_90d")
    t = t.add(
        {
            "order_value_ratio": F.when(average.isNotNull(), value / F.greatest(average, F.lit(1.0))),
            "is_high_value_return": yes(value > average * 1.5),
            "return_frequency_score": month + (quarter - month) * F.lit(0.3),
        }
    )
    t = t.before(
        sums={
            "past_high": F.col("is_high_value_return").cast("bigint"),
            "past_same": F.col("is_same_category").cast("bigint"),
        }
    )
    t = t.before(sums={"past_with_seller": F.lit(1).cast("bigint")}, within=["seller_id"])
    with_seller = F.when(F.col("seller_id").isNull(), 0).otherwise(F.col("past_with_seller"))
    total = at_least_one(F.col("total_returns_at_time").cast("bigint"))
    t = t.add(
        {
            "high_value_return_ratio": ratio(F.col("past_high"), at_least_one(count)),
            "same_category_return_ratio": ratio(F.col("past_same"), at_least_one(count)),
            "past_seller_returns": with_seller,
            "seller_repeat_ratio": ratio(with_seller, total),
        }
    )
    return t.result().drop("past_30", "past_90", "past_with_seller", "past_high", "past_same", "past_weekend")


def confirmed_fraud(df: DataFrame) -> Column:
    """1 for a positive label; 0 otherwise, and where there is no label column."""
    if "label" not in df.columns:
        return F.lit(0)
    return yes(F.lower(F.trim(F.col("label"))).isin(*POSITIVE_LABELS))


def with_flags(df: DataFrame) -> DataFrame:
    verify = (
        (F.col("order_value_ratio") > 2.0)
        & (F.col("image_uploaded") == 0)
        & (F.col("return_to_order_ratio") > 0.3)
    )
    return df.withColumns(
        {"requires_manual_verification": yes(verify), "target": confirmed_fraud(df)}
    )


def full_features(
    tables: Tables, hot: DataFrame | None = None, first_ratio: str = "self", narrow: bool = False
) -> DataFrame:
    """Star join plus every feature and the target, one row per return.

    narrow: without the columns that are neither model features nor made into any. With hot
    users rows are stored on the way, so columns that a caller drops behind it are not pruned.
    """
    # Rows of hot users are dealt in blocks only once they are marked.
    joined = _star(tables, None if hot is not None else tables.parts, hot)
    blocks = tables.parts if hot is not None else None
    based = base_features(joined)
    if narrow:
        based = based.select(*[c for c in based.columns if c in {*HISTORY_INPUTS, *ALL_FEATURES}])
    return with_flags(history_features(based, hot, first_ratio, blocks))


def category_codes(df: DataFrame, columns: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """Alphabetical code of each value of each column: (column, value, code).

    Fit on the training rows and store it; see `encode`.
    """
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
        ).alias("p")
    ).select("p.*")
    values = pairs.where(F.col("value").isNotNull()).distinct()
    position = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    return values.withColumn("code", (position - 1).cast("bigint"))


def encode(df: DataFrame, codes: DataFrame, columns: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """Replace values by their code, unseen and null become -1; keeps <column>_str."""
    for c in columns:
        side = codes.where(F.col("column") == c).select(
            F.col("value").alias(c), F.col("code").alias(f"{c}_code")
        )
        df = df.join(side, c, "left")
        df = df.withColumns({f"{c}_str": F.col(c), c: F.coalesce(f"{c}_code", F.lit(-1))})
        df = df.drop(f"{c}_code")
    return df


def feature_matrix(df: DataFrame, codes: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Id, readable categoricals, the 35 float features in model order, target; and `more` columns."""
    encoded = encode(df, codes)
    readable = [f"{c}_str" for c in CATEGORICAL_FEATURES]
    floats = [F.col(c).cast("float").alias(c) for c in ALL_FEATURES]
    return encoded.select("return_id", *readable, *floats, "target", *(more or []))
