"""Table scans with lookup decoding.

Lookup tables are left to Spark's own size-based choice of join: small ones are
broadcast, larger ones are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelwise.sources.schema import RISK, Tables


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low, high, parts: int) -> DataFrame:
    """Parallel scan of a database table, split on a numeric or date key."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=key,
            lowerBound=str(low), upperBound=str(high), numPartitions=str(parts),
        )
        .load()
    )


def _decode(df: DataFrame, lookup: DataFrame, fk: str, output: str) -> DataFrame:
    key, name = lookup.columns
    side = lookup.select(F.col(key).alias(fk), F.col(name).alias(output))
    return df.join(side, fk, "left")


#: Per table its columns once decoded; for a name that comes from a lookup its key and the lookup.
RETURNS = {
    "return_id": None, "order_id": None,
    "reason_category": ("reason_category_id", "reason_categories"),
    "return_type": ("return_type_id", "return_types"),
    "image_uploaded": None, "return_request_date": None, "within_return_window": None, "days_left_to_return": None,
    "total_orders_at_time": None, "total_returns_at_time": None,
    "fraud_type": ("fraud_id", "fraud_types"), "label": ("label_id", "label_types"),
}
PRODUCTS = {
    "product_id": None, "category": ("product_category_id", "product_categories"),
    "price": None, "is_non_returnable": None, "review_count": None, "sku": None,
    "category_base_defect_rate": None, "return_window_days": None, "base_defect_rate": None,
}
SELLERS = {
    "seller_id": None, "seller_age_days": None, "seller_rating": None, "seller_return_rate": None,
    "seller_customer_frequency": None, "seller_type": ("seller_type_id", "seller_types"),
    "category_specialization": ("category_specialization_id", "product_categories"),
    "rating": None, "registration_date": None,
}


def undecoded(df: DataFrame, names: dict) -> DataFrame:
    """The columns that `decoded` needs of a table."""
    return df.select(*[name if way is None else way[0] for name, way in names.items()], *[c for c in df.columns if c == RISK])


def decoded(df: DataFrame, lookups: dict[str, DataFrame], *tables: dict) -> DataFrame:
    """With the names behind the keys of these tables, whose columns may have been joined to others."""
    for names in tables:
        for name, way in names.items():
            if way is not None:
                df = _decode(df, lookups[way[1]], way[0], name)
    return df


def decode_returns(tables: Tables) -> DataFrame:
    df = decoded(tables.returns, tables.lookups, RETURNS)
    return df.select(*RETURNS, *[c for c in df.columns if c == RISK])


def decode_products(tables: Tables) -> DataFrame:
    return decoded(tables.products, tables.lookups, PRODUCTS).select(*PRODUCTS)


def decode_sellers(tables: Tables) -> DataFrame:
    return decoded(tables.sellers, tables.lookups, SELLERS).select(*SELLERS)


def drop_internal(df: DataFrame, named: tuple[str, ...] = ("seller_order_weight",)) -> DataFrame:
    """Drop columns whose name starts with an underscore, and the named ones."""
    return df.drop(*[c for c in df.columns if c.startswith("_")], *named)
