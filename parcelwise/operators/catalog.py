"""Catalogue and allocation steps: order values, windows, bands, weights, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelwise.functions.columns import from_money, ratio, yes
from parcelwise.operators.scale import global_rank, kth_row
from parcelwise.session import durable

# Popularity exponent, marketplace boost, default return window.
POPULARITY_ALPHA = 2.0
MARKETPLACE_BOOST = 1.4
DEFAULT_WINDOW = 7


def returnable(returned: Column, non_returnable: Column, window_days: Column) -> Column:
    """Return flag; a non-returnable product or an empty window is never returned."""
    return F.when((non_returnable == 1) | (window_days == 0), 0).otherwise(returned)


def discounted_value(price: Column, discount_pct: Column) -> Column:
    """Price less discount, to the cent (ties to the even cent), at least 1.

    In whole numbers: price in cents, discount in tenths of a percent.
    """
    cents = F.round(price * 100).cast("bigint")
    tenths = F.round(discount_pct * 10).cast("bigint")
    thousandths = cents * (1000 - tenths)
    whole, rest = F.floor(thousandths / 1000).cast("bigint"), thousandths % 1000
    up = (rest > 500) | ((rest == 500) & (whole % 2 == 1))
    rounded = whole + F.when(up, 1).otherwise(0)
    return ratio(F.greatest(rounded, F.lit(100).cast("bigint")), F.lit(100))


def window_fields(df: DataFrame) -> DataFrame:
    """Add effective window, within flag and days left. An empty window counts as 7 days."""
    days = F.datediff("return_request_date", "delivery_date")
    window = F.when(F.col("return_window_days") > 0, F.col("return_window_days")).otherwise(
        DEFAULT_WINDOW
    )
    return df.withColumns(
        {
            "effective_window": window,
            "days_after_delivery": days,
            "within_window": yes(days <= window),
            "days_left": F.greatest(F.lit(0), window - days),
        }
    )


def price_band(products: DataFrame, bands: DataFrame) -> DataFrame:
    """Products a buyer segment may be offered: those in its price range, or the whole
    category when the range is empty there.

    bands: segment, category, price_lo, price_hi; a short parameter table.
    """
    columns = ["segment", "category", "product_id", "price", "relaxed"]
    offered = products.select("product_id", "category", "price").alias("p").join(
        bands.alias("b"),
        (F.col("p.category") == F.col("b.category")) & F.col("price").between(F.col("price_lo"), F.col("price_hi")),
    ).select("segment", "p.category", "product_id", "price", F.lit(0).alias("relaxed"))
    filled = offered.select("segment", "category").distinct()
    empty = bands.select("segment", "category").distinct().join(filled, ["segment", "category"], "left_anti")
    # Only bands without any product are paired with their whole category.
    whole = products.select("product_id", "category", "price").join(empty, "category")
    return offered.unionByName(whole.withColumn("relaxed", F.lit(1)).select(columns))


def normalised(df: DataFrame, group: str, weight: str, output: str) -> DataFrame:
    """Weight divided by the group's total. Totals are combined before they move, and
    stored, so that the join is a broadcast only when the groups are few. A group whose
    total is 0 has null shares."""
    totals = durable(df.groupBy(group).agg(F.sum(weight).alias("_total")))
    return df.join(totals, group).withColumn(output, ratio(F.col(weight), F.nullif(F.col("_total"), F.lit(0)))).drop(
        "_total"
    )


def seller_eligibility(sellers: DataFrame, categories: DataFrame) -> DataFrame:
    """Sellers that stock each category, with their weight normalised per category.

    sellers: seller_id, categories array, order_weight. categories: category.
    A category no seller stocks falls back to all sellers.
    """
    stocked = sellers.select("seller_id", F.explode("categories").alias("category"), "order_weight")
    stocked = stocked.join(categories, "category", "left_semi")
    empty = categories.join(stocked.select("category").distinct(), "category", "left_anti")
    gaps = empty.agg(F.array_agg("category")).scalar()
    others = sellers.withColumn("gaps", gaps).withColumn("category", F.explode("gaps"))
    listed = stocked.withColumn("fallback", F.lit(0)).unionByName(
        others.select("seller_id", "category", "order_weight", F.lit(1).alias("fallback"))
    )
    return normalised(listed, "category", "order_weight", "share")


def portfolio_mismatch(orders: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    """Orders whose product category is outside the seller's portfolio."""
    return (
        orders.select("order_id", "product_id", "seller_id")
        .join(products.select("product_id", "category"), "product_id")
        .join(sellers.select("seller_id", "categories"), "seller_id")
        .where(~F.array_contains("categories", F.col("category")))
        .select("order_id", "seller_id", "category")
    )


def popularity_weights(
    sellers: DataFrame, order: list, boosted: Column, alpha: float = POPULARITY_ALPHA
) -> DataFrame:
    """Power-law weight by rank, boosted for some sellers, summing to one."""
    ranked = global_rank(sellers, order, "popularity_rank")
    raw = F.pow(F.col("popularity_rank").cast("double"), F.lit(1.0 - alpha))
    raw = raw * F.when(boosted, MARKETPLACE_BOOST).otherwise(1.0)
    weighted = ranked.withColumn("raw_weight", raw)
    total = weighted.agg(F.sum("raw_weight")).scalar()
    return weighted.withColumn("order_weight", F.round(F.col("raw_weight") / total, 8))


def renumber(df: DataFrame, order: list, prefix: str, width: int, output: str) -> DataFrame:
    """Ids numbered in sorted order, zero-padded to `width` and longer when needed."""
    numbered = global_rank(df, order, "position")
    digits = F.col("position").cast("string")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return numbered.withColumn(output, F.concat(F.lit(prefix), padded))


def apportion(df: DataFrame, key: str, weight: str, total: int, output: str) -> DataFrame:
    """Whole numbers proportional to a weight, at least 1, summing to `total`. Weights count
    exactly with up to six decimals.

    What rounding leaves over is added to (or taken from) the largest rows, one
    each; rows tie by key. Halves round to even.
    """
    df = durable(df)
    # Millionths, so that all that follows is whole numbers.
    units = (F.col(weight).cast("decimal(32,6)") * F.lit(1_000_000)).cast("decimal(38,0)")
    weights = df.agg(F.sum(units).cast("decimal(38,0)")).first()[0]
    if not weights:
        return df.withColumn(output, F.lit(None).cast("bigint"))
    exact = (units * F.lit(total)).cast("decimal(38,0)")
    divisor = F.lit(weights).cast("decimal(38,0)")
    whole = F.floor(exact / divisor).cast("bigint")
    # Twice the remainder against the divisor decides the rounding without fractions.
    rest = (exact * 2 - (whole.cast("decimal(20,0)") * 2 * divisor).cast("decimal(38,0)")).cast("decimal(38,0)")
    up = (rest > divisor) | ((rest == divisor) & (whole % 2 == 1))
    scaled = df.withColumn(
        output, F.greatest(whole + F.when(up, 1).otherwise(0), F.lit(1).cast("bigint"))
    )
    drift = total - scaled.agg(F.sum(output)).first()[0]
    if drift == 0:
        return scaled
    # At most sqrt(2 * total) distinct values of the output exist.
    last = kth_row(scaled, [(output, False)], key, abs(drift))
    step = 1 if drift > 0 else -1
    if last is None:
        return scaled.withColumn(output, F.col(output) + step)
    among = (F.col(output) > last[output]) | (
        (F.col(output) == last[output]) & (F.col(key) <= F.lit(last[key]))
    )
    return scaled.withColumn(output, F.col(output) + F.when(among, step).otherwise(0))
