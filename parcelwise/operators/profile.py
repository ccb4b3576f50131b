"""Counts, summaries and integrity checks of whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from parcelwise.functions.columns import ratio, yes
from parcelwise.operators.scale import range_blocks, running_total
from parcelwise.session import durable

# Right-closed age bins.
AGE_BINS = [(180, "new"), (730, "mid"), (9999, "veteran")]


def with_share(counts: DataFrame, n: str) -> DataFrame:
    """Add each group's share. The total sums the same grouped counts, so Spark reuses
    their shuffle instead of reading the rows again."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.withColumn("share", ratio(F.col(n), total))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their share of all rows with a value."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return with_share(counts, "n")


def exact_quantiles(df: DataFrame, group: str, value: str, points: list[float]) -> DataFrame:
    """Linear-interpolated quantiles per group: (group, point, quantile).

    Distinct values are ranked through range blocks, so neither a large group nor
    its distinct values gather in one task.
    """
    counts = (
        df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
        .groupBy(group, F.col(value).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_total(range_blocks(counts, [group, "v"]), [group, "v"], {"upto": F.col("n")})
    # Stored, so that the join below is a broadcast only when the groups are few.
    sizes = durable(
        ranked.groupBy(group).agg(
            F.sum("n").alias("size"), F.min(F.col("upto") - F.col("n")).alias("start")
        )
    )
    at = sizes.select(
        group, "start", "size", F.explode(F.lit([float(p) for p in points])).alias("point")
    ).withColumn("at", (F.col("size") - 1).cast("double") * F.col("point"))
    wanted = at.select(
        group, "point", "at",
        (F.col("start") + F.floor("at")).alias("low"), (F.col("start") + F.ceil("at")).alias("high"),
    )
    # Ranks are zero-based here; a value covers [upto - n, upto).
    covers = lambda rank: (F.col("upto") - F.col("n") <= F.col(rank)) & (F.col(rank) < F.col("upto"))
    return (
        ranked.join(wanted, group)
        .where(covers("low") | covers("high"))
        .groupBy(group, "point")
        .agg(
            F.max(F.when(covers("low"), F.col("v"))).alias("a"),
            F.max(F.when(covers("high"), F.col("v"))).alias("b"),
            F.max("at").alias("at"),
        )
        .select(
            group,
            "point",
            (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("quantile"),
        )
    )


def describe_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean, standard deviation, min, quartiles and max per group."""
    v = F.col(value).cast("double")
    stats = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    names = {0.25: "p25", 0.5: "p50", 0.75: "p75"}
    wide = exact_quantiles(df, group, value, list(names)).groupBy(group).agg(
        *[F.max(F.when(F.col("point") == p, F.col("quantile"))).alias(n) for p, n in names.items()]
    )
    return stats.join(wide, group, "left")


def describe(df: DataFrame, value: str) -> DataFrame:
    """The same summary of the whole table."""
    return describe_by_group(df.withColumn("_all", F.lit(1)), "_all", value).drop("_all")


def group_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    return (
        df.groupBy(group)
        .agg(F.avg(F.col(value).cast("double")).alias("mean"))
        .orderBy(F.desc("mean"), group)
    )


def rate_by_type(df: DataFrame, group: str, hit: Column) -> DataFrame:
    """Count, share of rows and rate of hits per type."""
    counts = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(yes(hit).cast("bigint")).alias("hits")
    )
    return with_share(counts, "n").withColumn("rate", ratio(F.col("hits"), F.col("n")))


def verdict_summary(df: DataFrame) -> DataFrame:
    def count(verdict: str) -> Column:
        return F.count_if(F.col("verdict") == verdict)

    return df.agg(
        count("Auto-Approve").alias("approved"),
        count("Escalate").alias("escalated"),
        count("Auto-Reject").alias("rejected"),
    )


def table_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, min, max, sum, mean and distinct count per numeric column, one row per column."""
    long = df.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
            )
        )
    )
    # Distinct values are counted from (column, value) groups spread over all tasks.
    values = long.groupBy("column", "v").agg(F.count("v").alias("n"))
    return values.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.sum(F.col("v") * F.col("n")).alias("sum"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.count("v").alias("distinct"),
    )


def bin_label(column: Column, bins: list[tuple[int, str]] = AGE_BINS) -> Column:
    """Label of the right-closed bin; null outside all bins."""
    out, low = F.lit(None).cast("string"), 0
    for high, label in bins:
        out = F.when((column > low) & (column <= high), label).otherwise(out)
        low = high
    return out


def _violations(name: str, df: DataFrame, count: Column) -> DataFrame:
    return df.agg(F.coalesce(count, F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit(name).alias("check"), "violations"
    )


def _orphans(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    # Children are counted per key before the join, so a frequent key is one row.
    counted = child.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return _violations(name, counted.join(parent.select(key), key, "left_anti"), F.sum("n"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def integrity_report(
    users: DataFrame, sellers: DataFrame, products: DataFrame, orders: DataFrame, returns: DataFrame
) -> DataFrame:
    """Number of rows breaking each check; zero rows mean the check holds."""
    returned = orders.where(F.col("is_returned") == 1)
    checks = [
        _orphans(orders, users, "user_id", "orders_without_user"),
        _orphans(orders, products, "product_id", "orders_without_product"),
        _orphans(orders, sellers, "seller_id", "orders_without_seller"),
        _orphans(returns, returned, "order_id", "returns_of_unreturned_orders"),
        _violations(
            "duplicate_return_ids", duplicate_keys(returns, "return_id"), F.sum(F.col("n") - 1)
        ),
        _violations(
            "duplicate_order_ids", duplicate_keys(orders, "order_id"), F.sum(F.col("n") - 1)
        ),
        _violations(
            "orders_with_null_keys",
            orders,
            F.sum(
                yes(
                    F.col("user_id").isNull() | F.col("product_id").isNull() | F.col("seller_id").isNull()
                )
            ),
        ),
    ]
    return reduce(DataFrame.unionByName, checks)
