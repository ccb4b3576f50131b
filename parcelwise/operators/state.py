"""User state at the time of a return: orders placed, returns made."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from parcelwise.functions.columns import from_money, money
from parcelwise.operators.scale import LONE, Timeline
from parcelwise.session import durable, spread

WALK_ORDER = ["order_date", "return_request_date", "return_id"]
WALK_CUT = ["order_date", "return_request_date"]
REQUEST_ORDER = ["return_request_date", "order_date", "return_id"]
REQUEST_CUT = ["return_request_date", "order_date"]
RECENT_DAYS = 30
#: Users with more (order day, request day) cells are cut into blocks of so many order days.
MIN_BLOCK_CELLS = 20_000
BLOCK_DAYS = 32


def as_of_state(requests: DataFrame, orders: DataFrame, parts: int | None = None) -> DataFrame:
    """Orders placed, and their value, up to and including each request date.

    Adds total_orders_at_time and orders_value_at_time to the requests.

    requests: user_id, return_request_date, order_value and any other columns.
    orders:   user_id, order_date, order_value.
    parts:    partitions of the join, if not the session's own number.
    A user without orders by then gets (1, mean value of their returns, else 1).

    Both sides are first reduced to one row per user and day, so a user's window
    is as long as the calendar however many orders the user has.
    """
    ordered = orders.groupBy("user_id", F.col("order_date").alias("day")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum(money(F.col("order_value"))).alias("value_e4")
    )
    returned = requests.groupBy("user_id", F.col("return_request_date").alias("day")).agg(
        F.count("order_value").alias("returns"),
        F.sum(money(F.col("order_value"))).alias("returned_e4"),
    )
    none = F.lit(None).cast("bigint")
    days = ordered.select(
        "user_id", "day", "orders", "value_e4", none.alias("returns"), none.alias("returned_e4"),
        F.lit(False).alias("asked"),
    ).unionByName(
        returned.select(
            "user_id", "day", none.alias("orders"), none.alias("value_e4"), "returns",
            "returned_e4", F.lit(True).alias("asked"),
        )
    )
    # RANGE up to the current day covers the other row of the same day.
    upto = Window.partitionBy("user_id").orderBy("day").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy("user_id")
    state = days.where(F.col("user_id").isNotNull()).select(
        "user_id",
        F.col("day").alias("return_request_date"),
        "asked",
        F.sum("orders").over(upto).alias("_orders"),
        F.sum("value_e4").over(upto).alias("_value_e4"),
        (
            F.sum("returned_e4").over(whole).cast("double")
            / (10000 * F.nullif(F.sum("returns").over(whole), F.lit(0))).cast("double")
        ).alias("_fallback"),
    )
    asked, day = state.where("asked").drop("asked"), ["user_id", "return_request_date"]
    # A return names its day, so no user or missing user fills a partition.
    found = spread(requests, parts, *day).join(spread(asked, parts, *day), day, "left")
    return _state_columns(found)


def _state_columns(found: DataFrame) -> DataFrame:
    mean = F.coalesce("_fallback", F.lit(0.0))
    return found.withColumns(
        {
            "total_orders_at_time": F.coalesce("_orders", F.lit(1).cast("bigint")),
            "orders_value_at_time": F.when(
                F.col("_orders").isNull(), F.when(mean == 0.0, 1.0).otherwise(mean)
            ).otherwise(from_money(F.col("_value_e4"))),
        }
    ).drop("_orders", "_value_e4", "_fallback")


def as_of_state_by_user(requests: DataFrame, orders: DataFrame, parts: int | None = None) -> DataFrame:
    """`as_of_state` of requests that are dealt by user and LONE, as `return_state` leaves them, and stay so.

    A user's order days come as one list, as long as the calendar at most, so the requests are not
    shuffled again. For tables without hot users: a task holds all requests of a user.
    """
    by_user, day = ["user_id", LONE], F.col("return_request_date")
    ordered = orders.where(F.col("user_id").isNotNull()).groupBy("user_id", F.col("order_date").alias("day")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum(money(F.col("order_value"))).alias("value_e4")
    )
    # Not a literal, or Spark would drop it from the keys.
    ordered = ordered.withColumn(LONE, F.when(F.col("user_id").isNull(), F.lit("-")).otherwise(F.lit("")))
    upto = Window.partitionBy(*by_user).orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.struct("day", F.sum("orders").over(upto).alias("orders"), F.sum("value_e4").over(upto).alias("value_e4"))
    days = spread(ordered, parts, *by_user).select(*by_user, state.alias("_state")).groupBy(*by_user).agg(
        F.collect_list("_state").alias("_days")
    )
    own = Window.partitionBy(*by_user)
    value = F.sum(money(F.col("order_value"))).over(own).cast("double")
    fallback = value / (10000 * F.nullif(F.count("order_value").over(own), F.lit(0))).cast("double")
    known = F.col("user_id").isNotNull() & day.isNotNull()
    found = requests.withColumn("_fallback", F.when(known, fallback)).join(days, by_user, "left")
    # Orders without a day count for every day; they come first, so the last day holds them.
    past = F.filter("_days", lambda d: d["day"].isNull() | (d["day"] <= day))
    found = found.withColumn("_last", F.when(known, F.array_max(past)))
    return _state_columns(found.withColumns({"_orders": F.col("_last.orders"), "_value_e4": F.col("_last.value_e4")})).drop("_days", "_last")


def _dominated(cells: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
    """Per (order day, request day) cell of one user's block: rows of cells with no later
    order day whose request is more than RECENT_DAYS before the cell's.

    Within the block from a grid of its order days by its request days, summed along both; of
    the user's blocks before it from their rows by request day.
    """
    orders, row = np.unique(cells["order_day"].to_numpy(), return_inverse=True)
    days, slot = np.unique(cells["request_day"].to_numpy(), return_inverse=True)
    grid = np.zeros((len(orders) + 1, len(days) + 1), dtype="int64")
    np.add.at(grid, (row + 1, slot + 1), cells["n"].to_numpy())
    grid = grid.cumsum(axis=0).cumsum(axis=1)
    limit = cells["request_day"].to_numpy() - RECENT_DAYS
    excluded = grid[row + 1, np.searchsorted(days, limit, side="left")]
    before = before.sort_values("day")
    total = np.append(0, before["rows"].to_numpy().cumsum())
    excluded = excluded + total[np.searchsorted(before["day"].to_numpy(), limit, side="left")]
    return cells[["user_id", "order_day", "request_day"]].assign(excluded=excluded)


def excluded_by_cell(cells: DataFrame, min_cells: int = MIN_BLOCK_CELLS, span: int = BLOCK_DAYS) -> DataFrame:
    """user_id, order_day, request_day and excluded: rows earlier in the walk whose request is
    more than RECENT_DAYS before the cell's.

    cells: user_id, order_day, request_day (whole numbers), n. A row with such a request and
    an order no later is earlier in the walk, so this counts dominated rows. Users with over
    `min_cells` cells are cut into blocks of `span` order days. A block gets, for each request day,
    the rows of the blocks before it: as many as there are request days, however many
    rows the user has. So a group is a block, never a user.
    """
    user_type = dict(cells.dtypes)["user_id"]
    counts = cells.groupBy("user_id").agg(F.count(F.lit(1)).alias("_cells"))
    # The size of the stored table decides the join.
    large = durable(counts.where(F.col("_cells") > min_cells).select("user_id", F.lit(True).alias("_large")))
    block = F.when(F.col("_large"), F.floor(F.col("order_day") / span)).otherwise(F.lit(0)).cast("bigint")
    cut = cells.join(large, "user_id", "left").withColumn("_block", block)
    daily = cut.where("_large").groupBy("user_id", "_block", "request_day").agg(F.sum("n").alias("n"))
    last = daily.groupBy("user_id").agg(F.max("_block").alias("_last"))
    # Running rows of a request day hold from the block behind one until the next that adds some.
    by_day = Window.partitionBy("user_id", "request_day").orderBy("_block")
    upto = F.sum("n").over(by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = daily.select("user_id", "request_day", "_block", upto.alias("n"), F.lead("_block").over(by_day).alias("_next"))
    runs = runs.join(last, "user_id").withColumn("_until", F.coalesce("_next", "_last"))
    behind = F.explode(F.sequence(F.col("_block") + 1, F.col("_until")))
    carried = runs.where("_until > _block").select(
        F.col("user_id").alias("_user"), F.col("request_day").alias("day"), F.col("n").alias("rows"), behind.alias("_behind")
    )

    def count(own: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({c: [] for c in ("user_id", "order_day", "request_day", "excluded")})
        return _dominated(own, before)

    left = cut.select("user_id", "_block", "order_day", "request_day", "n").groupBy("user_id", "_block")
    right = carried.groupBy("_user", "_behind")
    schema = f"user_id {user_type}, order_day bigint, request_day bigint, excluded bigint"
    return left.cogroup(right).applyInPandas(count, schema)


def _late_or_early(rows: DataFrame):
    lag = F.datediff("return_request_date", "order_date")
    return rows.where((lag < 0) | (lag > RECENT_DAYS))


def return_state(
    rows: DataFrame, hot: DataFrame | None = None, check_lags: bool = True, parts: int | None = None,
    keep_lone: bool = False,
) -> DataFrame:
    """Add the returns a user made before each return, walking in order-date order.

    total_returns_at_time   all earlier returns in the walk
    returns_30d_by_order    of these, requested at most 30 days before this
                            request, or after it (the walk follows order dates)
    seller_returns_at_time  of these, with the same seller

    When every request follows its order within 30 days, a return requested more
    than 30 days ago also comes earlier in the walk, so a count by request date
    gives the middle column. Users with other lags are counted by day cells, in
    blocks of order days (`excluded_by_cell`). `check_lags` looks for such users first.
    keep_lone: LONE stays, so that later joins by user and LONE take the rows where they are.
    """
    walk = Timeline.of(rows, ["user_id"], WALK_ORDER, WALK_CUT, hot, parts)
    walk = walk.before(sums={"total_returns_at_time": F.lit(1).cast("bigint")})
    walk = walk.before(sums={"seller_returns_at_time": F.lit(1).cast("bigint")}, within=["seller_id"])
    asked = Timeline.of(walk.df, ["user_id"], REQUEST_ORDER, REQUEST_CUT, hot)
    asked = asked.before(until={"_excluded": RECENT_DAYS + 1})
    out = asked.df if keep_lone and hot is None else asked.result()
    if check_lags and not _late_or_early(rows).isEmpty():
        users = _late_or_early(rows).select("user_id").distinct()
        cells = (
            rows.join(users, "user_id", "left_semi")
            .groupBy("user_id", "order_date", "return_request_date")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(
                "user_id",
                F.unix_date("order_date").cast("bigint").alias("order_day"),
                F.unix_date("return_request_date").cast("bigint").alias("request_day"),
                "n",
            )
        )
        by_cell = excluded_by_cell(cells).select(
            "user_id",
            F.date_from_unix_date(F.col("order_day").cast("int")).alias("order_date"),
            F.date_from_unix_date(F.col("request_day").cast("int")).alias("return_request_date"),
            F.col("excluded").alias("_cell_excluded"),
        )
        out = out.join(by_cell, ["user_id", "order_date", "return_request_date"], "left")
        out = out.withColumn("_excluded", F.coalesce("_cell_excluded", "_excluded"))
    seller = F.when(F.col("seller_id").isNull(), 0).otherwise(F.col("seller_returns_at_time"))
    return out.withColumns(
        {
            "returns_30d_by_order": F.col("total_returns_at_time") - F.col("_excluded"),
            "seller_returns_at_time": seller,
        }
    ).drop("_excluded", "_cell_excluded")


def gap_chain(
    events: DataFrame, key: str, order: list[str], cut: list[str], first_date: str, gap: str,
    end_date, hot: DataFrame | None = None,
) -> DataFrame:
    """Event dates from a first date plus running gaps, cut at the first date that
    reaches `end_date`. Gaps are at least 0, so the cut is a filter. The gap of a
    row leads to the row after it; the first row always stays."""
    t = Timeline.of(events, [key], order, cut, hot)
    t = t.before(
        sums={"_offset": F.col(gap).cast("bigint"), "_position": F.lit(1).cast("bigint")}
    )
    dated = t.result().withColumn(
        "event_date", F.date_add(F.col(first_date), F.col("_offset").cast("int"))
    )
    kept = dated.where((F.col("_position") == 0) | (F.col("event_date") < F.lit(end_date)))
    return kept.withColumn("position", F.col("_position") + 1).drop("_offset", "_position")
