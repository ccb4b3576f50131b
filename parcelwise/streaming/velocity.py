"""How often users returned in the days before, kept up to date by a stream.

Returns arrive as files, late and repeated ones among them. The stream drops repeats,
counts returns by user and day, and hands each day's count to the user's ring: the counts
of the last days, from which the history of a day is told. A user gives one row a
day to its ring however many returns it has, as counts are combined before they move.
The rings of a group of users are one state, read and written once a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parcelwise.operators.features import REQUEST_ORDER
from parcelwise.operators.scale import Timeline

#: Columns of an arriving return.
ARRIVAL = "return_id string, user_id long, return_request_date date, order_date date"
#: Days of the long and the short count, the day itself included.
LONG, SHORT = 90, 30
DAY_MS = 86_400_000
#: Groups of users whose rings are one state. A stored checkpoint stays with its number.
USER_GROUPS = 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class DayRings(StatefulProcessor):
    """The counts of the last LONG days of a group of users. Takes final counts, one for each user
    and day, and gives for each the sums over the user's days before it. Days come in order from
    batch to batch, so those LONG days behind the group's last one are forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rings = handle.getValueState("rings", "users array<bigint>, days array<int>, counts array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))  # one row a user and day at most
        held = self.rings.get() or ([], [], [])
        user, day, n = (
            np.concatenate([np.asarray(old, "int64"), arrived[c].to_numpy("int64")])
            for c, old in zip(("user_id", "day", "n"), held, strict=True)
        )
        order = np.lexsort((day, user))
        new = order >= len(held[0])
        user, day, n = user[order], day[order], n[order]
        # Users one after another on one axis of days.
        since = day - day.min()
        start = np.cumsum(np.append(0, user[1:] != user[:-1])) * (since.max() + 1)
        total = np.append(0, np.cumsum(n))

        def before(days: int) -> np.ndarray:
            first = np.searchsorted(start + since, start + np.maximum(since - days + 1, 0))
            return total[:-1] - total[first]

        out = {"user_id": user, "day": day, "before_short": before(SHORT), "before_long": before(LONG)}
        told = pd.DataFrame({c: x[new] for c, x in out.items()})
        recent = day > day.max() - LONG
        self.rings.update(tuple(x[recent].tolist() for x in (user, day, n)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # Windows end with the day, so the watermark may stand a day behind its counts.
        self.handle.registerTimer((int(day.max()) + LONG + 1) * DAY_MS)
        yield told.assign(day=told["day"].astype("int32"), nobody=bool(key[1]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rings.clear()
        return iter(())

    def close(self) -> None:
        pass


def day_counts(arrivals: DataFrame, delay: str) -> DataFrame:
    """(user_id, day, n, at): returns of each user and day, once the watermark has passed
    the day. Repeats of a return_id within the delay are dropped; rows that come later
    than the delay, and rows without a date, are not counted."""
    day = F.unix_date("return_request_date")
    timed = arrivals.select("return_id", "user_id", day.alias("day"), F.timestamp_seconds(day.cast("long") * 86400).alias("at"))
    once = timed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["return_id"])
    counted = once.groupBy(F.window("at", "1 day"), "user_id").agg(F.min("day").alias("day"), F.count("*").alias("n"))
    return counted.select("user_id", "day", "n", F.window_time("window").alias("at"))


def update_history(
    spark: SparkSession, source: str, history: str, checkpoint: str, delay: str = "7 days", groups: int = USER_GROUPS
) -> None:
    """Take up all files of `source` (ARRIVAL columns, parquet) not seen yet, then stop.

    `history` gets (user_id, day, before_short, before_long) for each user and day: its returns on
    the SHORT - 1 and LONG - 1 days before. A day is told once the watermark has passed it;
    `close_days` moves it on where no more returns come. A repeated run after a failure
    goes on from the checkpoint and writes nothing twice.
    """
    arrivals = spark.readStream.schema(ARRIVAL).parquet(source)
    counted = day_counts(arrivals, delay).select(
        F.pmod(F.hash("user_id"), F.lit(groups)).alias("group"), F.col("user_id").isNull().alias("nobody"),
        F.coalesce("user_id", F.lit(0)).alias("user_id"), "day", "n", "at",
    )
    told = counted.groupBy("group", "nobody").transformWithStateInPandas(
        DayRings(), "user_id long, day int, before_short long, before_long long, nobody boolean", "Append", "EventTime"
    )
    told = told.withColumn("user_id", F.when(~F.col("nobody"), F.col("user_id"))).drop("nobody")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        stream = told.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        running = stream.trigger(availableNow=True).start(history)
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    running.awaitTermination()


def close_days(spark: SparkSession, source: str, day: str) -> None:
    """Put a mark without return and user into `source`: no return before `day`, less the
    delay of the stream, is to come."""
    mark = spark.sql(f"SELECT CAST(NULL AS STRING) return_id, CAST(NULL AS BIGINT) user_id, DATE'{day}' return_request_date, CAST(NULL AS DATE) order_date")
    mark.coalesce(1).write.mode("append").parquet(source)


def velocity(returns: DataFrame, history: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """returns_last_30d, returns_last_90d and return_frequency_score of each return: the
    days before from the stored history, the day itself from the returns.

    A return without a user stands alone. One whose day is not told yet, or that has
    no date, gets null. hot: keys (user_id, return_request_date) with so many
    returns that they are cut into blocks (see `Timeline`).
    """
    days = Timeline.of(returns, ["user_id", "return_request_date"], REQUEST_ORDER, REQUEST_ORDER[:2], hot)
    rows = days.before(sums={"same_day": F.lit(1).cast("bigint")}).result()
    told = history.select("user_id", F.date_from_unix_date("day").alias("return_request_date"), "before_short", "before_long")
    joined = rows.join(told.where("user_id IS NOT NULL"), ["user_id", "return_request_date"], "left")
    alone = F.col("user_id").isNull() & F.col("return_request_date").isNotNull()

    def count(name):
        return F.when(alone, F.lit(0).cast("bigint")).otherwise(F.col(name) + F.col("same_day"))

    month, quarter = F.col("returns_last_30d"), F.col("returns_last_90d")
    found = joined.withColumns({"returns_last_30d": count("before_short"), "returns_last_90d": count("before_long")})
    found = found.withColumn("return_frequency_score", month + (quarter - month) * F.lit(0.3))
    return found.drop("same_day", "before_short", "before_long")
