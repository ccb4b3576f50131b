"""Windows and ranks that do not put one key, or the whole table, into one task.

`Timeline` computes per-key history. A plain window sends all rows of a key to
one task, so keys that hold very many rows are cut into blocks of consecutive
rows; each block gets the totals of the blocks before it. Keys of normal size
keep the plain single-shuffle window.

`range_blocks` and `kth_row` give global order (ranks, split points) through
range partitions instead of a window without partition columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelwise.session import durable, spread

MIN_HOT_ROWS = 1_000_000

LONE = _LONE = "_lone"
HOT = _HOT = "_hot"
BLOCK = "_block"


def hot_keys(df: DataFrame, keys: list[str], min_rows: int = MIN_HOT_ROWS) -> DataFrame | None:
    """The keys with more than `min_rows` rows, or None.

    The list is a stored table: Spark broadcasts it only while its files are small. Only
    the plan depends on it, never the result.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = durable(counts.where(F.col("_n") > min_rows).select(*keys))
    return None if found.isEmpty() else found


def lone(keys: list[str], tie: str) -> Column:
    """What tells rows with a missing key apart, so that each stands alone; blank for all others."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    return F.when(missing, F.col(tie).cast("string")).otherwise(F.lit(""))


def _days_back(aggregate: str, keys: list[str], day: str, k: int) -> Column:
    """Aggregate over the rows dated at least k days before. As SQL text, because the
    API types its frame offsets as bigint, which date order refuses."""
    names = ", ".join(f"`{c}`" for c in keys)
    return F.expr(
        f"{aggregate} over (partition by {names} order by `{day}` "
        f"range between unbounded preceding and {int(k)} preceding)"
    )


@dataclass(frozen=True)
class Timeline:
    """Rows of each key in a total order, with access to what came before.

    `order` must be unique within a key. For hot keys the leading columns named
    in `cut` (few distinct values per key, such as dates) separate the blocks.
    Rows with a null key have no history: each stands alone.
    """

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    cut: tuple[str, ...]
    hot: bool

    @classmethod
    def of(
        cls,
        df: DataFrame,
        keys: list[str],
        order: list[str],
        cut: list[str],
        hot: DataFrame | None = None,
        parts: int | None = None,
    ) -> "Timeline":
        """parts: partitions to deal the rows to, if not the session's own number."""
        if list(order[: len(cut)]) != list(cut):
            raise ValueError("cut columns must lead the order")
        if _LONE not in df.columns:
            df = df.withColumn(_LONE, lone(keys, order[-1]))
        if hot is not None:
            if _HOT not in df.columns:
                marked = hot.withColumn(_HOT, F.lit(True))
                df = df.join(marked, list(keys), "left")
            # Stored once: the block totals below read the hot rows of it again.
            df = durable(df.withColumns({f"_cut_{c}": F.when(F.col(_HOT), F.col(c)) for c in cut}))
        cuts = [_HOT, *[f"_cut_{c}" for c in cut]] if hot is not None else []
        df = spread(df, parts, *keys, _LONE, *cuts)
        return cls(df, tuple(keys), tuple(order), tuple(cut), hot is not None)

    def _cuts(self) -> list[str]:
        # The hot mark is a partition column too, so that a filter on it passes below
        # the windows.
        return [_HOT, *[f"_cut_{c}" for c in self.cut]] if self.hot else []

    def before(
        self,
        sums: dict[str, Column] | None = None,
        lasts: dict[str, Column] | None = None,
        until: dict[str, int] | None = None,
        within: list[str] | None = None,
    ) -> "Timeline":
        """Add columns about the earlier rows of the same key.

        sums:   name -> integer expression, summed over all earlier rows.
        lasts:  name -> expression, its value in the row just before.
        until:  name -> k, number of rows dated at least k days before this row.
        within: extra key columns, e.g. the seller within a user.
        """
        sums, lasts, until = sums or {}, lasts or {}, until or {}
        keys = [*self.keys, _LONE, *(within or [])]
        cuts = self._cuts()
        row = Window.partitionBy(*keys, *cuts).orderBy(*self.order)
        earlier = row.rowsBetween(Window.unboundedPreceding, -1)
        added = {n: F.coalesce(F.sum(e).over(earlier), F.lit(0)) for n, e in sums.items()}
        added |= {n: F.lag(e).over(row) for n, e in lasts.items()}
        added |= {
            n: _days_back("count(1)", [*keys, *cuts], self.order[0], k) for n, k in until.items()
        }
        if not self.hot:
            return self._with(self.df.withColumns(added))
        added["_leads"] = F.row_number().over(row) == 1
        out = self.df.withColumns(added)
        carry = self._carry(keys, cuts, sums, lasts, until)
        # Same columns as the window, so the large side is not shuffled again. Rows of
        # other keys have null cuts, match nothing and carry zero.
        out = out.join(carry, [*keys, *cuts], "left")
        fixed = {n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in [*sums, *until]}
        fixed |= {
            n: F.when(F.col("_leads") & F.col(_HOT), F.col(f"_c_{n}")).otherwise(F.col(n))
            for n in lasts
        }
        out = out.withColumns(fixed)
        return self._with(out.drop("_leads", *[f"_c_{n}" for n in [*sums, *lasts, *until]]))

    def _carry(self, keys, cuts, sums, lasts, until) -> DataFrame:
        # Rows of a block are alike in the cuts; their last row is told once for all columns.
        position = F.struct(*(self.order[len(self.cut) :] or self.order))
        totals = [F.sum(e).alias(f"_s_{n}") for n, e in sums.items()]
        if lasts:
            totals.append(F.max_by(F.struct(*[e.alias(n) for n, e in lasts.items()]), position).alias("_l"))
        blocks = (
            self.df.where(F.col(_HOT))
            .groupBy(*keys, *cuts)
            .agg(F.count(F.lit(1)).alias("_n"), *totals)
        )
        block = Window.partitionBy(*keys).orderBy(*cuts[1:])
        earlier = block.rowsBetween(Window.unboundedPreceding, -1)
        carried = [F.sum(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in sums]
        carried += [F.lag(F.col("_l")[n]).over(block).alias(f"_c_{n}") for n in lasts]
        carried += [
            _days_back("sum(_n)", keys, cuts[1], k).alias(f"_c_{n}") for n, k in until.items()
        ]
        return blocks.select(*keys, *cuts, *carried)

    def _with(self, df: DataFrame) -> "Timeline":
        return Timeline(df, self.keys, self.order, self.cut, self.hot)

    def add(self, columns: dict[str, Column]) -> "Timeline":
        return self._with(self.df.withColumns(columns))

    def result(self) -> DataFrame:
        """The rows without the internal partition columns."""
        return self.df.drop(_LONE, _HOT, *[c for c in self.df.columns if c.startswith("_cut_")])


def range_blocks(df: DataFrame, order: list, blocks: int | None = None) -> DataFrame:
    """Rows cut into consecutive, about equal ranges of `order`, numbered in BLOCK.

    Range cuts come from a sample, so the result is written once and every later
    read sees the same cuts.
    """
    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return durable(
        df.repartitionByRange(blocks, *order).withColumn(BLOCK, F.spark_partition_id())
    )


def running_total(blocked: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums over the global order of a `range_blocks` table."""
    block = Window.partitionBy(BLOCK).orderBy(*order)
    upto = block.rowsBetween(Window.unboundedPreceding, 0)
    inner = blocked.withColumns({n: F.sum(e).over(upto) for n, e in sums.items()})
    # One row per range: the window without partition columns sees no data rows.
    per_block = blocked.groupBy(BLOCK).agg(*[F.sum(e).alias(f"_s_{n}") for n, e in sums.items()])
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        BLOCK, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums]
    )
    # As many rows as range partitions.
    joined = inner.join(F.broadcast(offsets), BLOCK)
    return joined.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).drop(
        BLOCK, *[f"_b_{n}" for n in sums]
    )


def global_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """1-based position of every row in a unique global order."""
    return running_total(range_blocks(df, order), order, {name: F.lit(1).cast("bigint")})


def kth_row(df: DataFrame, levels: list[tuple[str, bool]], tie: str, k: int):
    """The k-th row (1-based) by `levels` then `tie` ascending, or None if k < 1.

    `levels` are (column, ascending) pairs with few distinct values, each counted
    before going one level deeper; only the last group is cut into ranges.
    """
    if k < 1:
        return None
    found = {}
    rest = df.select(*[c for c, _ in levels], tie)
    for column, ascending in levels:
        side = F.col(column).asc() if ascending else F.col(column).desc()
        # One row per distinct level value.
        counts = rest.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
        upto = Window.orderBy(side).rowsBetween(Window.unboundedPreceding, 0)
        hit = (
            counts.withColumn("_upto", F.sum("_n").over(upto))
            .where(F.col("_upto") >= k)
            .orderBy("_upto")
            .first()
        )
        if hit is None:
            return None
        k -= hit["_upto"] - hit["_n"]
        found[column] = hit[column]
        rest = rest.where(F.col(column).eqNullSafe(F.lit(hit[column])))
    cut = range_blocks(rest.select(tie), [tie])
    sizes = {r[BLOCK]: r["count"] for r in cut.groupBy(BLOCK).count().collect()}
    for block in sorted(sizes):
        if k <= sizes[block]:
            one = cut.where(F.col(BLOCK) == block)
            rank = F.row_number().over(Window.partitionBy(BLOCK).orderBy(tie))
            found[tie] = one.withColumn("rank", rank).where(F.col("rank") == k).first()[tie]
            return found
        k -= sizes[block]
    return None


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str) -> DataFrame:
    """First n rows per key. Spark keeps n rows per key and task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("bigint")).where(F.col(rank) <= n)
