"""Leaderboards: score order with ties by time, ranks, percentiles, neighbours, windows of time, regional merges.

Ranks over a whole board never sort it in one task: `ranks` numbers rows inside ranges and adds the sizes of the ranges above (`ordered`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import PER_RANGE, numbered

ORDER = ("score", "ts", "player")
BUCKETS_MS = {"daily": 86_400_000, "monthly": 2_629_746_000}


def _order(ascending: bool = False) -> list[Column]:
    """Best score first, then the earlier entry, then the player's id."""
    return [F.col("score").asc() if ascending else F.col("score").desc(), F.col("ts").asc(), F.col("player").asc()]


def best_entries(scores: DataFrame, parts: list[str] | None = None, ascending: bool = False) -> DataFrame:
    """submit_score over all submissions: the best per player; of equal scores the earliest. Rows (parts, player, score, ts)."""
    sign = 1 if ascending else -1
    keys = [*(parts or []), "player"]
    best = F.min(F.struct((F.col("score") * sign).alias("s"), F.col("ts").alias("t"))).alias("b")
    return scores.groupBy(*keys).agg(best).select(*keys, (F.col("b.s") * sign).alias("score"), F.col("b.t").alias("ts"))


def top(entries: DataFrame, n: int, parts: list[str] | None = None, ascending: bool = False) -> DataFrame:
    """Ranks 1 to n (of each part): a top-n first, then the numbering of the few rows left."""
    if not parts:
        few = entries.orderBy(*_order(ascending)).limit(n)
        return few.withColumn("rank", F.row_number().over(Window.orderBy(*_order(ascending))).cast("bigint"))
    w = Window.partitionBy(*parts).orderBy(*_order(ascending))  # Spark keeps only n rows per part before the shuffle
    return entries.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def ranks(entries: DataFrame, ascending: bool = False, per: int = PER_RANGE) -> DataFrame:
    """Every entry with its unique 1-based rank and the board's total; ranges of (score, ts, player) are ordered each on its own."""
    signed = F.col("score") if ascending else -F.col("score")
    last = F.col("score").isNotNull() if ascending else F.col("score").isNull()  # where an entry without a score goes
    return numbered(entries, [], [last, signed, F.col("ts"), F.col("player")], "rank", "total", per)


def percentile(rank: Column, total: Column) -> Column:
    """100 at the top, 0 at the end; 100 on a board of one."""
    return F.when(total <= 1, 100.0).otherwise((total - rank) / (total - 1) * 100.0)


def around(ranked: DataFrame, player, k: int) -> DataFrame:
    """Entries at most k ranks from a player's: that one rank is fetched, the rest is a filter. Without the player, no rows."""
    own = ranked.where(F.col("player") == F.lit(player)).select("rank").first()
    return ranked.where(F.col("rank").between(own[0] - k, own[0] + k)) if own else ranked.where(F.lit(False))


def rank_range(ranked: DataFrame, first: int, last: int) -> DataFrame:
    """Entries of an inclusive rank range."""
    if first < 1 or first > last:
        raise ValueError("ranks start at 1 and the first is not above the last")
    return ranked.where(F.col("rank").between(first, last))


def capped(entries: DataFrame, max_entries: int, ascending: bool = False) -> DataFrame:
    """A board that evicts its worst entries."""
    return entries.orderBy(*_order(ascending)).limit(max_entries)


def bucket(ms: Column, window: str | int) -> Column:
    """The number of the time window of an epoch in milliseconds; a change of it resets a board.

    daily; weekly (changes on Sundays, 00:00); monthly (of 30.44 days); all_time; or any length in milliseconds.
    """
    if window == "all_time":
        return F.lit(0).cast("bigint")
    if window == "weekly":
        return F.floor((ms + 4 * 86_400_000) / (7 * 86_400_000)).cast("bigint")
    return F.floor(ms / (BUCKETS_MS[window] if isinstance(window, str) else window)).cast("bigint")


def merge_regions(boards: dict[str, DataFrame], n: int, ascending: bool = False) -> DataFrame:
    """The global top n of regional tops, with their region."""
    out = None
    for region, df in sorted(boards.items()):
        one = df.orderBy(*_order(ascending)).limit(n).withColumn("region", F.lit(region))
        out = one if out is None else out.unionByName(one)
    return top(out, n, ascending=ascending)


def changes(df: DataFrame, part: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before in their part, with that value."""
    w = Window.partitionBy(part).orderBy(order)
    return df.withColumn("previous", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("previous")))
