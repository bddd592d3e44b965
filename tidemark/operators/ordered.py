"""Positions and running maxima within parts, without ordering a part in one task.

Rows are dealt into ranges of (part, order) by cuts from a bounded sample, so that a part with a third of all rows, or one score that all players
have, is spread like any other. A cut is a value of the table, so any sample gives the same result; a bad one only makes ranges uneven.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows aimed at in a range, ranges at most (the cuts are literals of the plan), and rows of the sample for each range.
PER_RANGE, MOST_RANGES, SAMPLED = 200_000, 1024, 50


def _as_key(order: list[Column], kinds: list[str] | None = None) -> Column:
    return F.struct(*((c.cast(kinds[i]) if kinds else c).alias(f"k{i}") for i, c in enumerate(order)))


def nulls_last(order: list[Column]) -> list[Column]:
    """Keys that sort like `order` ascending, but with nulls last."""
    return [k for c in order for k in (c.isNull(), c)]


def descending(number: Column) -> list[Column]:
    """Keys that sort ascending like a floating number does descending, nulls last: NaN counts as the largest number."""
    return [number.isNull(), ~F.isnan(number), -number]


def dealt(df: DataFrame, order: list[Column], per: int = PER_RANGE) -> tuple[DataFrame, str | None]:
    """df with the number of the range that a row falls into, ascending by `order`, nulls first; and that column's name.

    A table of at most `per` rows is one range: df as it is, and None.
    """
    name = "_range"
    while name in df.columns:
        name += "_"
    n = df.count()
    ranges = min(MOST_RANGES, math.ceil(n / per))
    if ranges < 2:
        return df, None
    keyed = df.select(*(c.alias(f"k{i}") for i, c in enumerate(order)))
    fraction = min(1.0, ranges * SAMPLED / n)
    sample = keyed.where(F.rand(17) < fraction).orderBy(*keyed.columns).limit(4 * ranges * SAMPLED).collect()  # bounded by both
    if not sample:
        return df, None
    kinds = [f.dataType.simpleString() for f in keyed.schema.fields]
    lit = lambda row: _as_key([F.lit(v) for v in row], kinds)
    cut_rows = [sample[i] for i in sorted({len(sample) * i // ranges for i in range(1, ranges)})]
    # two levels: the group of cuts first, then the cuts of that group
    width = math.isqrt(len(cut_rows)) + 1
    groups = [cut_rows[i : i + width] for i in range(0, len(cut_rows), width)]
    heads = F.array(*(lit(g[0]) for g in groups))
    inner = F.array(*(F.array(*(lit(r) for r in g)) for g in groups))
    key = _as_key(order, kinds)
    below = F.size(F.filter(heads, lambda c: c <= key))
    at = F.size(F.filter(F.get(inner, below - 1), lambda c: c <= key))
    return df.withColumn(name, F.when(below == 0, 0).otherwise((below - 1) * width + at)), name


def _before(parts: list[str], b: str):
    return Window.partitionBy(*parts).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, parts: list[str], order: list[Column], rank: str, total: str | None = None, per: int | None = None, ties: bool = False) -> DataFrame:
    """Adds `rank`, a row's 1-based position within its part by `order` (all ascending, nulls first), and `total`, the part's rows.

    With `ties`, rows alike in all of `order` have the position of the first of them, as in rank().
    """
    position = F.rank() if ties else F.row_number()
    per = per or PER_RANGE
    base, b = dealt(df, [*map(F.col, parts), *order], per)
    if b is None:
        out = df.withColumn(rank, position.over(Window.partitionBy(*parts).orderBy(*order)).cast("bigint"))
        return out.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*parts))) if total else out
    inside = Window.partitionBy(*parts, b).orderBy(*order)
    sizes = base.groupBy(*parts, b).agg(F.count(F.lit(1)).alias("_n"))  # one row for each part and range
    sizes = sizes.select(*(F.col(p).alias(f"_p{i}") for i, p in enumerate(parts)), F.col(b).alias("_rb"), F.coalesce(F.sum("_n").over(_before(parts, b)), F.lit(0)).alias("_o"), F.sum("_n").over(Window.partitionBy(*parts)).alias("_t"))
    same = F.col(b) == F.col("_rb")
    for i, p in enumerate(parts):
        same &= F.col(p).eqNullSafe(F.col(f"_p{i}"))
    out = base.withColumn("_i", position.over(inside)).join(sizes, same)
    out = out.withColumn(rank, (F.col("_i") + F.col("_o")).cast("bigint"))
    out = out.withColumn(total, F.col("_t")) if total else out
    return out.drop(b, "_rb", "_i", "_o", "_t", *(f"_p{i}" for i in range(len(parts))))


def running_max(df: DataFrame, part: str, order: str, value: Column, out: str, per: int = PER_RANGE) -> DataFrame:
    """Adds `out`, the largest value of the rows before in the part (null for the first)."""
    base, b = dealt(df, [F.col(part), F.col(order)], per)
    if b is None:
        return df.withColumn(out, F.max(value).over(_before([part], order)))
    tops = base.groupBy(part, b).agg(F.max(value).alias("_m"))
    tops = tops.select(F.col(part).alias("_p"), F.col(b).alias("_rb"), F.max("_m").over(_before([part], b)).alias("_top"))
    inside = Window.partitionBy(part, b).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = base.withColumn("_near", F.max(value).over(inside)).join(tops, F.col(part).eqNullSafe(F.col("_p")) & (F.col(b) == F.col("_rb")))
    return near.withColumn(out, F.greatest("_near", "_top")).drop(b, "_rb", "_p", "_near", "_top")
