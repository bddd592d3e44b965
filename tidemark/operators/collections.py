"""Sets, sorted sets, hashes, lists, bitmaps and streams over long-form DataFrames, one row for each member, field, position or entry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import PER_RANGE, numbered, running_max


# sets: (key, member)


def set_of(df: DataFrame, key) -> DataFrame:
    """The distinct members of one key."""
    return df.where(F.col("key") == F.lit(key)).select("member").distinct()


def union(sets: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, sets).distinct()


def inter(sets: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "member", "left_semi"), [s.distinct() for s in sets])


def diff(sets: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "member", "left_anti"), sets[1:], sets[0].distinct())


def inter_card(sets: list[DataFrame], limit: int = 0) -> DataFrame:
    """Size of the intersection, at most `limit` (0: no limit)."""
    both = inter(sets)
    return (both.limit(limit) if limit else both).agg(F.count(F.lit(1)).alias("n"))


def move(df: DataFrame, src, dst, member) -> DataFrame:
    """SMOVE: the member leaves src and joins dst, if src has it."""
    hit = (F.col("key") == F.lit(src)) & (F.col("member") == F.lit(member))
    return df.withColumn("key", F.when(hit, F.lit(dst)).otherwise(F.col("key"))).distinct()


def pick(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n pseudorandom members, the same in every run: the smallest seeded digests."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("member").cast("string")).cast("binary")), "member").limit(n)


# sorted sets: (member, score), ordered by score, then member


def zranks(z: DataFrame, parts: list[str] | None = None, per: int = PER_RANGE) -> DataFrame:
    """0-based positions within the parts from the lowest up (`rank`) and from the highest down (`rev`); a hot part is ordered in many tasks."""
    r = numbered(z, parts or [], [F.col("score"), F.col("member")], "rank", "_total", per)
    return r.withColumns({"rank": F.col("rank") - 1, "rev": F.col("_total") - F.col("rank")}).drop("_total")


def zrank(z: DataFrame, parts: list[str] | None = None, reverse: bool = False, per: int = PER_RANGE) -> DataFrame:
    """0-based positions within the parts, from the highest down if reverse."""
    r = zranks(z, parts, per)
    return r.drop("rank").withColumnRenamed("rev", "rank") if reverse else r.drop("rev")


def zrange(z: DataFrame, start: int, stop: int, parts: list[str], reverse: bool = False) -> DataFrame:
    """Members by inclusive positions; negative ones count from the end."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*parts))
    at = lambda i: F.lit(i).cast("bigint") if i >= 0 else n + i
    r = zrank(z, parts, reverse).withColumn("_lo", F.greatest(at(start), F.lit(0).cast("bigint"))).withColumn("_hi", at(stop))
    return r.where(F.col("rank").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def score_bound(text: str, upper: bool) -> Column:
    """`5`, `(5` (excluded), `-inf` or `+inf` as a condition on score."""
    if text in ("-inf", "+inf"):
        return F.lit(True)
    x = float(text.removeprefix("("))
    s = F.col("score")
    if text.startswith("("):
        return s < x if upper else s > x
    return s <= x if upper else s >= x


def zrange_by_score(z: DataFrame, lo: str, hi: str) -> DataFrame:
    return z.where(score_bound(lo, False) & score_bound(hi, True))


def lex_bound(text: str, upper: bool) -> Column:
    """`[a`, `(a`, `-` or `+` as a condition on member."""
    if text in ("-", "+"):
        return F.lit(True)
    m, x = F.col("member"), text[1:]
    if text[0] == "(":
        return m < x if upper else m > x
    return m <= x if upper else m >= x


def zrange_by_lex(z: DataFrame, lo: str, hi: str) -> DataFrame:
    return z.where(lex_bound(lo, False) & lex_bound(hi, True))


def zcount(z: DataFrame, lo: str, hi: str) -> DataFrame:
    return zrange_by_score(z, lo, hi).agg(F.count(F.lit(1)).alias("n"))


def zadd(adds: DataFrame, mode: str) -> DataFrame:
    """State after ZADD rows (key, member, score, seq): GT, LT, NX (first), INCR (sum) or last write."""
    agg = {"GT": F.max("score"), "LT": F.min("score"), "NX": F.min_by("score", "seq"), "INCR": F.sum("score"), "SET": F.max_by("score", "seq")}[mode]
    return adds.groupBy("key", "member").agg(agg.alias("score"))


def zpop(z: DataFrame, n: int, largest: bool = False) -> DataFrame:
    return z.orderBy(*([F.col("score").desc(), F.col("member").desc()] if largest else ["score", "member"])).limit(n)


def _weighted(zs: list[DataFrame], weights: list[float] | None) -> DataFrame:
    return reduce(DataFrame.union, [z.select("member", (F.col("score") * w).alias("score"), F.lit(i).alias("src")) for i, (z, w) in enumerate(zip(zs, weights or [1.0] * len(zs), strict=True))])


def zunion(zs: list[DataFrame], weights: list[float] | None = None, how: str = "sum") -> DataFrame:
    return _weighted(zs, weights).groupBy("member").agg(getattr(F, how)("score").alias("score"))


def zinter(zs: list[DataFrame], weights: list[float] | None = None, how: str = "sum") -> DataFrame:
    g = _weighted(zs, weights).groupBy("member").agg(getattr(F, how)("score").alias("score"), F.count_distinct("src").alias("k"))
    return g.where(F.col("k") == len(zs)).drop("k")


def zdiff(zs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select("member"), "member", "left_anti"), zs)


# hashes: (key, field, value)


def hash_maps(h: DataFrame) -> DataFrame:
    """HGETALL per key as a map; a hash is one row of bounded size in its source."""
    return h.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))


def hset(log: DataFrame) -> DataFrame:
    """The last value per key and field."""
    return log.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))


def hincr(log: DataFrame) -> DataFrame:
    """HINCRBY: the sum of increments per key and field."""
    return log.groupBy("key", "field").agg(F.sum("amount").alias("value"))


# lists: array columns


def normal_index(a: Column, i: int) -> Column:
    return F.lit(i) if i >= 0 else F.size(a) + i


def lrange(a: Column, start: int, stop: int) -> Column:
    """Inclusive positions, negative from the end, clamped."""
    n = F.size(a)
    lo = F.greatest(normal_index(a, start), F.lit(0))
    hi = F.least(normal_index(a, stop), n - 1)
    return F.when(lo > hi, F.slice(a, 1, 0)).otherwise(F.slice(a, F.least(lo + 1, F.greatest(n, F.lit(1))), F.greatest(hi - lo + 1, F.lit(0))))


def lindex(a: Column, i: int) -> Column:
    at = normal_index(a, i)
    return F.when((at >= 0) & (at < F.size(a)), F.get(a, at))


def lset(a: Column, i: int, value: Column) -> Column:
    return F.transform(a, lambda x, k: F.when(k == normal_index(a, i), value).otherwise(x))


def lrem(a: Column, count: int, value: Column) -> Column:
    """Removes the first `count` (negative: the last, 0: all) elements equal to value."""
    if count == 0:
        return F.filter(a, lambda x: x != value)
    hits = F.filter(F.transform(a, lambda x, k: F.when(x == value, k)), lambda k: k.isNotNull())
    gone = F.slice(hits, 1, count) if count > 0 else F.slice(F.reverse(hits), 1, -count)
    return F.filter(a, lambda _, k: ~F.array_contains(gone, k))


def linsert(a: Column, pivot: Column, value: Column, before: bool = True) -> Column:
    """Next to the first pivot; unchanged without one."""
    at = F.array_position(a, pivot).cast("int")
    at = at if before else at + 1
    return F.when(F.array_position(a, pivot) == 0, a).otherwise(F.concat(F.slice(a, F.lit(1), at - 1), F.array(value), F.slice(a, at, F.size(a))))


def lpos(a: Column, value: Column, rank: int = 1) -> Column:
    """0-based position of the rank-th match (negative: from the end), or null."""
    hits = F.filter(F.transform(a, lambda x, k: F.when(x == value, k)), lambda k: k.isNotNull())
    return F.try_element_at(hits, F.lit(rank))


# strings: (key, value), bytes in principle; positions are in bytes of the UTF-8 text


def getrange(value: Column, start: int, stop: int) -> Column:
    """Inclusive positions, negative ones from the end, clamped."""
    raw = value.cast("binary")
    n = F.octet_length(raw)
    at = lambda i: F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0))
    lo, hi = at(start), F.least(at(stop), n - 1)
    return F.when(lo > hi, F.lit("")).otherwise(F.substring(raw, lo + 1, F.greatest(hi - lo + 1, F.lit(0))).cast("string"))


def appended(log: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """APPEND: the values of a key joined in order; a key's text is one value, bounded by its source."""
    parts = F.sort_array(F.collect_list(F.struct(seq, value)))
    return log.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[value]), "").alias("value"))


# bitmaps


def bit_count(binary: Column) -> Column:
    """Set bits of a binary value."""
    raw = F.hex(binary)
    at = F.sequence(F.lit(1), F.greatest(F.length(raw), F.lit(1)), F.lit(2))
    return F.when(F.length(raw) > 0, F.aggregate(at, F.lit(0), lambda n, i: n + F.bit_count(F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("int")))).otherwise(0)


def get_bit(binary: Column, i: int) -> Column:
    """Bit i, the highest bit of the first byte being 0; 0 beyond the end."""
    byte = F.conv(F.hex(F.substring(binary, i // 8 + 1, 1)), 16, 10).cast("int")
    return F.coalesce(F.shiftright(byte, 7 - i % 8).bitwiseAND(F.lit(1)), F.lit(0))


# streams: (key, ms, seq, ...), ids strictly increase


def stream_gate(entries: DataFrame, arrival: str, part: str, per: int = PER_RANGE) -> DataFrame:
    """Entries accepted in arrival order: an id not above all ids before it in its stream is refused."""
    seen = running_max(entries, part, arrival, F.struct("ms", "seq"), "_last", per)
    return seen.where(F.col("_last").isNull() | (F.struct("ms", "seq") > F.col("_last"))).drop("_last")


def stream_range(entries: DataFrame, lo: tuple[int, int], hi: tuple[int, int], count: int | None = None, reverse: bool = False) -> DataFrame:
    """XRANGE / XREVRANGE over inclusive ids."""
    at = lambda x: F.struct(F.lit(x[0]).cast("bigint").alias("ms"), F.lit(x[1]).cast("bigint").alias("seq"))
    id_ = F.struct(F.col("ms").cast("bigint").alias("ms"), F.col("seq").cast("bigint").alias("seq"))
    # the plain condition on ms reaches the scan
    out = entries.where(F.col("ms").between(lo[0], hi[0])).where((id_ >= at(lo)) & (id_ <= at(hi)))
    out = out.orderBy(*([F.col("ms").desc(), F.col("seq").desc()] if reverse else ["ms", "seq"]))
    return out if count is None else out.limit(count)


def stream_read(entries: DataFrame, after: tuple[int, int], count: int) -> DataFrame:
    """XREAD: the next entries after an id."""
    later = (F.col("ms") > after[0]) | ((F.col("ms") == after[0]) & (F.col("seq") > after[1]))
    return entries.where(F.col("ms") >= after[0]).where(later).orderBy("ms", "seq").limit(count)


def stream_trim(entries: DataFrame, part: str, max_len: int) -> DataFrame:
    """The newest max_len entries of each stream."""
    w = Window.partitionBy(part).orderBy(F.col("ms").desc(), F.col("seq").desc())
    return entries.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_len).drop("_r")


def stream_min_id(entries: DataFrame, ms: int, seq: int = 0) -> DataFrame:
    return entries.where((F.col("ms") > ms) | ((F.col("ms") == ms) & (F.col("seq") >= seq)))
