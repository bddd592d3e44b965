"""Commands on strings, keys, lists, sorted sets, streams and request budgets, as Columns and DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.collections import lex_bound, lrange, score_bound, zrank
from tidemark.operators.ordered import PER_RANGE, nulls_last, running_max

# strings


def set_range(value: Column, offset: int, part: Column) -> Column:
    """SETRANGE over single-byte text: part replaces what stands from the offset on; a gap is filled with zero bytes, no part changes nothing."""
    v = F.coalesce(value, F.lit(""))
    padded = F.rpad(v, F.greatest(F.length(v), F.lit(offset)), "\0")
    done = F.concat(F.substring(padded, 1, offset) if offset else F.lit(""), part, F.substring(padded, F.lit(offset + 1) + F.length(part), F.length(padded)))
    return F.when(F.length(part) == 0, v).otherwise(done)


def set_bit(binary: Column, i: int, on: bool) -> Column:
    """SETBIT: the binary value with bit i (the highest of the first byte is 0) set or cleared; zero bytes are added up to it."""
    at, mask = i // 8, 0x80 >> i % 8
    raw = F.coalesce(binary, F.lit(b""))
    padded = F.rpad(raw, F.greatest(F.length(raw), F.lit(at + 1)), F.lit(b"\0"))
    byte = F.conv(F.hex(F.substring(padded, at + 1, 1)), 16, 10).cast("int")
    new = byte.bitwiseOR(F.lit(mask)) if on else byte.bitwiseAND(F.lit(255 - mask))
    head = F.substring(padded, 1, at) if at else F.lit(b"")
    return F.concat(head, F.unhex(F.lpad(F.hex(new), 2, "0")), F.substring(padded, F.lit(at + 2), F.length(padded)))


def bit_count_range(binary: Column, start: int, stop: int, bits: bool = False) -> Column:
    """BITCOUNT over inclusive positions, by byte or by bit, negative ones from the end."""
    text = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(binary), F.lit(1))), lambda i: F.lpad(F.conv(F.hex(F.substring(binary, i, F.lit(1))), 16, 2), 8, "0")),
        F.lit(""), lambda a, b: F.concat(a, b),
    )
    n = F.length(binary) * (8 if bits else 1)
    at = lambda i: F.lit(i) if i >= 0 else n + i
    lo, hi = F.greatest(at(start), F.lit(0)), F.least(at(stop), n - 1)
    unit = 1 if bits else 8
    part = F.substring(text, lo * unit + 1, F.greatest(hi - lo + 1, F.lit(0)) * unit)
    return F.when(F.length(binary) == 0, 0).otherwise(F.length(F.replace(part, F.lit("0"), F.lit(""))))


# keys: (key, value, kind, expires_at)


def rename(keys: DataFrame, src: str, dst: str, only_new: bool = False) -> DataFrame:
    """RENAME / RENAMENX: src takes the name dst, whose old value goes; nothing happens without src, or for RENAMENX with dst there."""
    have = keys.agg(F.coalesce(F.bool_or(F.col("key") == src), F.lit(False)).alias("_s"), F.coalesce(F.bool_or(F.col("key") == dst), F.lit(False)).alias("_d"))
    go = F.col("_s") & ~F.col("_d") if only_new else F.col("_s")
    k = keys.crossJoin(F.broadcast(have))  # one row
    stays = ~(go & (F.col("key") == dst)) if src != dst else F.lit(True)
    return k.where(stays).withColumn("key", F.when(go & (F.col("key") == src), F.lit(dst)).otherwise(F.col("key"))).drop("_s", "_d")


def copy(keys: DataFrame, src: str, dst: str, replace: bool = False) -> DataFrame:
    """COPY: dst gets the value and expiry of src; without `replace` only if there is no dst."""
    new = keys.where(F.col("key") == src).withColumn("key", F.lit(dst))
    if replace:
        there = new.select("key")
        return keys.join(F.broadcast(there), "key", "left_anti").select(*keys.columns).union(new.select(*keys.columns))
    old = keys.where(F.col("key") == dst).select("key")
    return keys.union(new.join(F.broadcast(old), "key", "left_anti").select(*keys.columns))


def set_if_all_new(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """MSETNX: the rows are added if none of their keys is there, else none is."""
    clash = keys.join(rows.select("key"), "key", "left_semi").agg((F.count(F.lit(1)) > 0).alias("_clash"))
    return keys.union(rows.crossJoin(F.broadcast(clash)).where("NOT _clash").select(*keys.columns))


def read_and(keys: DataFrame, names: list[str], expires_at: int | None = None, delete: bool = False) -> tuple[DataFrame, DataFrame]:
    """(values read, state after) of GETDEL, or GETEX with a new expiry (null: PERSIST)."""
    hit = F.col("key").isin(names)
    read = keys.where(hit).select("key", "value")
    if delete:
        return read, keys.where(~hit)
    return read, keys.withColumn("expires_at", F.when(hit, F.lit(expires_at).cast("long")).otherwise(F.col("expires_at")))


def persist(keys: DataFrame, names: list[str]) -> DataFrame:
    return read_and(keys, names)[1]


# lists as arrays


def ltrim(a: Column, start: int, stop: int) -> Column:
    """LTRIM keeps inclusive positions."""
    return lrange(a, start, stop)


def lpop(a: Column, n: int, right: bool = False) -> tuple[Column, Column]:
    """(elements popped, in the order in which they go, and the list left)."""
    k = F.least(F.lit(n), F.size(a))
    if right:
        return F.reverse(F.slice(a, F.size(a) - k + 1, k)), F.slice(a, F.lit(1), F.size(a) - k)
    return F.slice(a, F.lit(1), k), F.slice(a, k + 1, F.size(a))


def lmove(src: Column, dst: Column, from_right: bool, to_right: bool) -> tuple[Column, Column]:
    """(src, dst) after one element has moved; without one nothing moves."""
    got, left = lpop(src, 1, from_right)
    return left, F.concat(dst, got) if to_right else F.concat(got, dst)


def lpos_all(a: Column, value: Column, count: int = 0) -> Column:
    """LPOS COUNT: the 0-based positions of the first `count` matches (0: all)."""
    every = F.filter(F.transform(a, lambda x, i: F.when(x == value, i)), lambda i: i.isNotNull())
    return F.slice(every, 1, count) if count else every


# sorted sets: (member, score), within `parts`


def zrem_by_rank(z: DataFrame, start: int, stop: int, parts: list[str]) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*parts))
    at = lambda i: F.lit(i).cast("long") if i >= 0 else n + i
    r = zrank(z, parts).withColumn("_gone", F.col("rank").between(F.greatest(at(start), F.lit(0).cast("long")), at(stop)))
    return r.where("NOT _gone").drop("_gone", "rank")


def zrem_by_score(z: DataFrame, lo: str, hi: str) -> DataFrame:
    return z.where(~(score_bound(lo, False) & score_bound(hi, True)))


def zrem_by_lex(z: DataFrame, lo: str, hi: str) -> DataFrame:
    return z.where(~(lex_bound(lo, False) & lex_bound(hi, True)))


def zlimit(z: DataFrame, offset: int, count: int, reverse: bool = False) -> DataFrame:
    """The LIMIT of ZRANGE BYSCORE / BYLEX, in ascending or REV order."""
    order = [F.col("score").desc(), F.col("member").desc()] if reverse else [F.col("score"), F.col("member")]
    return z.orderBy(*order).offset(offset).limit(count)


def zmscore(z: DataFrame, members: DataFrame) -> DataFrame:
    """The score of every member asked for, null where it has none."""
    return members.select("member").distinct().join(z.select("member", "score"), "member", "left")


def zadd_flags(z: DataFrame, adds: DataFrame, mode: str = "") -> DataFrame:
    """(member, score, changed) after ZADD with NX, XX, GT, LT or none; CH counts the changed ones."""
    j = z.select("member", F.col("score").alias("old")).join(adds.select("member", F.col("score").alias("new")), "member", "full")
    new = {"NX": F.coalesce("old", "new"), "XX": F.when(F.col("old").isNotNull(), F.coalesce("new", "old")), "GT": F.greatest("old", "new"), "LT": F.least("old", "new"), "": F.coalesce("new", "old")}[mode]
    return j.withColumn("score", new).where("score IS NOT NULL").select("member", "score", (~F.col("old").eqNullSafe(F.col("score"))).alias("changed"))


# streams: (key, ms, seq, ...)


def stream_ids(entries: DataFrame, part: str, arrival: str, clock: str) -> DataFrame:
    """XADD with `*`: an entry's ms is the clock, or the last one's if the clock is behind; seq counts entries of one ms from 0.

    Per stream a running maximum and a running count; a stream is ordered in one task, as its ids are.
    """
    w = Window.partitionBy(part).orderBy(arrival)
    e = entries.withColumn("ms", F.max(clock).over(w))
    return e.withColumn("seq", (F.row_number().over(Window.partitionBy(part, "ms").orderBy(arrival)) - 1).cast("long"))


def stream_delete(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """XDEL: entries without the given (key, ms, seq)."""
    return entries.join(ids, ["key", "ms", "seq"], "left_anti")


# budgets


def token_bucket(requests: DataFrame, part: str, ts: str, order: str, per_second: float, per: int | None = None) -> DataFrame:
    """requests with `allowed`: a bucket of per_second tokens, full at first, gains elapsed seconds times per_second, is capped, and a request
    spends one if there is one. Nulls of ts and order come last; a request without ts finds a full bucket.

    What is spent depends on what was allowed before. But a second without requests fills the bucket whatever it held, so the requests between
    two such pauses are a burst of their own. Bursts are dealt to the tasks and folded in order as they are read: a task holds a batch and one
    number. The doubles are added in the order of the requests, so a burst is not divided; one that never pauses is one task's work.
    """
    rows = requests.select(part, ts, order).withColumn("_s", F.floor(F.col(ts) / 1000))
    seconds = rows.where(F.col(ts).isNotNull()).groupBy(part, "_s").agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    per = per or PER_RANGE
    paused = running_max(seconds, part, "_s", F.col("_hi"), "_last", per).withColumn("_at", F.when(F.col("_last").isNull() | (F.col("_lo") - F.col("_last") >= 1000), F.col("_lo")))
    bursts = running_max(paused, part, "_s", F.col("_at"), "_since", per).select(F.col(part).alias("_p"), F.col("_s").alias("_k"), F.coalesce("_at", "_since").alias("_burst"))
    rows = rows.join(bursts, F.col(part).eqNullSafe(F.col("_p")) & F.col("_s").eqNullSafe(F.col("_k")), "left").select(part, ts, order, "_burst")
    keys = [part, "_burst", *nulls_last([F.col(ts), F.col(order)])]
    dealt = rows.repartition(part, "_burst").sortWithinPartitions(*keys)
    schema = requests.select(part, ts, order).schema.add("allowed", "boolean")
    return dealt.mapInArrow(_folded(float(per_second)), schema)


def _folded(full: float):
    """The requests of bursts that follow each other in order (part, time, order, burst), with what the bucket allows."""

    def run(batches):
        import pyarrow as pa

        now, tokens, before = None, full, None
        for b in batches:
            allowed = []
            for part, burst, t in zip(*(b.column(i).to_pylist() for i in (0, 3, 1)), strict=True):
                if (part, burst) != now or t is None:
                    now, have = (part, burst), full
                else:
                    have = min(tokens + (t - before) / 1000.0 * full, full)
                ok = have >= 1.0
                tokens, before = have - 1.0 if ok else have, t
                allowed.append(ok)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(allowed, pa.bool_())], names=[*b.schema.names[:3], "allowed"])

    return run
