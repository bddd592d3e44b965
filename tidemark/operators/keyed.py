"""Keyed state as a change log: (seq, ts, key, op, data...) rows; the state is the latest row per key without tombstones.

Latest-per-key is an aggregate (`max_by` of a struct), which combines before the shuffle, and not a window, which would sort every
version of a hot key in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELETE = "delete"


def latest_per_key(log: DataFrame, key: str | list[str], order: str | list[str], keep_deleted: bool = True) -> DataFrame:
    """The last row of each key in the given order."""
    keys, orders = ([x] if isinstance(x, str) else x for x in (key, order))
    rest = [c for c in log.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*orders)).alias("_r")
    out = log.groupBy(*keys).agg(best).select(*keys, "_r.*").select(*log.columns)
    return out if keep_deleted else out.where(F.col("op") != DELETE)


def first_per_key(log: DataFrame, key: str, order: str) -> DataFrame:
    """SETNX: the first write of each key wins."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order)).alias("_r")).select(key, "_r.*").select(*log.columns)


def current(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The state after the whole log."""
    return latest_per_key(log, key, seq, keep_deleted=False)


def as_of(log: DataFrame, at, time: str = "seq", key: str = "key", seq: str | None = None) -> DataFrame:
    """The state that a snapshot at a time sees: newest version not after it, tombstones dropped."""
    return latest_per_key(log.where(F.col(time) <= F.lit(at)), key, seq or time, keep_deleted=False)


def versions(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Keys with their version: how many writes they had, and the last one's seq."""
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("version"), F.max(seq).alias("head_seq"))


def collect_garbage(log: DataFrame, oldest_snapshot: int, key: str = "key", seq: str = "seq") -> DataFrame:
    """Drops versions that no snapshot can see: of those not after the oldest snapshot only the newest per key stays."""
    old = latest_per_key(log.where(F.col(seq) <= oldest_snapshot), key, seq)
    return log.where(F.col(seq) > oldest_snapshot).unionByName(old)


def conflicts(log: DataFrame, writes: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Write-set rows (key, read_seq) whose key has a newer version than their snapshot read."""
    heads = log.groupBy(key).agg(F.max(seq).alias("head_seq"))
    return writes.join(heads, key).where(F.col("head_seq") > F.col("read_seq"))


def overlay(base: DataFrame, changes: DataFrame, key: str = "key", op: str = "op") -> DataFrame:
    """Base rows without the changed keys, plus the changes that are no deletes (a transaction's own view)."""
    kept = base.join(changes.select(key), key, "left_anti")
    return kept.select(*base.columns).unionByName(changes.where(F.col(op) != DELETE).select(*base.columns))


def replay(snapshot: DataFrame, tail: DataFrame, last_seq: int, key: str = "key", seq: str = "seq", until: int | None = None, time: str = "ts") -> DataFrame:
    """A snapshot with the log after it applied: duplicates of a seq count once, and with `until` only entries up to that time."""
    t = tail.where(F.col(seq) > last_seq)
    t = t if until is None else t.where(F.col(time) <= until)
    t = t.dropDuplicates([seq])
    return overlay(snapshot, latest_per_key(t, key, seq), key)


def gaps(log: DataFrame, seq: str = "seq", part: str | None = None, per: int = 1_000_000) -> DataFrame:
    """Missing ranges of sequence numbers (after, before) of a log; blocks of numbers are checked apart and joined at their edges."""
    log = log.select(seq, *([part] if part else [])).distinct().withColumn("_b", F.floor(F.col(seq) / per))
    parts = [part] if part else []
    inner = Window.partitionBy(*parts, "_b").orderBy(seq)
    found = log.withColumn("_p", F.lag(seq).over(inner))
    edges = log.groupBy(*parts, "_b").agg(F.min(seq).alias("lo"), F.max(seq).alias("hi"))
    blocks = Window.partitionBy(*parts).orderBy("_b")
    edges = edges.withColumn("after", F.lag("hi").over(blocks)).select(*parts, "after", F.col("lo").alias("before"))
    inside = found.select(*parts, F.col("_p").alias("after"), F.col(seq).alias("before"))
    return inside.union(edges).where("before > after + 1")


def serve(log: DataFrame, after: int, limit: int, seq: str = "seq") -> DataFrame:
    """The next entries of a log for a replica."""
    return log.where(F.col(seq) > after).orderBy(seq).limit(limit)


def counters(adds: DataFrame, name: str, amount: str, time: str) -> DataFrame:
    """Counters of commutative increments with the time of the last one."""
    return adds.groupBy(name).agg(F.sum(amount).alias("value"), F.max(time).alias("last_modified"))


def alive(df: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Rows that have not expired; null never expires."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > now))


def expired(sets: DataFrame, now: Column, key: str = "key", seq: str = "seq", expires: str = "expires_at") -> DataFrame:
    """Keys due at `now`; the last set or cancel (null) of a key holds."""
    return latest_per_key(sets, key, seq).where(F.col(expires) <= now)


def ttl_seconds(expires: Column, now_ms: Column) -> Column:
    """Seconds to live, rounded up: -1 without expiry, -2 when gone."""
    left = expires - now_ms
    return F.when(expires.isNull(), F.lit(-1)).when(left <= 0, F.lit(-2)).otherwise(F.ceil(left / 1000)).cast("bigint")


def expire_if(current_ms: Column, new_ms: Column, mode: str) -> Column:
    """EXPIRE with NX, XX, GT or LT: the expiry that holds afterwards. No expiry counts as infinite for GT and LT."""
    ok = {"NX": current_ms.isNull(), "XX": current_ms.isNotNull(), "GT": F.coalesce(new_ms > current_ms, F.lit(False)), "LT": current_ms.isNull() | (new_ms < current_ms)}[mode]
    return F.when(ok, new_ms).otherwise(current_ms)


def presence(beats: DataFrame, now: Column, idle: int, offline: int, user: str = "user_id", time: str = "ts") -> DataFrame:
    """Users not yet offline, Online or Idle by the time since their last heartbeat."""
    last = beats.groupBy(user).agg(F.max(time).alias("last_seen")).withColumn("elapsed", now - F.col("last_seen"))
    return last.where(F.col("elapsed") < offline).withColumn("status", F.when(F.col("elapsed") >= idle, "Idle").otherwise("Online"))


def row_cap(df: DataFrame, cap: int, part: str, access: str, key: str) -> DataFrame:
    """LRU: the `cap` most recently used rows of each part. Rows are first cut to `cap` within (part, hash bucket)."""
    order = [F.col(access).desc(), F.col(key)]
    b = F.pmod(F.xxhash64(key), F.lit(64))
    pre = df.withColumn("_b", b).withColumn("_r", F.row_number().over(Window.partitionBy(part, "_b").orderBy(*order))).where(F.col("_r") <= cap)
    return pre.withColumn("_r", F.row_number().over(Window.partitionBy(part).orderBy(*order))).where(F.col("_r") <= cap).drop("_r", "_b")


def upsert(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Whole-row replacement by key; of several new rows of a key any is a caller's error."""
    return base.join(rows.select(key), key, "left_anti").select(*base.columns).unionByName(rows.select(*base.columns))


def stat_sync(queue: DataFrame, key: str, seq: str, region: str) -> DataFrame:
    """A drained queue of row upserts: the last row per key, to be written by region."""
    return latest_per_key(queue, [region, key], seq)


def rate_buckets(requests: DataFrame, tenant: str, second: Column, limit: int) -> DataFrame:
    """Requests per tenant and second, those above the limit counted as refused."""
    n = requests.groupBy(tenant, second.alias("second")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("refused", F.greatest(F.col("n") - limit, F.lit(0)))
