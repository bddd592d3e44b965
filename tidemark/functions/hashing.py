"""FNV-1a sharding and the consistent-hash ring, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
WRAP = 1 << 64


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME % WRAP
    return h


def _dec(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def _limbs(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as a struct of two 32-bit limbs (hi, lo), in the JVM.

    The prime is 2 ** 40 + 435, so that a product is a shift and a small product, and all of it stays in 63 bits.
    """
    raw = F.hex(F.encode(text, "UTF-8"))
    at = F.sequence(F.lit(1), F.greatest(F.length(raw), F.lit(1)), F.lit(2))
    bytes_ = F.when(F.length(raw) > 0, F.transform(at, lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    low32 = F.lit(0xFFFFFFFF).cast("bigint")
    limbs = lambda hi, lo: F.struct(hi.cast("bigint").alias("hi"), lo.cast("bigint").alias("lo"))

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"].bitwiseXOR(b)
        small = F.lit(FNV_PRIME - (1 << 40)).cast("bigint")
        return limbs((h["hi"] * small + F.shiftright(lo * small, 32) + F.shiftleft(lo, 8)).bitwiseAND(low32), (lo * small).bitwiseAND(low32))

    return F.aggregate(bytes_, limbs(F.lit(FNV_OFFSET >> 32), F.lit(FNV_OFFSET & 0xFFFFFFFF)), step)


def fnv1a_col(text: Column) -> Column:
    """Unsigned 64-bit FNV-1a of the UTF-8 bytes as decimal(38,0)."""
    return F.aggregate(F.array(_limbs(text)), _dec(0), lambda _, h: (h["hi"].cast("decimal(20,0)") * F.lit(str(1 << 32)).cast("decimal(11,0)") + h["lo"].cast("decimal(20,0)")).cast("decimal(38,0)"))


def shard_of(text: Column, shards: int) -> Column:
    """FNV-1a modulo the number of shards (below 2 ** 31)."""
    return F.aggregate(F.array(_limbs(text)), F.lit(0).cast("bigint"), lambda _, h: (h["hi"] % shards * ((1 << 32) % shards) + h["lo"] % shards) % shards).cast("int")


def ring(members: list[str], vnodes: int = 160) -> list[tuple[int, str]]:
    """Sorted (hash, member) of all virtual nodes."""
    return sorted((fnv1a(f"{m}#vnode{i}".encode()), m) for m in members for i in range(vnodes))


def ring_frame(spark: SparkSession, members: list[str], vnodes: int = 160) -> DataFrame:
    """The ring as intervals (lo, hi], owner; the first member also owns what lies above the last hash."""
    r = ring(members, vnodes)
    rows = [(str(lo), str(hi), m) for (lo, _), (hi, m) in zip([(-1, ""), *r], r, strict=False)] + [(str(r[-1][0]), str(WRAP), r[0][1])]
    return spark.createDataFrame(rows, "lo string, hi string, owner string").select(*(F.col(c).cast("decimal(20,0)").alias(c) for c in ("lo", "hi")), "owner")


def owner_col(h: Column, members: list[str], vnodes: int = 160) -> Column:
    """Owner of a hash as a balanced tree of comparisons; the ring has a few thousand entries at most."""
    r = ring(members, vnodes)

    def find(a: int, b: int) -> Column:
        if b - a == 1:
            return F.lit(r[a % len(r)][1])
        m = (a + b) // 2
        return F.when(h <= _dec(r[m - 1][0]), find(a, m)).otherwise(find(m, b))

    return find(0, len(r) + 1)


def owners(df: DataFrame, key: str, members: list[str], vnodes: int = 160, buckets: int = 1024) -> DataFrame:
    """df with `owner`: an equi-join on the hash's bucket with the (small, fixed) ring, then the interval test."""
    spark = df.sparkSession
    width = WRAP // buckets
    ivals = ring_frame(spark, members, vnodes)
    b = lambda c: F.floor(c / _dec(width)).cast("int")
    cells = ivals.withColumn("bucket", F.explode(F.sequence(b(F.greatest(F.col("lo"), F.lit(0).cast("decimal(20,0)"))), F.least(b(F.col("hi")), F.lit(buckets - 1)))))
    keyed = df.withColumn("_h", fnv1a_col(F.col(key).cast("string")).cast("decimal(20,0)"))
    keyed = keyed.withColumn("bucket", b(F.col("_h")))
    j = keyed.join(F.broadcast(cells), "bucket").where((F.col("_h") > F.col("lo")) & (F.col("_h") <= F.col("hi")))
    return j.drop("bucket", "lo", "hi", "_h")
