"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension until leaves hold the target bytes.

The law is `bytes`: the shards' sizes are near equal. Equal texts are one group and stay in one shard, unless a group is larger than a
whole shard; the rows of such a group are dealt in pieces, in turn from a place that the id's hash gives. Groups of more than `big` of a shard (there are at most
n_shards / big of them, so they may go to the driver) are placed first, largest on the emptiest shard; the tree then splits all other
groups so that each leaf gets what its shard still lacks: a split point is the median weighted by bytes, moved where the two sides lack
unequal amounts.

All work on rows is DataFrame code. The driver sees per level one row of spreads and a histogram of at most `bins` bins for each node.

Defined results: null text counts as the empty text (size 1, crc32 0) and shares its group; null doc_id, lang or source are values like
any other; repeated rows are rows of one group and get slots of their own; an empty table gives no rows; all other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ranked, staged, text_of, values

DIMS = ("x_id", "x_size", "x_source", "x_lang")
TOP = 2**31 - 1


def _weights(docs: DataFrame) -> DataFrame:
    """One slim row for each document: what the tree and the result need, without the text."""
    t = text_of()
    unit = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(1_000_003)).cast("double")
    lang = unit("lang") if "lang" in docs.columns else F.lit(0.0)
    source = unit("source") if "source" in docs.columns else F.lit(0.0)
    return docs.select(
        "doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(t.cast("binary"))).alias("gid"), source.alias("x_source"), lang.alias("x_lang"),
    )


def _place(loads: list[float], pieces: list[tuple]) -> dict:
    """Largest piece first, each on the shard with the least so far. pieces: (bytes, key)."""
    where = {}
    for size, key in sorted(pieces, key=lambda p: (-p[0], p[1])):
        j = min(range(len(loads)), key=lambda i: (loads[i], i))
        loads[j] += size
        where[key] = j
    return where


def _key(node: dict, d: str):
    """The sortable position of a group along dimension d inside a node: 31 bits of the value, then 32 bits of tie break."""
    lo, hi = node["lo"][d], node["hi"][d]
    q = F.lit(0).cast("long") if hi <= lo else F.floor((F.col(d) - F.lit(lo)) / F.lit(hi - lo) * F.lit(TOP)).cast("long")
    return F.shiftleft(F.least(F.greatest(q, F.lit(0)), F.lit(TOP)), 32) + F.col("tie")


def _split(groups: DataFrame, nodes: list[dict], bins_bits: int, close: float) -> None:
    """Finds `cut` for each node: groups with a key below it go left. Histograms are refined until the bin at the cut is light."""
    for n in nodes:
        n |= {"from": 0, "shift": 63 - bins_bits, "below": 0.0, "open": True, "cut": 0}
    while any(n["open"] for n in nodes):
        live = [n for n in nodes if n["open"]]
        bin_of = F.lit(None).cast("long")
        for n in live:
            k = _key(n, n["dim"]) - F.lit(n["from"])
            inside = (F.col("node") == n["id"]) & (k >= 0) & (F.shiftright(k, n["shift"]) < (1 << bins_bits))
            bin_of = F.when(inside, F.shiftright(k, n["shift"])).otherwise(bin_of)
        rows = groups.select("node", "bytes", bin_of.alias("bin")).where("bin IS NOT NULL").groupBy("node", "bin").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("c")).collect()
        for n in live:
            acc, best = n["below"], None
            for r in sorted((r for r in rows if r["node"] == n["id"]), key=lambda r: r["bin"]):
                if acc + r["b"] > n["want"]:
                    best = r
                    break
                acc += r["b"]
            at = n["from"] + ((best["bin"] if best else 1 << bins_bits) << n["shift"])
            if best is None or best["c"] == 1 or best["b"] <= close or n["shift"] == 0:
                # the bin goes to the side that leaves the smaller error
                over = best is not None and acc + best["b"] - n["want"] < n["want"] - acc
                n |= {"cut": min(at + ((1 << n["shift"]) if over else 0), 2**63 - 1), "open": False}
            else:
                step = min(bins_bits, n["shift"])
                n |= {"from": at, "below": acc, "shift": n["shift"] - step}


def kd_shards(docs: DataFrame, n_shards: int = 16, big: float = 0.05, bins_bits: int = 9) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law `bytes` has none) for every row of docs."""
    spark = docs.sparkSession
    base = staged(_weights(docs), "weights")
    groups = base.groupBy("gid").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.coalesce(F.min("doc_id"), F.lit(0)).cast("double").alias("x_id"),
        F.log2(F.max("size")).alias("x_size"), F.min("x_source").alias("x_source"), F.min("x_lang").alias("x_lang"),
    )
    groups = groups.withColumn("tie", F.conv(F.substring(F.hex("gid"), 1, 8), 16, 10).cast("long"))
    groups = staged(groups, "groups")
    total, rows = groups.agg(F.sum("bytes"), F.sum("n")).first()
    if not total:
        return base.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    share = total / n_shards
    heavy = {bytes(r["gid"]): r for r in groups.where(F.col("bytes") > F.lit(big * share)).select("gid", "bytes").collect()}  # fewer than n_shards / big
    split = values(spark, [(g, max(1, -(-r["bytes"] * 8 // int(share + 1)) if r["bytes"] > share else 1)) for g, r in heavy.items()], "gid BINARY, pieces INT")
    if heavy:
        part = F.pmod(F.xxhash64("doc_id") + F.monotonically_increasing_id(), F.col("pieces")).cast("int")
        dealt = staged(base.join(F.broadcast(split), "gid").withColumn("piece", part), "heavy")
    pieces = dealt.groupBy("gid", "piece").agg(F.sum("size").alias("b")).collect() if heavy else []
    loads = [0.0] * n_shards
    where = _place(loads, [(r["b"], (bytes(r["gid"]), r["piece"])) for r in pieces])
    rest = total - sum(loads)
    lacks = _lacks(loads, rest)

    light = groups.where(F.col("bytes") <= F.lit(big * share)).withColumn("node", F.lit(0))
    leaf = F.lit(0)
    nodes = [{"id": 0, "leaves": list(range(n_shards)), "from_bytes": 0.0}]
    spread = None
    while any(len(n["leaves"]) > 1 for n in nodes):
        live = [n for n in nodes if len(n["leaves"]) > 1]
        tree = light.withColumn("node", leaf)
        found = {r["node"]: r for r in tree.groupBy("node").agg(*(f(d).alias(f"{k}_{d}") for d in DIMS for k, f in (("lo", F.min), ("hi", F.max))), F.sum("bytes").alias("b")).collect()}
        if spread is None and found:
            spread = {d: max(found[0][f"hi_{d}"] - found[0][f"lo_{d}"], 1e-9) for d in DIMS}
        nxt, asked = [n for n in nodes if len(n["leaves"]) == 1], []
        for n in live:
            half = len(n["leaves"]) // 2
            left, right = n["leaves"][:half], n["leaves"][half:]
            r = found.get(n["id"])
            if r is None:
                n |= {"lo": dict.fromkeys(DIMS, 0.0), "hi": dict.fromkeys(DIMS, 0.0), "dim": DIMS[0], "cut": 0}
            else:
                n |= {"lo": {d: r[f"lo_{d}"] for d in DIMS}, "hi": {d: r[f"hi_{d}"] for d in DIMS}}
                n["dim"] = max(DIMS, key=lambda d: ((n["hi"][d] - n["lo"][d]) / spread[d], -DIMS.index(d)))
                need_l, need = sum(lacks[j] for j in left), sum(lacks[j] for j in n["leaves"])
                n["want"] = r["b"] * (need_l / need if need else 0.5)
                asked.append(n)
            n["kids"] = (2 * n["id"] + 1, 2 * n["id"] + 2)
            nxt += [{"id": n["kids"][0], "leaves": left}, {"id": n["kids"][1], "leaves": right}]
        if asked:
            _split(tree, asked, bins_bits, close=share / 2000)
        step = leaf
        for n in live:
            step = F.when(leaf == n["id"], F.when(_key(n, n["dim"]) < F.lit(n["cut"]), F.lit(n["kids"][0])).otherwise(F.lit(n["kids"][1]))).otherwise(step)
        placed = light.withColumn("node", step)
        light, leaf = staged(placed, "tree"), F.col("node")
        nodes = nxt
    shard = F.lit(0)
    for n in nodes:
        shard = F.when(F.col("node") == n["id"], F.lit(n["leaves"][0])).otherwise(shard)
    of_light = light.select("gid", shard.alias("shard"))
    columns = ("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"))
    if heavy:  # few groups, whose rows need no join by group
        big_rows = values(spark, [(g, p, j) for (g, p), j in where.items()], "gid BINARY, piece INT, shard INT")
        out = base.join(F.broadcast(split), "gid", "left_anti").join(of_light, "gid").select(*columns)
        out = out.union(dealt.join(F.broadcast(big_rows), ["gid", "piece"]).select(*columns))
    else:
        out = base.join(of_light, "gid").select(*columns)
    # the tie tells repeated rows apart, so that a hot id is no hot bucket
    out = staged(out.withColumn("tie", F.monotonically_increasing_id()), "shards")
    out = ranked(out, ["shard"], F.struct("doc_id", "tie"), [F.col("doc_id").asc_nulls_first(), "size", "text_crc32", "tie"], rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _lacks(loads: list[float], rest: float) -> list[float]:
    """What each shard gets of the rest so that all end near equal: levels are filled from the emptiest shard."""
    level, order = 0.0, sorted(loads)
    for k in range(1, len(order) + 1):
        level = (rest + sum(order[:k])) / k
        if k == len(order) or level <= order[k]:
            break
    return [max(0.0, level - x) for x in loads]
