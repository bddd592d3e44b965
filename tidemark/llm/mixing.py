"""Mixing sources to target weights: blocks, multinomial counts per output shard, permuted slots, a join by block index.

The words of a source, document after document, are cut into blocks of `block` words; the last block of a source may be shorter. A source's
target is turned into slots: in each epoch every block of the source has one slot, and the last epoch ends, in the middle of a block if need
be, where the target is reached. Output shards of `shard_slots` slots draw their counts per source from a multinomial over what the
sources still have to give; what a draw would take beyond that is drawn again, so that the counts add up to the targets. The k-th slot of
a source's epoch holds block perm(k), where perm is a keyed Feistel permutation of the source's full blocks (the short block comes last).
Joining slots to blocks by (source, block) says which words of which documents are taken, and how often.

The driver holds one row for each source (at most `max_sources`) and one for each pair of output shard and source; the number of shards is
held to `max_shards` by longer shards.

Defined results: sources are ordered by code point with null last; null and empty texts have size 0 and nothing of them is taken; repeated
rows are documents of their own; an empty table gives no rows; all columns but doc_id, source and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ranked, staged, text_of, values, words_of

#: What tells a row from others; rows alike in all of it are numbered by `twin` and are interchangeable.
KEY = ("doc_id", "source", "size", "crc", "twin")


def _keys() -> dict:
    return {"doc_id": F.col("doc_id"), "source": F.col("source").cast("string"), "size": F.size(words_of(text_of())).cast("long"), "crc": F.crc32(text_of().cast("binary"))}


def targets(sizes: list[int], weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> list[Fraction]:
    """Shares of all sizes by repeating weights; none above `most` times its size, the excess reshared by weight."""
    total, caps = Fraction(sum(sizes)), [Fraction(most * s) for s in sizes]
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), total
    while free:
        per = left / sum(w[i] for i in free)
        over = [i for i in free if per * w[i] > caps[i]]
        if not over:
            for i in free:
                out[i] = per * w[i]
            break
        for i in over:
            out[i] = caps[i]
            left -= caps[i]
            free.discard(i)
    return out


def draw_counts(slots: list[int], shard_slots: int, seed: int) -> list[np.ndarray]:
    """Counts per source for each output shard: multinomial over the remaining slots, redrawn where a source runs out."""
    rng, left, out = np.random.default_rng(seed), np.array(slots, dtype=np.int64), []
    while left.sum():
        got, need = np.zeros_like(left), int(min(shard_slots, left.sum()))
        while need:
            rest = left - got
            got += np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
            need = int(min(shard_slots, left.sum()) - got.sum())
        out.append(got)
        left -= got
    return out


def permute(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0 .. n - 1: four Feistel rounds over the next even power of two, walked until inside."""
    if n <= 1:
        return k.copy()
    half = np.uint64((max(2, int(n - 1).bit_length()) + 1) // 2)
    low = (np.uint64(1) << half) - np.uint64(1)
    x, todo = k.astype(np.uint64), np.ones(len(k), dtype=bool)
    while todo.any():
        left, right = x[todo] >> half, x[todo] & low
        for r in range(4):
            m = right + np.uint64((key + r * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
            m = (m ^ (m >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            m = (m ^ (m >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((m ^ (m >> np.uint64(31))) & low)
        x[todo] = (left << half) | right
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


def _slots(seed: int):
    """From (sid, epoch0.., count) rows of output shards to one row for each slot with its block."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                at = np.arange(r.first, r.first + r.n, dtype=np.int64)
                epoch, k = at // r.blocks, at % r.blocks
                idx = np.where(k < r.full, 0, k)
                for e in np.unique(epoch):
                    here = (epoch == e) & (k < r.full)
                    idx[here] = permute(k[here], int(r.full), seed * 1_000_003 + int(r.sid) * 7919 + int(e))
                take = np.minimum(r.block, r.target - epoch * r.size - k * r.block)
                yield pd.DataFrame({"out_shard": r.out_shard, "sid": r.sid, "epoch": epoch, "blk": idx, "take": take})

    return expand


def mixed(docs: DataFrame, block: int = 512, shard_slots: int = 4096, seed: int = 20, weights: tuple[int, ...] = (1, 2, 3), max_sources: int = 100_000, max_shards: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): all documents with their places in the sources, and the taken word ranges.

    documents has the columns of KEY, source_size, target, and its place (sid, at). pieces has (sid, at, epoch, lo, hi): words lo to
    hi - 1 of the document at word `at` of source `sid`.
    """
    spark = docs.sparkSession
    slim = docs.select(*(c.alias(k) for k, c in _keys().items()))
    slim = staged(slim.withColumn("twin", F.row_number().over(Window.partitionBy("doc_id", "source", "size", "crc").orderBy("size"))), "sizes")
    per = slim.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()
    if len(per) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources if the driver can hold their targets")
    per.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes, n_rows = [r["s"] for r in per], sum(r["n"] for r in per)
    want = targets(sizes, weights)
    take = [int(t + Fraction(1, 2)) for t in want]
    blocks = [-(-s // block) for s in sizes]
    slots = [(t // s) * b + -(-(t % s) // block) if s else 0 for t, s, b in zip(take, sizes, blocks, strict=True)]
    shard_slots = max(shard_slots, -(-sum(slots) // max_shards))
    plan, first = [], [0] * len(per)
    for h, counts in enumerate(draw_counts(slots, shard_slots, seed)):
        for i in np.flatnonzero(counts):
            plan.append((h, int(i), first[i], int(counts[i]), blocks[i], sizes[i] // block, block, sizes[i], take[i]))
            first[i] += int(counts[i])
    schema = "out_shard long, sid int, first long, n long, blocks long, full long, block long, size long, target long"
    plan_df = spark.createDataFrame(plan, schema)

    ids = values(spark, [(i, r["source"], r["s"], float(t)) for i, (r, t) in enumerate(zip(per, want, strict=True))], "sid INT, source STRING, source_size LONG, target DOUBLE")
    ids = ids.withColumnRenamed("source", "of_source")
    known = slim.join(F.broadcast(ids), slim["source"].eqNullSafe(ids["of_source"]))
    placed = ranked(known, ["sid"], F.struct(*KEY), [F.col("doc_id").asc_nulls_first(), "size", "crc", "twin"], n_rows, weight=F.col("size"), out="at")
    placed = staged(placed.select(*KEY, "source_size", "target", "sid", F.col("at").cast("long").alias("at")), "placed")

    b = F.lit(block)
    parts = placed.where("size > 0").select("sid", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))).alias("blk"))
    start = F.col("blk") * b
    parts = parts.select("sid", "at", "blk", F.greatest(F.col("at"), start).alias("lo"), F.least(F.col("at") + F.col("size"), start + b).alias("hi"))
    chosen = plan_df.repartition(max(1, min(len(plan), spark.sparkContext.defaultParallelism * 4)), "out_shard", "sid").mapInPandas(_slots(seed), "out_shard long, sid int, epoch long, blk long, take long")
    hits = parts.join(chosen, ["sid", "blk"]).select("sid", "at", "epoch", (F.col("lo") - F.col("at")).alias("lo"), (F.least(F.col("hi"), F.col("blk") * b + F.col("take")) - F.col("at")).alias("hi"))
    return placed, hits.where("hi > lo")


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    placed, pieces = mixed(docs, **options)
    taken = pieces.groupBy("sid", "at").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    # documents without words share their place with the next document
    out = placed.join(taken, (placed["sid"] == taken["sid"]) & (placed["at"] == taken["at"]) & (placed["size"] > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each document and epoch with words taken.

    A row whose words are all taken keeps the text as it is; of other rows the taken words stand, joined by one space. n_chars, if there is
    such a column, follows the text.
    """
    placed, pieces = mixed(docs, **options)
    runs = pieces.groupBy("sid", "at", "epoch").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_runs"), F.sum(F.col("hi") - F.col("lo")).alias("_got"))
    rows = placed.where("size > 0").join(runs, ["sid", "at"]).select(*(F.col(k).alias(f"_k_{k}") for k in KEY), "_runs", "_got")
    numbered = docs.select("*", *(c.alias(f"_{k}") for k, c in _keys().items()))
    numbered = numbered.withColumn("_twin", F.row_number().over(Window.partitionBy("_doc_id", "_source", "_size", "_crc").orderBy("_size")))
    same = [numbered[f"_{k}"].eqNullSafe(rows[f"_k_{k}"]) for k in KEY]
    j = numbered.join(rows, on=same, how="inner")
    words = words_of(F.col("text"))
    cut = F.array_join(F.flatten(F.transform("_runs", lambda x: F.slice(words, (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int")))), " ")
    columns = {c: F.col(c) for c in docs.columns} | {"text": F.when(F.col("_got") == F.col("_size"), F.col("text")).otherwise(cut)}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(columns["text"]).cast("long")
    return j.select(*(v.alias(c) for c, v in columns.items()))
