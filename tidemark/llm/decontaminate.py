"""Benchmark decontamination by spaced seeds: masked word windows are hashed and joined, hits are verified along their diagonal.

Words `[^\x20\x09-\x0D]+` are lower-cased (A-Z) and lose the ASCII punctuation around them. A mask has five positions that count; the positions between them are ignored, so a
substitution there does not spoil the hit. Any stretch of at least eight equal words with at least 80 of 100 words equal holds one of the
masks, and so does an item of six to nine words with one substitution; items of five words have masks of four positions. Hashes of all
masked windows of the benchmark items are joined with those of all documents: the
items' hashes, of at most `slice_words` words at a time, are broadcast to all tasks, where a bitmap and a sorted search find the hits: a hash
join whose small side is the benchmark, in which a frequent hash is no hot key. A larger benchmark is joined in as many slices as it needs,
which partition the items, one run after the other; each writes what it found, so that no task or driver holds more than one slice. A hit fixes the diagonal (word i of the item is word i + d of
the document). Along it the stretch with the most equal words is found, of those with at least `percent` of 100 words equal; the document is
contaminated where it has `least_words` equal words, or four fifths of an item that is shorter. With a `percent` or `least_words` below
80 and 8 a stretch may hold no mask.

Defined results: null and empty texts are clean; items of one to four words are compared by all their words; an empty benchmark leaves all
clean; items with a null or repeated item_id count like any other, and of equal overlaps the smallest item_id is reported, a null one last;
repeated rows have equal results; other columns are kept by `with_leaks` and `without_leaks`, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, staged, unused
from tidemark.llm.wordhash import P, WordHashes, mix, tidy

#: Every 0-1 string with eight ones at least, and four fifths ones, holds one of these: of 20 or more signs one half is such a string again,
#: and of those with up to 19 signs all are tested.
MASKS = ("11111", "101111", "110111", "111011", "111101", "11001011")
#: One word of five may differ.
OF_FIVE = ("1111", "10111", "11011", "11101")
#: A factor for each place in a mask.
PLACES = mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(P)) | np.uint64(1)


class PlainHashes(WordHashes):
    """Hashes of words without the ASCII punctuation around them."""

    def __missing__(self, word: bytes) -> int:
        plain = word.strip(string.punctuation.encode())
        if plain and plain != word:
            h = self[plain]
            self[word] = h
            return h
        return super().__missing__(word)


def masks_of(n: int) -> tuple[str, ...]:
    """The masks for an item of n words."""
    return MASKS if n > 5 else OF_FIVE if n == 5 else ("1" * n,) if n else ()


def _masked(h: np.ndarray, mask: str) -> np.ndarray:
    m = len(h) - len(mask) + 1
    if m < 1:
        return h[:0]
    out = np.full(m, len(mask), dtype=np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out += h[j : j + m] * PLACES[j]
    return out


def build_index(items: list[tuple[int, str]]) -> dict | None:
    """Sorted seed hashes of items, with the item and place of each, and a bitmap of them."""
    hashes, words, seeds, masks = PlainHashes(), [], [], []
    for i, (_, text) in enumerate(items):
        h = hashes.of((text or "").encode(errors="replace").lower().split())
        words.append(h)
        for mask in masks_of(len(h)):
            if mask not in masks:
                masks.append(mask)
            g = _masked(h, mask)
            seeds.append(np.stack([g, np.full(len(g), i, np.uint64), np.arange(len(g), dtype=np.uint64)]))
    if not seeds or not sum(s.shape[1] for s in seeds):
        return None
    s = np.concatenate(seeds, axis=1)
    s = s[:, np.lexsort((s[2], s[1], s[0]))]
    bits = max(16, int(32 * s.shape[1]).bit_length())
    bitmap = np.zeros(1 << bits, dtype=bool)
    bitmap[s[0] >> np.uint64(64 - bits)] = True
    return {"ids": [x for x, _ in items], "words": words, "masks": masks, "h": s[0], "item": s[1].astype(np.int64), "at": s[2].astype(np.int64), "bitmap": bitmap, "shift": 64 - bits}


def best_stretch(same: np.ndarray, percent: int) -> tuple[int, int, int]:
    """(equal words, first, last + 1) of the stretch with the most equal words of those with at least percent of 100 words equal."""
    s = np.concatenate([[0], np.cumsum(np.where(same, 100 - percent, -percent))])
    equal = np.concatenate([[0], np.cumsum(same)])
    # a stretch from lo to hi is good where s[lo] <= s[hi], and the least lo is where the minimum so far first gets there
    first = np.searchsorted(-np.minimum.accumulate(s), -s)
    n = equal - equal[first]
    hi = int(np.argmax(n))
    lo = int(first[hi])
    if n[hi]:
        lo += int(np.argmax(same[lo:hi]))
    return int(n[hi]), lo, hi


def find_leaks(docs: list[np.ndarray], index: dict, percent: int, least_words: int) -> list[tuple | None]:
    """(item_id, equal words, words of the stretch, first word in the document, hits) of the largest overlap of each document, or None."""
    out: list[tuple | None] = [None] * len(docs)
    h = np.concatenate([np.zeros(0, np.uint64), *docs])
    ends = np.cumsum([len(d) for d in docs])
    found = []
    for mask in index["masks"]:
        g = _masked(h, mask)
        at = np.flatnonzero(index["bitmap"][g >> np.uint64(index["shift"])])
        doc = np.searchsorted(ends, at, side="right")
        inside = at + len(mask) <= ends[doc]
        at, doc = at[inside], doc[inside]
        lo, hi = np.searchsorted(index["h"], g[at]), np.searchsorted(index["h"], g[at], side="right")
        n = hi - lo
        if n.any():
            row = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(np.stack([np.repeat(doc, n), index["item"][row], np.repeat(at, n) - index["at"][row]]))
    if not found:
        return out
    hit = np.concatenate(found, axis=1)
    hits = np.bincount(hit[0], minlength=len(docs)).tolist()
    hit = hit[:, np.lexsort((hit[2], hit[1], hit[0]))]
    new = np.ones(hit.shape[1], dtype=bool)
    new[1:] = (hit[:, 1:] != hit[:, :-1]).any(axis=0)
    best: dict[int, tuple] = {}
    for doc, item, d in hit[:, new].T.tolist():
        w, own = index["words"][item], docs[doc]
        d -= int(ends[doc]) - len(own)
        lo, hi = max(0, -d), min(len(w), len(own) - d)
        equal, a, b = best_stretch(w[lo:hi] == own[lo + d : hi + d], percent)
        if equal >= min(least_words, -(-len(w) * percent // 100)):
            name = index["ids"][item]
            one = (-equal, name is None, name or 0, b - a, a + lo + d)
            best[doc] = min(best.get(doc, one), one)
    for doc, (equal, none, name, n, first) in best.items():
        out[doc] = (None if none else name, -equal, n, first, hits[doc])
    return out


def _scan(shared, percent: int, least_words: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index, hashes = shared.value, PlainHashes()
        for s in tidy(batches):
            rows, held, size = [], [], 0
            for t in s if index else ():
                held.append(hashes.of(t.encode(errors="replace").lower().split()) if isinstance(t, str) else np.zeros(0, np.uint64))
                size += len(held[-1])
                if size >= 50_000:
                    rows += find_leaks(held, index, percent, least_words)
                    held, size = [], 0
            rows += find_leaks(held, index, percent, least_words) if held else []
            out = pd.DataFrame([x or (None, 0, 0, None, 0) for x in (rows or [None] * len(s))], columns=["item_id", "n_equal", "n_overlap", "first_word", "hits"])
            yield out.astype({"item_id": "Int64", "first_word": "Int64"})

    return F.pandas_udf(run, "item_id long, n_equal long, n_overlap long, first_word long, hits long")


def _slices(benchmark: DataFrame, slice_words: int) -> Iterator[list[tuple]]:
    """The items in lists of at most `slice_words` words (or a single item), one list at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (2 * slice_words)))  # a word and its blank take two bytes at least
    if n > 1:
        items = staged(items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "items")
    for i in range(n):
        part = items.where(F.col("slice") == i) if n > 1 else items
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").select("item_id", "text").collect()]


def with_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, least_words: int = 8, slice_words: int = 2_000_000, name: str = "leak") -> DataFrame:
    """docs with a struct of item_id, n_equal, n_overlap, first_word, hits, in place of a column called `name`; n_equal is 0 for clean documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    best, now = unused("_best", docs.columns), unused("_now", docs.columns)
    out, shared = docs, None
    for items in _slices(benchmark, slice_words):
        if shared is not None:  # one slice in a plan
            out = staged(out, "leaks")
            shared.unpersist()
        first, shared = shared is None, spark.sparkContext.broadcast(build_index(items))
        found = _scan(shared, percent, least_words)("text")
        if first:
            out = out.withColumn(best, found)
            continue
        same = (F.col(f"{now}.n_equal") > 0) & (F.col(f"{now}.n_equal") == F.col(f"{best}.n_equal"))
        lower = F.coalesce(F.col(f"{now}.item_id") < F.col(f"{best}.item_id"), F.col(f"{now}.item_id").isNotNull())
        better = (F.col(f"{now}.n_equal") > F.col(f"{best}.n_equal")) | (same & lower)
        out = out.withColumn(now, found).withColumn(best, F.when(better, F.col(now)).otherwise(F.col(best))).drop(now)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()), F.col(best).alias(name))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, item_id, n_equal, n_overlap, first_word, hits for every row of docs."""
    out = with_leaks(docs.select("doc_id", "text"), benchmark, **options)
    return out.select("doc_id", (F.col("leak.n_equal") > 0).alias("contaminated"), "leak.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    name = unused("leak", docs.columns)
    return with_leaks(docs, benchmark, name=name, **options).where(F.col(f"{name}.n_equal") == 0).drop(name)
