"""Token ids of whole texts, written as segments of directly addressable codes (dac.py) in ascending doc_id order, and read back.

Documents are range-partitioned by doc_id and sorted; each task encodes its documents and closes a segment when it holds `segment_tokens`
ids. Spark's own writer commits the segments, one binary value each, with part and segment numbers, so a lost task is simply run again and
any file system that Spark writes will do. The position of a segment in the whole is the running sum of the parts' and segments' counts.

A text is split at ASCII white space, which this tokenizer drops and never joins across; words already seen come from a bounded cache,
the others of a batch are encoded together by the tokenizers library (see WordIds).

Defined results: null text is the empty text (only the end id); null doc_id sorts first; rows with one doc_id are ordered by text, and equal
rows each have their own place; an empty table gives no segments and no rows; other columns are ignored.
"""

from __future__ import annotations

import string
import sys
import types
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.dac import Segment, encode

PUNCTUATION = string.punctuation.encode()


class WordIds:
    """Ids of words as little-endian u32 bytes; bounded.

    A word is looked up lower-cased in ASCII (as the tokenizer's normaliser does). An unseen one is reduced to a stem without
    the run of PUNCTUATION at its end, if an ASCII letter or digit comes before that run: there the tokenizer always cuts.
    Unseen stems of letters alone are one piece each and are encoded in one call; their last ids carry the mark of a word's end.
    All others, and any whose marks don't add up, are encoded one by one.
    """

    def __init__(self, spec: str, most: int = 1_100_000, most_stems: int = 1_100_000):
        from tokenizers import Tokenizer

        self.most, self.most_stems, self.tok = most, most_stems, Tokenizer.from_str(spec)
        self.known, self.stems, self.tails = {}, {}, {}  # ids of words, of stems, and of runs of punctuation
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cuts = bool(self.ends.any())

    def ids(self, word: bytes) -> bytes:
        return np.array(self.tok.encode(word.decode(errors="replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def words(self, text: bytes) -> list[bytes]:
        """The words of a text, lower-cased beforehand unless it may hold names of special tokens, which are found before all else."""
        return (text.lower() if self.cuts and b"<|" not in text else text).split()

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.known)
        if not new:
            return
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = words
        if len(self.stems) > self.most_stems:
            self.stems.clear()
        if not self.cuts:
            self.known.update((w, self.ids(w)) for w in new)
            return
        new = list(new)
        stems = [s if len(s) < len(w) and s[-1:].isalnum() and b"<|" not in w else w for w, s in zip(new, [w.rstrip(PUNCTUATION) for w in new], strict=True)]
        odd = list(set(stems).difference(self.stems))
        plain = [s for s in odd if s.isalpha() or s.decode(errors="replace").isalpha()]
        if plain:
            got = np.array(self.tok.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[got]) + 1
            if len(stops) == len(plain) and stops[-1] == len(got):
                raw, lo = got.tobytes(), 0
                for s, hi in zip(plain, (4 * stops).tolist(), strict=True):
                    self.stems[s] = raw[lo:hi]
                    lo = hi
        for s in odd:
            if s not in self.stems:
                self.stems[s] = self.ids(s)
        for w, s in zip(new, stems, strict=True):
            if w is s:
                self.known[w] = self.stems[s]
            else:
                tail = w[len(s) :]
                if tail not in self.tails:
                    self.tails[tail] = self.ids(tail)
                self.known[w] = self.stems[s] + self.tails[tail]

    def encoded(self, words: list[bytes], end: bytes) -> bytes:
        """The ids of learned words, then end."""
        if len(words) < 2:
            return b"".join([self.known[w] for w in words]) + end
        return b"".join(itemgetter(*words)(self.known)) + end


def _kept_in_worker(key: str, make):
    """An object that a Python worker keeps for its next tasks."""
    kept = sys.modules.setdefault("_tidemark_kept", types.ModuleType("_tidemark_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def _write(spec, end_id: int, segment_tokens: int):
    schema = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = _kept_in_worker(f"words {zlib.crc32(spec.value.encode())}", lambda: WordIds(spec.value))
        part, seg = TaskContext.get().partitionId(), 0
        ids, docs, ends, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            data = encode(np.frombuffer(b"".join(ids), dtype="<u4"), docs, np.array(ends))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, seg, len(docs), held, data), schema, strict=True)], schema=schema)

        for b in batches:
            split = [(d, table.words(t or b"")) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            lo = 0
            while lo < len(split):
                hi, words, n = lo, set(), 0
                while hi < len(split) and n < 200_000:  # few enough words to stay in the cache together
                    n += len(split[hi][1])
                    words.update(split[hi][1])
                    hi += 1
                table.learn(words)
                for d, w in split[lo:hi]:
                    raw = table.encoded(w, end)
                    ids.append(raw)
                    docs.append(d)
                    held += len(raw) // 4
                    ends.append(held)
                    if held >= segment_tokens:
                        yield closed()
                        ids, docs, ends, held, seg = [], [], [], 0, seg + 1
                lo = hi
        if docs:
            yield closed()

    return run, "part int, seg int, n_docs long, n_tokens long, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, segment_tokens: int = 1 << 18) -> None:
    """Writes the segments of docs (doc_id, text) to path."""
    with open(tokenizer_file, encoding="utf-8") as f:  # on the driver; executors get the content
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    run, schema = _write(spec, end_id, segment_tokens)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ordered = slim.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seg, data in zip(*(b.column(c).to_pylist() for c in ("part", "seg", "payload")), strict=True):
                s = Segment(data)
                ids = s.all().astype("<u4")
                starts = np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
                parts = [ids[x:y] for x, y in zip(starts, s.ends, strict=True)]
                cols = [
                    pa.array(np.full(s.n_docs, part, dtype=np.int32)), pa.array(np.full(s.n_docs, seg, dtype=np.int32)), pa.array(np.arange(s.n_docs, dtype=np.int64)),
                    pa.array(s.doc_ids, mask=s.null.astype(bool)), pa.array(starts), pa.array(s.ends - starts), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                ]
                names = ["part", "seg", "pos", "doc_id", "seg_start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run, "part int, seg int, pos long, doc_id long, seg_start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the written segments."""
    segments = spark.read.parquet(path)
    counts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task that wrote
    of_part = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    of_seg = segments.select("part", "seg", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("o")).join(of_part, "part")
    run, schema = _read(with_ids)
    rows = segments.select("part", "seg", "payload").mapInArrow(run, schema).join(of_seg, ["part", "seg"])
    start = (F.col("part_start") + F.col("o") + F.col("seg_start")).cast("long")
    return rows.select("doc_id", start.alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
