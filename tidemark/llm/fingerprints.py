"""Document fingerprints by consistent weighted sampling, in DataFrame code alone.

The terms of a text are its words, weighted by how often they occur. Each of `samples` samplers draws, from hashes of the term, two
Gamma(2, 1) variables r and c and a uniform b; a term of weight S has t = floor(ln S / r + b) and ln a = ln c - r (t - b) - r. The sampler
keeps (term, t) of the smallest a. Two texts keep the same pair with a chance equal to the generalised Jaccard similarity of their
weighted terms. A term's position and pair share one 64-bit number (31 bits of ln a above 32 bits of the pair), so that a sampler is one `min`.

Documents are dealt into ranges of doc_id (quantiles, then even steps); one exchange by range serves the look at the next document, the
counts and the samplers. The first document of a range is also sent to the range before it (of the first range: to the last), so no range
needs another.

Defined results: null text is the empty text; a text without words has the fingerprint '' and is like another such text (1) and unlike
all others (0); null doc_id sorts first; rows with one doc_id are ordered by text; a single document is its own next one; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_of, words_of

LOW32 = 0xFFFFFFFF


def _ranges(docs: DataFrame, per: int) -> tuple[Column, int] | None:
    """(range of doc_id, number of ranges): one of nulls, then 64 quantiles, each cut in even steps to about `per` documents."""
    n, lo, hi, q = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / 64 for i in range(1, 64)], 1000)).first()
    if not n:
        return None
    if lo is None:
        return F.lit(0).cast("long"), 1
    edges = sorted({lo, *q}) + [hi + 1]
    steps = max(1, -(-n // (per * (len(edges) - 1))))

    def find(a: int, b: int) -> Column:
        if b - a == 1:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(F.col("doc_id") < F.lit(edges[m]), find(a, m)).otherwise(find(m, b))

    k = find(0, len(edges) - 1)
    # in double, as the span of all longs is no long
    first, width = (F.element_at(F.array(*(F.lit(float(x)) for x in v)), k + 1) for v in (edges[:-1], [y - x for x, y in zip(edges, edges[1:], strict=False)]))
    step = F.greatest(F.least(F.floor((F.col("doc_id").cast("double") - first) / width * steps), F.lit(steps - 1)), F.lit(0))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(k * steps + step + 1).cast("long"), (len(edges) - 1) * steps + 1


def _with_next(docs: DataFrame, per: int) -> DataFrame | None:
    """(rng, rn, extra, doc_id, text, next): extra marks the copies of documents of the following range."""
    found = _ranges(docs, per)
    if found is None:
        return None
    d = docs.withColumn("rng", found[0])
    firsts = d.groupBy("rng").agg(F.min("doc_id").alias("doc_id"))  # one row for each range
    last = firsts.agg(F.max("rng")).first()[0]
    # within blocks of ranges, then across blocks, so that no task orders all of them
    block = F.floor(F.col("rng") / 10_000)
    inside = F.lag("rng").over(Window.partitionBy("blk").orderBy("rng"))
    tops = firsts.groupBy(block.alias("blk")).agg(F.max("rng").alias("top"))
    tops = tops.select(F.lead("blk").over(Window.orderBy("blk")).alias("blk"), "top")  # one row for each 10,000 ranges
    firsts = firsts.withColumn("blk", block).withColumn("inside", inside).join(F.broadcast(tops), "blk", "left")
    firsts = firsts.select(F.col("doc_id").alias("first_id"), F.coalesce("inside", "top", F.lit(last)).alias("before"))
    if found[1] <= 500_000:
        firsts = F.broadcast(firsts)
    d = d.join(firsts, F.col("doc_id").eqNullSafe(F.col("first_id")), "left").drop("first_id")
    here = F.struct(F.col("rng").alias("rng"), F.lit(False).alias("extra"))
    there = F.struct(F.col("before").alias("rng"), F.lit(True).alias("extra"))
    d = d.withColumn("at", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    d = d.select("at.rng", "at.extra", "doc_id", "text").where("rng IS NOT NULL")  # as the join below infers for one side
    w = Window.partitionBy("rng").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text")
    return d.select("rng", "extra", "doc_id", "text", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("next"))


def _uniform(h: Column, part: int) -> Column:
    """21 of the 64 bits of a hash as a number inside (0, 1)."""
    return (F.shiftrightunsigned(h, 21 * part).bitwiseAND(F.lit(0x1FFFFF)).cast("double") + 0.5) / float(1 << 21)


def _sampled(c: Column, r: Column, ln_c: Column, b: Column, term: Column) -> Column:
    """The packed position and pair of a term of weight exp(c)."""
    t = F.floor(c / r + b)
    ln_a = ln_c - r * (t.cast("double") - b) - r
    pair = term.bitwiseXOR(t * F.lit(2654435761 % (1 << 31))).bitwiseAND(F.lit(LOW32))
    return F.shiftleft(F.floor((ln_a + 64.0) * float(1 << 24)).cast("long"), 32) + pair


def fingerprints(docs: DataFrame, samples: int = 32, per: int = 500) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    The edited text has its last floor(n_chars / 4) characters replaced by the first as many (or all) of the next document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    base = _with_next(docs, per)
    if base is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_chars"), *(F.lit("").alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), F.lit(0.0).alias("near_edited"), F.lit(0.0).alias("near_next"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    base = base.select("rng", "rn", "extra", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))

    both = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.when(F.col("extra"), "").otherwise(F.col("edited")).alias("t")))
    terms = base.select("rng", "rn", F.explode(both).alias("x")).select("rng", "rn", "x.v", F.explode(words_of(F.col("x.t"))).alias("w"))
    terms = terms.select("rng", "rn", F.xxhash64("w").alias("term"), "v").groupBy("rng", "rn", "term").agg(F.sum(1 - F.col("v")).alias("c0"), F.sum("v").alias("c1"))
    ln = lambda c: F.when(F.col(c) > 0, F.log(F.col(c).cast("double")))
    terms = terms.select("rng", "rn", "term", ln("c0").alias("l0"), ln("c1").alias("l1"))
    drawn = []
    for k in range(samples):
        h1, h2 = F.xxhash64("term", F.lit(2 * k)), F.xxhash64("term", F.lit(2 * k + 1))
        drawn += [(-F.log(_uniform(h1, 0) * _uniform(h1, 1))).alias(f"r{k}"), F.log(-F.log(_uniform(h2, 0) * _uniform(h2, 1))).alias(f"g{k}"), _uniform(h1, 2).alias(f"b{k}")]
    terms = terms.select("rng", "rn", "term", "l0", "l1", *drawn)
    packed = []
    for k in range(samples):
        draw = (F.col(f"r{k}"), F.col(f"g{k}"), F.col(f"b{k}"), F.col("term"))
        packed += [_sampled(F.col("l0"), *draw).alias(f"p{k}"), _sampled(F.col("l1"), *draw).alias(f"q{k}")]
    kept = terms.select("rng", "rn", *packed).groupBy("rng", "rn").agg(*(F.min(f"{c}{k}").alias(f"{c}{k}") for k in range(samples) for c in "pq"))
    ids = lambda c: F.when(F.col(f"{c}0").isNotNull(), F.array(*(F.col(f"{c}{k}").bitwiseAND(F.lit(LOW32)) for k in range(samples))))
    kept = kept.select("rng", "rn", ids("p").alias("own"), ids("q").alias("changed"))

    # both branches need the same columns, so that one exchange of the texts serves them
    info = base.select("rng", "rn", "extra", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    out = info.join(kept, ["rng", "rn"], "left")
    out = out.withColumn("after", F.lead("own").over(Window.partitionBy("rng").orderBy("rn"))).where(~F.col("extra"))

    def near(a: str, b: str) -> Column:
        same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.lit(float(samples))
        return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(same)

    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(""))
    return out.select("doc_id", "n_chars", "edited_sha256", text("own").alias("fingerprint"), text("changed").alias("edited_fingerprint"), near("own", "changed").alias("near_edited"), near("own", "after").alias("near_next"))
