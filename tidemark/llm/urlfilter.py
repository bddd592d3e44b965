"""URL filters: path templates per host in a tree, with variable segments and similar branches as wildcards, judged by labelled purity.

Each path is split into segments; digits in a segment count as one `#`, and a segment that begins with `*` gets one more, so that a plain `*`
is always a wildcard. The tree of a host grows level by level, to the deepest path:
- A segment is variable where its parent has more than `max_children` different ones and it has less than `min_share` of the
  parent's pages; variable segments become `*`.
- Of the others, a branch whose share of labelled bad pages does not differ from its siblings' (two-sided test at 1.96 standard errors, or
  fewer than two labels) joins the wildcard branch too; a branch that differs keeps its name.
- Every template's bad share is smoothed towards its parent's, the host's towards the share of all labelled pages.
A page is rejected where the smoothed bad share of its deepest template is above `threshold`.

A template whose paths all go on alike has one child, which keeps its name: such a stretch is walked in one step, in which the share
approaches that of its labels by a power. So there is one step, written to the shared folder, for each level at which paths part.

Rules (verdict, host, path) come first: a rule fits its host and all subdomains where the path starts with the rule's; the longest fitting
rule (host and path together) wins. Unless labels are given, pages that a rule blocks are labelled bad and all others good.

Everything is DataFrame code over per-template counts; a hot host is only a large count.

Defined results: a null url, or one without `://`, has an empty host and path; it fits no rule and its template is that of the empty host;
null page_id is a value like any other; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """A struct (verdict, rule) of the longest fitting rule, or null. Rules are few and become one expression."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, max_children: int = 16, min_share: float = 0.05, strength: float = 4.0, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, template, bad_share for every row of pages. labels: (page_id, bad)."""
    p = pages.select("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    if labels is None:
        p = p.withColumn("bad", F.coalesce(F.col("fit.verdict") == "block", F.lit(False)).cast("int"))
    else:
        known = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
        p = p.join(known, "page_id", "left")
    # one row for each distinct host and shape of path
    segments = F.filter(F.split(F.regexp_replace("path", r"[0-9]+", "#"), "/"), lambda s: s != "")
    p = p.withColumn("shape", F.concat_ws("/", F.transform(segments, lambda s: F.when(s.startswith("*"), F.concat(F.lit("*"), s)).otherwise(s))))
    shapes = p.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    shapes = staged(shapes, "shapes")
    labelled, bad = shapes.agg(F.sum("labelled"), F.sum("bad")).first()
    prior = (bad + 1) / (labelled + 2) if labelled else 0.0
    smooth = lambda towards: (F.sum("bad") + F.lit(strength) * towards) / (F.sum("labelled") + F.lit(strength))
    hosts = shapes.groupBy("host").agg(smooth(F.lit(prior)).alias("share"))
    rest = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/"))
    now = staged(shapes.withColumn("rest", rest).withColumn("template", F.col("host")).join(hosts, "host"), "tree")
    ended = []
    while True:
        ended.append(now.where("size(rest) = 0").select("host", "shape", "template", "share"))
        now = now.where("size(rest) > 0")
        if not now.limit(1).count():
            break
        now = staged(_branch(_stretch(now, strength), max_children, min_share, smooth), "tree")
    tree = reduce(DataFrame.union, ended)
    out = p.join(tree, ["host", "shape"])
    method = F.when(F.col("share") > threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"), "template", F.col("share").alias("bad_share"))


def _stretch(tree: DataFrame, strength: float) -> DataFrame:
    """Walks on as long as all paths of a template go on alike: the start that the first and the last of them in order have in common."""
    of = tree.groupBy("template").agg(F.min("rest").alias("one"), F.max("rest").alias("two"), F.sum("labelled").alias("tl"), F.sum("bad").alias("tb"))
    unlike = F.array_position(F.zip_with("one", "two", lambda x, y: x.eqNullSafe(y)), False)
    of = of.select("template", "tl", "tb", F.when(unlike == 0, F.size("one")).otherwise(unlike - 1).cast("int").alias("k"))
    t = tree.join(of, "template")
    own = F.col("tb") / F.col("tl")
    share = F.when(F.col("tl") > 0, own + (F.col("share") - own) * F.pow(F.lit(strength) / (F.col("tl") + F.lit(strength)), F.col("k"))).otherwise(F.col("share"))
    template = F.concat_ws("/", "template", F.slice("rest", F.lit(1), F.col("k")))
    return t.select("host", "shape", "n", "labelled", "bad", F.slice("rest", F.col("k") + 1, F.size("rest")).alias("rest"), template.alias("template"), share.alias("share"))


def _branch(tree: DataFrame, max_children: int, min_share: float, smooth) -> DataFrame:
    """Names the next branch of every path and smooths its bad share towards its parent's."""
    now = tree.withColumn("s", F.get("rest", F.lit(0)))
    kids = now.where("s IS NOT NULL").groupBy("template", "s").agg(F.sum("n").alias("kn"), F.sum("labelled").alias("kl"), F.sum("bad").alias("kb"))
    whole = kids.groupBy("template").agg(F.count(F.lit(1)).alias("c"), F.sum("kn").alias("tn"), F.sum("kl").alias("tl"), F.sum("kb").alias("tb"))
    k = kids.join(whole, "template")
    rate = F.col("tb") / F.greatest("tl", F.lit(1))
    spread = F.sqrt(rate * (1 - rate) / F.greatest("kl", F.lit(1)))
    alike = (F.col("kl") < 2) | (F.abs(F.col("kb") / F.greatest("kl", F.lit(1)) - rate) <= 1.96 * spread)
    variable = (F.col("c") > max_children) & (F.col("kn") < F.lit(min_share) * F.col("tn"))
    k = k.select("template", "s", F.when(variable | ((F.col("c") > 1) & alike), "*").otherwise(F.col("s")).alias("branch"))
    named = now.join(k, ["template", "s"], "left").withColumn("template", F.concat_ws("/", "template", "branch"))  # a null branch adds nothing
    shares = named.where("s IS NOT NULL").groupBy("template").agg(smooth(F.first("share")).alias("own"))
    named = named.join(shares, "template", "left")
    share = F.when(F.col("s").isNull(), F.col("share")).otherwise(F.col("own"))
    return named.select("host", "shape", "n", "labelled", "bad", F.slice("rest", 2, 1_000_000).alias("rest"), "template", share.alias("share"))
