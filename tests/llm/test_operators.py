"""Each corpus operator on odd rows and on the smallest tables, against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers as H
from tidemark.llm import queries as Q


def docs_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


# 1 fingerprints


def check_fingerprints(got, docs, bias=0.03):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    want, near = Counter(), defaultdict(list)
    for i, (d, t) in enumerate(docs):
        t, nxt = t or "", docs[(i + 1) % len(docs)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        want[(d, len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
        near[d].append((H.jaccard(t, edited), H.jaccard(t, nxt)))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    single = [r for r in got if len(near[r.doc_id]) == 1]
    off = [r.near_edited - near[r.doc_id][0][0] for r in single] + [r.near_next - near[r.doc_id][0][1] for r in single]
    assert not off or (abs(np.mean(off)) < bias and max(map(abs, off)) < 0.45)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_fingerprints(spark, sf):
    check_fingerprints(Q.op1_fingerprints(spark, sf).collect(), docs_of(spark, sf))


def test_fingerprints_odd(spark):
    from tidemark.llm.fingerprints import fingerprints

    rows = H.odd_rows()
    got = fingerprints(H.odd_docs(spark), per=4).collect()
    check_fingerprints(got, [(r[0], r[1]) for r in rows], bias=0.15)
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.fingerprint)
    assert by_id[0] == by_id[1] and len(by_id[13]) == 1 and by_id[4] == by_id[5] == by_id[6] == {""}
    assert fingerprints(H.empty_docs(spark)).count() == 0


def test_fingerprints_at_the_ends_of_long(spark):
    from tidemark.llm.fingerprints import fingerprints

    docs = [(d, H.passage(90 + i, 30)) for i, d in enumerate((-(2**63), -(2**63) + 1, -5, 0, 7, 2**62, 2**63 - 1, None))]
    for rows, per in ((docs, 1), (docs[:1], 500), ([(None, t) for _, t in docs], 500)):
        check_fingerprints(fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), per=per).collect(), rows, bias=0.2)


def test_fingerprints_are_native(spark, sf):
    plan = Q.op1_fingerprints(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# 2 licenses


def test_license_scan_finds_lines_and_inherits(spark):
    from tidemark.llm.licenses import scan

    mit, noise = "Released under the MIT License.", H.passage(1, 40)
    rows = [
        ("a", "p/LICENSE", mit), ("b", "p/x/y/f.txt", noise), ("c", "p/x/LICENSE.md", "Licensed under the Apache License, Version 2.0."), ("d", "p/x/y/own.txt", f"{noise}\nLicensed under CC BY-NC 4.0.\n{noise}"),
        ("e", "q/f.txt", noise), ("f", "q/g.txt", None), ("g", None, mit), ("h", "px/f.txt", noise), ("i", "p/f.txt", ""), (None, "p/n.txt", mit),
    ]
    got = {r.id: (r.license, r.license_from, r.directory) for r in scan(spark.createDataFrame(rows, "id string, path string, text string")).collect()}
    assert got == {
        "a": ("MIT", "own", None), "b": ("Apache-2.0", "directory", "p/x"), "c": ("Apache-2.0", "own", None), "d": ("CC-BY-NC-4.0", "own", None), "e": (None, None, None), "f": (None, None, None),
        "g": ("MIT", "own", None), "h": (None, None, None), "i": ("MIT", "directory", "p"), None: ("MIT", "directory", "p"),
    }
    assert scan(spark.createDataFrame([], "id string, path string, text string")).count() == 0


def best_licenses(texts, least=0.6):
    """{id: (license, score) or None}: every line, paragraph and whole text against every template."""
    import math
    import re

    from tidemark.llm.licenses import TEMPLATES

    tok = lambda s: Counter(re.findall("[a-z0-9]+", s.lower()))
    lines = [set(tok(x)) for t in texts.values() for x in re.split("\r\n|\r|\n", t)]
    count = Counter(t for x in lines for t in x)
    vocab = {t for _, text in TEMPLATES for t in tok(text)}
    idf = lambda t: math.log((1 + len(lines)) / (1 + (count[t] if t in vocab else 0))) + 1e-9
    vec = lambda s: {t: n * idf(t) for t, n in tok(s).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(name, vec(text)) for name, text in TEMPLATES]
    out = {}
    for k, t in texts.items():
        found = []
        split, held = re.split("\r\n|\r|\n", t), []
        paragraphs = []
        for x in [*split, ""]:
            if tok(x):
                held.append(x)
            elif held:
                paragraphs.append(" ".join(held))
                held = []
        for unit in {*split, *paragraphs, t}:
            a = vec(unit)
            for name, v in known if a else ():
                c = round(sum(w * v.get(x, 0) for x, w in a.items()) / (norm(a) * norm(v)), 9)
                if c >= least:
                    found.append((-c, name))
        out[k] = min(found, default=None)
    return out


def check_licenses(got, texts):
    for k, best in best_licenses(texts).items():
        license_, score = got[k]
        assert (license_ is None) == (best is None)
        if best:
            assert abs(score + best[0]) < 1e-6 and (license_ == best[1] or abs(score + best[0]) < 1e-8)


def test_licenses_of_headers_and_files(spark):
    """Wrapped headers in comment marks, licence files and lines, by hand."""
    import re

    from tidemark.llm.licenses import TEMPLATES, scan

    full = {n: max((t for m, t in TEMPLATES if m == n), key=len) for n, _ in TEMPLATES}
    wrap = lambda t, mark: "\n".join(mark + " " + x for x in re.findall(r"(?:\S+\s*){1,9}", t))
    mit = re.sub(r"(The above copyright notice|THE SOFTWARE IS)", r"\n\n\1", full["MIT"])
    texts = {
        1: "Released under the MIT License.\nplain words here", 2: "we work under the mit license of old", 3: "GNU General Public License version 3 or any later one", 4: "nothing at all", 5: f"MIT License\n\nCopyright (c) 2020 Some One\n\n{mit}",
        6: "/*\n" + wrap(full["GPL-3.0"], " *") + "\n */\n\nint main(void) { return 0; }\n" * 5, 7: "# Copyright 2019 Us\r\n#\r\n" + wrap(full["BSD-3-Clause"], "#").replace("\n", "\r\n") + "\r\n\r\nimport os", 8: "", 9: "\n\n", 10: wrap(full["ISC"], "//") + "\n\ncode",
        11: "x " * 30_000 + "\n\n" + wrap(full["AGPL-3.0"], ""),
    }
    got = {r.id: (r.own_license, r.own_score) for r in scan(spark.createDataFrame([(k, f"d/{k}", v) for k, v in texts.items()], "id int, path string, text string")).collect()}
    check_licenses(got, texts)
    assert {k: got[k][0] for k in (5, 6, 7, 10, 11)} == {5: "MIT", 6: "GPL-3.0", 7: "BSD-3-Clause", 10: "ISC", 11: "AGPL-3.0"}


def test_license_scan_scores_equal_units_once(spark, monkeypatch):
    """300 files with one notice and a line of their own: the notice is one vector, each file another."""
    from tidemark.llm import licenses

    kept, staged = {}, licenses.staged
    monkeypatch.setattr(licenses, "staged", lambda df, name: kept.setdefault(name, staged(df, name)))
    rows = [(i, f"d/{i}", f"Released under the MIT License.\nfile {i % 5}") for i in range(300)] + [(None, None, "Released under the MIT License.")]
    got = licenses.scan(spark.createDataFrame(rows, "id int, path string, text string")).select("id", "own_license").collect()
    assert sorted(r.id for r in got if r.own_license == "MIT") == list(range(300)) and len(got) == 301
    assert kept["vectors"].count() == 1 + 5


def test_license_scan_scores_units_in_their_rows(spark, monkeypatch):
    """200 unlike files share one notice, so that each whole text is scored: no join or explode makes rows of their tokens. Compared with brute force."""
    import random

    from tidemark.llm import licenses

    plans, staged = {}, licenses.staged

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, name)

    monkeypatch.setattr(licenses, "staged", seen)
    rng = random.Random(7)
    known = sorted({w for _, text in licenses.TEMPLATES for w in text.split()})
    texts = {}
    for i in range(200):
        lines = [" ".join(rng.choices(known, k=rng.randint(1, 9)) * rng.randint(1, 3)) for _ in range(3)]
        part = rng.choice(licenses.TEMPLATES)[1].split()
        texts[i] = "\n".join(["Released under the MIT License.", "", *lines, "", " ".join(part[: rng.randint(1, len(part))]), "", f"{'0 ' * (i % 3)} zzz zzz file{i} {known[0]} {known[-1]}"][i % 2 * 2 :])
    texts |= {200: "0", 201: "zzz", 202: "MIT", 203: "mit Mit MIT license license", 204: "YOU yours", 205: "\u00e9 zlib \u2126 License"}
    found = licenses.scan(spark.createDataFrame([(k, f"d{k}/f", v) for k, v in texts.items()], "id int, path string, text string"))
    got = {r.id: (r.own_license, r.own_score) for r in found.collect()}
    check_licenses(got, texts)
    assert sum(x is None for x, _ in got.values()) > 3 and len({x for x, _ in got.values()}) > 8
    assert not any(x in plans["vectors"] for x in ("Join", "Generate")) and "token" not in "".join(x for x in plans["licenses"].splitlines() if "Join" in x)


def test_license_scan_on_tables(spark, sf):
    q = Q.op2_license_scan(spark, sf)
    assert not any(x in q._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))
    rows = {r.doc_id: r for r in q.collect()}
    texts = {d: t or "" for d, t in docs_of(spark, sf)}
    check_licenses({d: (r.own_license, r.own_score) for d, r in rows.items()}, texts)
    assert any(r.own_license for r in rows.values())
    declared = {}
    for r in rows.values():
        if r.own_license and r.path.rsplit("/", 1)[1].startswith("LICENSE"):
            declared.setdefault(r.path.rsplit("/", 1)[0], []).append((-r.own_score, r.own_license))
    for r in rows.values():
        folder, above = r.path.rsplit("/", 1)[0], None
        while folder and above is None:
            above = (folder, min(declared[folder])[1]) if folder in declared else None
            folder = folder.rpartition("/")[0]
        if r.own_license:
            assert (r.license, r.license_from, r.directory) == (r.own_license, "own", None)
        else:
            assert (r.license, r.license_from, r.directory) == ((above[1], "directory", above[0]) if above else (None, None, None))


# 3 mixing


def check_mix(got, rows, spread=1):
    sizes = defaultdict(int)
    for d, t, s in rows:
        sizes[s] += len(H.words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    from tidemark.llm.mixing import targets

    want = dict(zip(order, targets([sizes[s] for s in order]), strict=True))
    assert Counter((r.doc_id, r["size"], r.source_size) for r in got) == Counter((d, len(H.words(t)), sizes[s]) for d, t, s in rows)
    taken = defaultdict(int)
    for r in got:
        taken[r.source_size, round(r.target, 6)] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    total = defaultdict(float)
    for s in order:
        total[sizes[s], round(float(want[s]), 6)] += float(want[s])
    for k, v in total.items():
        assert abs(taken[k] - v) <= 1.0 * sum(1 for s in order if sizes[s] == k[0])


def test_targets():
    from tidemark.llm.mixing import targets

    assert targets([10, 10, 10]) == [5, 10, 15]
    assert targets([100, 1, 1]) == [96, 3, 3]
    assert targets([]) == [] and targets([0, 5]) == [0, 5]
    assert targets([1, 1, 1, 97]) == [3, 3, 3, 91]


def test_mix(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = Q.op3_mixing(spark, sf).collect()
    check_mix(got, rows)
    again = Q.op3_mixing(spark, sf).collect()
    assert Counter(got) == Counter(again)


def test_mix_takes_each_word_once_an_epoch(spark, sf):
    """Targets by bisection; every document is taken whole in each full epoch, and in part or not at all in the last."""
    from tidemark.llm.mixing import mix_documents

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(H.words(r.text))
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: (1, 2, 3)[i % 3] for i, x in enumerate(order)}
    lo, hi = 0.0, 3.0 * sum(sizes.values())
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * n, mid * weight[x]) for x, n in sizes.items()) < sum(sizes.values()) else (lo, mid)
    target = {x: min(3 * n, hi * weight[x]) for x, n in sizes.items()}
    got = {r.doc_id: r for r in Q.op3_mixing(spark, sf).collect()}
    said = defaultdict(int)
    for r in rows:
        g = got[r.doc_id]
        assert abs(g.target - target[r.source]) < 1e-3 and g.source_size == sizes[r.source]
        epochs = int((target[r.source] + 0.5) // sizes[r.source]) if sizes[r.source] else 0
        assert epochs * g["size"] <= g.taken <= (epochs + 1) * g["size"]
        said[r.source] += g.taken
    assert all(abs(said[x] - target[x]) <= 0.51 for x in order)
    text, mixed_words = {r.doc_id: H.words(r.text) for r in rows}, defaultdict(Counter)
    for r in mix_documents(docs).collect():
        w, at = H.words(r.text), iter(text[r.doc_id])
        assert w and all(x in at for x in w)  # words of the document in its order
        mixed_words[r.doc_id].update(w)
    for d, w in text.items():
        low, whole = got[d].taken // len(w) if w else 0, Counter(w)
        assert sum(mixed_words[d].values()) == got[d].taken
        assert all(low * n <= mixed_words[d][x] <= (low + 1) * n for x, n in whole.items())


def test_mix_odd(spark):
    from tidemark.llm.mixing import mix_counts, mix_documents

    rows = [(r[0], r[1], r[3]) for r in H.odd_rows()]
    for block in (4, 512):
        check_mix(mix_counts(H.odd_docs(spark), block=block, shard_slots=8).collect(), rows)
        out = mix_documents(H.odd_docs(spark), block=block)
        assert out.columns == H.odd_docs(spark).columns
        assert sum(len(H.words(r.text)) for r in out.collect()) == mix_counts(H.odd_docs(spark), block=block).agg(F.sum("taken")).first()[0]
    assert mix_counts(H.empty_docs(spark)).count() == 0 and mix_documents(H.empty_docs(spark)).count() == 0
    nothing = H.odd_docs(spark).where("text IS NULL OR text = ''")
    assert {r.taken for r in mix_counts(nothing).collect()} == {0}


def test_mix_broadcasts_only_what_is_small(spark, sf):
    """The joins of slots and of documents have no hint: above Spark's size limit they shuffle, with the same rows."""
    from tidemark.llm.mixing import mix_counts

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    usual = Counter(mix_counts(docs).collect())
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k in limits:
            spark.conf.set(k, "1")
        out = mix_counts(docs)
        assert Counter(out.collect()) == usual
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "NestedLoop" not in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_permutation_is_one():
    from tidemark.llm.mixing import permute

    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(permute(np.arange(n), n, 99).tolist()) == list(range(n))
    assert permute(np.arange(1000), 1000, 1).tolist() != permute(np.arange(1000), 1000, 2).tolist()


# 4 near duplicates


def test_near_duplicates(spark, sf):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in Q.op4_near_duplicates(spark, sf).collect()}
    docs = docs_of(spark, sf)
    groups = H.near_groups(docs, 2)
    assert got == {d: (len(H.shingles(t, 2)), groups[d], groups[d] == d) for d, t in docs}


def family(n, base=60):
    """A hot group: copies of one text with a few random words, some pairs above and some below the threshold; and a shared passage."""
    rng = np.random.default_rng(1)
    out, shared = [], H.passage(40, 20)
    for i in range(n):
        w = H.passage(30, base).split()
        for at in rng.choice(base, int(rng.integers(0, 9)), replace=False):
            w[at] = f"r{rng.integers(0, 40)}"
        out.append((i, " ".join(w)))
    return out + [(n + i, f"{H.passage(100 + i, 30)} {shared}") for i in range(n // 2)]


@pytest.mark.parametrize("options", [{}, {"rounds": 1, "short": 2, "block": 2000}, {"rounds": 2, "short": 2, "block": 40}, {"rounds": 1, "short": 10_000}])
def test_near_duplicates_in_a_hot_group(spark, options):
    from tidemark.llm.neardup import near_duplicates

    docs = family(120)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), n_words=2, **options).collect()}
    assert got == H.near_groups(docs, 2)


def test_near_duplicates_odd(spark):
    from tidemark.llm.neardup import keep_representatives, near_duplicates

    rows = [(r[0], r[1]) for r in H.odd_rows() if r[0] is not None]
    for n in (2, 5):
        got = near_duplicates(H.odd_docs(spark), n_words=n).where("doc_id IS NOT NULL").collect()
        groups = H.near_groups(rows, n)
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter((d, len(H.shingles(t, n)), groups[d], groups[d] == d) for d, t in rows)
    nulls = near_duplicates(H.odd_docs(spark)).where("doc_id IS NULL").collect()
    assert len(nulls) == 2 and all(r.kept for r in nulls)
    kept = keep_representatives(H.odd_docs(spark))
    assert kept.columns == H.odd_docs(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({d: 1 for d in H.near_groups(rows, 5) if H.near_groups(rows, 5)[d] == d} | {None: 2})
    assert near_duplicates(H.empty_docs(spark)).count() == 0 and keep_representatives(H.empty_docs(spark)).count() == 0


def test_near_duplicates_through_texts_without_id(spark):
    """A and B are linked through a text without an id only; two texts without an id make a group of their own; one id has two texts."""
    from tidemark.llm.neardup import keep_representatives, near_duplicates

    w = [f"w{i}" for i in range(17)]
    a, n, b = " ".join(w[:16]), " ".join(w[1:17]), " ".join([*w[2:17], "z0"])
    sets = [H.shingles(t, 2) for t in (a, n, b)]
    assert [100 * len(x & y) >= 80 * len(x | y) for x, y in ((sets[0], sets[1]), (sets[1], sets[2]), (sets[0], sets[2]))] == [True, True, False]
    own = [" ".join(f"u{i}" for i in range(lo, lo + 30)) for lo in (0, 1)]
    two = [H.passage(80, 30), H.passage(81, 30)]
    for shift in (0, -5):
        rows = [(1 + shift, a), (None, n), (3 + shift, b), (None, own[0]), (None, own[1]), (None, own[1]), (None, " "), (None, None), (9, two[0]), (9, two[1]), (8, two[1]), (10, two[0])]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = Counter((r.doc_id, r.component_id) for r in near_duplicates(df, n_words=2).collect())
        assert got == Counter([(1 + shift, 1 + shift), (None, 1 + shift), (3 + shift, 1 + shift), *[(None, None)] * 5, (9, 8), (9, 8), (8, 8), (10, 8)])
        kept = keep_representatives(df.withColumn("node", F.lit(0)), n_words=2).collect()
        assert Counter(r.doc_id for r in kept) == Counter({1 + shift: 1, 8: 1, None: 3})
        assert sum(r.text in own for r in kept) == 1


def test_small_sets_always_share_a_run(spark):
    """Sets of 4 to 30 values at exactly the threshold are never missed."""
    from tidemark.llm.neardup import near_duplicates

    docs, i = [], 0
    for n in range(4, 31):
        w = [f"w{n}x{k}" for k in range(n + 1)]
        cut = max(k for k in range(n) if 100 * (n - k) >= 80 * n)
        for _ in range(2):
            docs.append((i, " ".join(w[: len(w) - cut * (i % 2)])))
            i += 1
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), n_words=2).collect()}
    assert got == H.near_groups(docs, 2)


def test_components(spark):
    from tidemark.llm.components import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5 language


def test_language(spark, sf):
    got = Q.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.n_chars > 50]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in held) <= 0.02 * len(held)


def test_language_odd(spark):
    from tidemark.llm.language import fit, predict_language

    got = predict_language(H.odd_docs(spark)).collect()
    assert len(got) == len(H.odd_rows())
    for r, text in ((r, t) for r in got for d, t in [(x[0], x[1]) for x in H.odd_rows()] if d == r.doc_id and d not in (None, 13)):
        has = any(c.isalpha() for c in text or "")
        assert (r.lang_pred in ("en", "fr")) == has and (r.score > 0) == has
    assert predict_language(H.empty_docs(spark)).count() == 0 and fit(H.empty_docs(spark)) is None
    none = predict_language(H.odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in none} == {("und", 0.0, True)}


def test_language_learns_long_texts_too(spark):
    """No language is lost for the length of its texts, and none for the number of languages beyond the bound but the rarest."""
    from tidemark.llm.language import fit, predict_language, without_rejected

    say = {"en": "the cat and the dog sat by the house ", "de": "der hund und die katze schliefen unter dem tisch "}
    rows = [(i, say[x] * (3 if x == "en" else 900), x) for i, x in enumerate(["en", "de"] * 60)] + [(1000, "un chat", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert fit(df)["langs"] == ["de", "en", "fr"] and fit(df, max_langs=2)["langs"] == ["de", "en"]
    got = predict_language(df).where("doc_id < 1000").collect()
    assert all(r.lang_pred == ("de" if r.doc_id % 2 else "en") for r in got)
    clash = df.withColumn("lang_id", F.lit(7))
    kept = without_rejected(clash)
    assert kept.columns == clash.columns and {r.lang_id for r in kept.collect()} == {7}


def test_language_scores_by_hand(spark, sf):
    """Predictions over whole texts, gram by gram, from the model's numbers alone."""
    from tidemark.llm.language import fit, gram_ids, normal, predict_language

    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(d)
    got = {r.doc_id: r for r in predict_language(d).collect()}
    for doc, text in docs_of(spark, sf)[:60]:
        if not any(map(str.isalpha, text or "")):
            assert got[doc].lang_pred == "und" and got[doc].rejected
            continue
        ids = gram_ids(normal(text), len(model["table"]))[1]
        z = (model["table"][ids].astype(float).mean(0) + model["bias"]) / model["temperature"]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        least = p.max() < model["least"] or model["seen"][ids].mean() < model["usual"]
        assert got[doc].lang_pred == model["langs"][int(p.argmax())] and abs(got[doc].score - p.max()) < 1e-3
        assert got[doc].rejected == least or abs(p.max() - model["least"]) < 1e-3


def test_language_learns_only_from_its_fold(spark, sf):
    from tidemark.llm.language import fit, held_out

    d = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = fit(d), fit(d.withColumn("lang", F.when(held_out(), "xx").otherwise(F.col("lang"))))
    assert a["langs"] == b["langs"] and np.array_equal(a["table"], b["table"])


UNLEARNED = (
    "Wczoraj wieczorem poszliśmy nad rzekę, żeby zobaczyć zachód słońca. Było bardzo zimno.", "Eilen illalla menimme joelle katsomaan auringonlaskua. Oli todella kylmä.",
    "Вчера вечером мы пошли к реке, чтобы посмотреть закат. Было очень холодно.", "昨天晚上我们去河边看日落。天气很冷。", "Χθες το βράδυ πήγαμε στο ποτάμι για να δούμε το ηλιοβασίλεμα.",
    "Dün akşam gün batımını izlemek için nehre gittik. Hava çok soğuktu.", "asdf qwer zxcv jkl; wqeoiru zmxncb qpwoei alskdj fghvbn",
)


def test_unlearned_languages_are_rejected(spark, sf):
    from tidemark.llm.language import predict_language

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    new = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(UNLEARNED)], "doc_id long, text string, lang string")
    got = predict_language(docs.unionByName(new)).collect()
    assert {r.doc_id: r.rejected for r in got if r.doc_id < 0} == {-1 - i: True for i in range(len(UNLEARNED))}
    held = [r for r in got if r.held_out and r.doc_id >= 0]
    assert len(held) > 40 and sum(r.rejected for r in held) <= 0.02 * len(held)


# 6 substrings


def check_removed(got, docs):
    want = Counter((d, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for d, n, kept in H.removed_words(docs))
    assert Counter(tuple(r) for r in got) == want


def test_anchor_size_counts_passages_that_chunks_found():
    """Closed windows (found within a chunk, passed on there) fill the anchor's shard as open ones do."""
    import numpy as np
    import pyarrow as pa

    from tidemark.llm.passages import PACK, _candidates

    n = 20
    hashes = [np.array([2 * i, 2 * i + 1], dtype=np.uint32).tobytes() for i in range(n)]
    cols = [[7] * n, list(range(n)), [0] * n, [False] * n, [0] * n, [1] * n, hashes]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PACK, strict=True)], schema=PACK)
    for shard_words, large in ((n * 36 - 1, [7]), (n * 36, [])):
        run, _ = _candidates(35, 2_000_000, shard_words)
        found = [r for b in run(iter([batch])) for r in b.to_pylist()]
        assert [r["anchor"] for r in found if r["first"] == -1] == large and all(r["first"] == -1 for r in found)


def test_substrings(spark, sf):
    check_removed(Q.op6_substring_dedup(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), docs_of(spark, sf))


def test_substrings_odd(spark):
    from tidemark.llm.passages import without_passages

    out = without_passages(H.odd_docs(spark)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
    check_removed(out.collect(), [(r[0], r[1]) for r in H.odd_rows()])
    assert without_passages(H.empty_docs(spark)).count() == 0
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"v{x}" for x in rng.integers(0, 3, int(rng.integers(5, 90))))) for i in range(150)]
    for window, gram in ((8, 3), (9, 2)):
        got = without_passages(spark.createDataFrame(docs, "doc_id long, text string"), window=window, gram=gram, shard_words=500)
        want = {d: b" ".join(kept).decode() for d, _, kept in H.removed_words(docs, window)}
        assert {r.doc_id: r.kept for r in got.collect()} == want


HALF_ALIKE = ("z1008", "z595464")


def test_candidates_that_only_hashes_make_are_kept(spark):
    """Windows with one anchor that agree in the 32 bits that travel are candidates; the automata find each in one place only."""
    from tidemark.llm.passages import without_passages
    from tidemark.llm.wordhash import WordHashes, windows

    docs = [(i, f"{H.passage(60, 34)} {last}") for i, last in enumerate(HALF_ALIKE)]
    a, b = (int(windows(WordHashes().of(H.words(t)), 35)[0]) for _, t in docs)
    assert a != b and a >> 32 == b >> 32
    for parts in (1, 2):
        got = without_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts, "doc_id")).collect()
        assert {r.doc_id: r.kept for r in got} == dict(docs)


def random_texts(n, size, shared, seed=5):
    rng = np.random.default_rng(seed)
    return [(i, " ".join([*(f"a{x}" for x in rng.integers(0, 1 << 40, size)), shared, *(f"b{x}" for x in rng.integers(0, 1 << 40, size))])) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"most": 500, "shard_words": 300}])
def test_texts_around_one_phrase_lose_nothing(spark, options):
    """20,000 texts share six words and no window; then a few of them are there twice in part."""
    from tidemark.llm.passages import without_passages

    docs = random_texts(20_000 if not options else 2_000, 40, "one two three four five six")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id")
    assert without_passages(df, **options).agg(F.sum("n_removed")).first()[0] == 0
    some = docs[:300] + [(10_000_000 + d, "new start " + " ".join(t.split()[20 : 40 + d % 40]) + f" end{d}") for d, t in docs[:60]]
    got = without_passages(spark.createDataFrame(some, "doc_id long, text string").repartition(3, "doc_id"), **options).collect()
    assert {r.doc_id: r.kept for r in got} == {d: b" ".join(kept).decode() for d, _, kept in H.removed_words(some)}
    assert sum(r.n_removed for r in got) > 1000


def test_automata_decide(monkeypatch):
    """What the automata don't find stays; branching passages, each in one place only, give up the windows that they share."""
    from tidemark.llm import passages

    x, u, w, y, v = (H.passage(k, 12).split() for k in (70, 71, 72, 73, 74))
    texts = [[t.encode() for t in words] for words in (x + w + y, u + w + v, x + u, y, v + v)]
    want = [[(12, 24)], [(12, 24)]]
    got = [passages._merged(s) for s in passages.recurring(texts, [1] * 5, 12)]
    assert [list(map(tuple, s)) for s in got] == [[(0, 36)], [(0, 36)], [(0, 24)], [(0, 12)], [(0, 24)]]
    got = [passages._merged(s) for s in passages.recurring(texts[:2], [1, 1], 12)]
    assert [list(map(tuple, s)) for s in got] == want
    assert passages.recurring(texts[:1], [2], 12)[0] == [(0, 36)] and passages.recurring(texts[:1], [1], 12) == [[]]
    monkeypatch.setattr(passages, "find_all", lambda *_: [])
    assert passages.recurring(texts, [1] * 5, 12) == [[]] * 5


# 7 urls


def plain_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    path = rest[end:]
    cut = min([path.index(c) for c in "?#" if c in path] + [len(path)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:cut]


def test_urls(spark):
    from tidemark.llm.urlfilter import RULES, judge

    urls = [
        "http://a.b.COM/en/1?x", "https://example.com/en/71#t", "http://www.example.com/en/8", "http://x.net/de/1", "http://example.net/de/8", "http://m.example.net/de/88/", "http://q.org/es/", "http://q.org/es",
        "http://com/en/", "http://xcom/en/", "no url", None, "x://", "http://h?q=http://z.com/en/", "http://Ä.ORG/es/1", "a\nb://y.com/en/2",
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, "http://z.net/en/", None)], "page_id long, url string, host string")
    got = {r.page_id: r for r in judge(pages).collect()}
    assert len(got) == len(urls) + 1

    for i, u in enumerate(urls):
        host, path = plain_url(u)
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[1])
        assert got[i].verdict in ("allow", "block") and (best is None or got[i].verdict == best[2])
    assert judge(pages.limit(0)).count() == 0


def test_url_templates_are_learned(spark):
    from tidemark.llm.urlfilter import judge

    rows = [(i, f"http://site.test/{'spam' if i % 2 else 'news'}/item-{i}/{i}.html") for i in range(200)]
    labels = [(i, i % 2 == 1) for i in range(0, 200, 3)]
    got = judge(spark.createDataFrame(rows, "page_id long, url string"), rules=(), labels=spark.createDataFrame(labels, "page_id long, bad boolean")).collect()
    assert {r.verdict for r in got if r.page_id % 2} == {"block"} and {r.verdict for r in got if not r.page_id % 2} == {"allow"}
    assert len({r.template for r in got}) == 2


def plain_urls(rows, labels, rules, max_children=16, min_share=0.05, strength=4.0, threshold=0.5):
    """{page_id: (rule, verdict, template, share)}, level by level as the method says."""
    import re

    from tidemark.llm.urlfilter import RULES

    pages = []
    for d, u in rows:
        host, path = plain_url(u)
        best = max([(len(h + p), h + p, v) for v, h, p in (RULES if rules is None else rules) if (host == h or host.endswith("." + h)) and path.startswith(p)], default=None)
        segs = [s if s[:1] != "*" else "*" + s for s in re.sub("[0-9]+", "#", path).split("/") if s]
        bad = (best is not None and best[2] == "block") if labels is None else labels.get(d)
        pages.append([d, host, segs, best, bad])
    known = [p[4] for p in pages if p[4] is not None]
    prior = (sum(known) + 1) / (len(known) + 2) if known else 0.0
    out = {}

    def smooth(group, towards):
        marks = [p[4] for p in group if p[4] is not None]
        return (sum(marks) + strength * towards) / (len(marks) + strength)

    def walk(group, depth, template, share):
        kids = defaultdict(list)
        for p in group:
            if len(p[2]) == depth:
                verdict = p[3][2] if p[3] else "block" if share > threshold else "allow"
                out[p[0]] = (p[3] and p[3][1], verdict, template, share)
            else:
                kids[p[2][depth]].append(p)
        every = [p for k in kids.values() for p in k]
        marks = [p[4] for p in every if p[4] is not None]
        rate = sum(marks) / max(1, len(marks))
        named = defaultdict(list)
        for s, k in kids.items():
            own = [p[4] for p in k if p[4] is not None]
            alike = len(own) < 2 or abs(sum(own) / len(own) - rate) <= 1.96 * (rate * (1 - rate) / len(own)) ** 0.5
            variable = len(kids) > max_children and len(k) < min_share * len(every)
            named["*" if variable or (len(kids) > 1 and alike) else s] += k
        for s, k in named.items():
            walk(k, depth + 1, f"{template}/{s}", smooth(k, share))

    hosts = defaultdict(list)
    for p in pages:
        hosts[p[1]].append(p)
    for host, group in hosts.items():
        walk(group, 0, host, smooth(group, prior))
    return out


def check_urls(spark, rows, labels, rules):
    from tidemark.llm.urlfilter import RULES, judge

    known = None if labels is None else spark.createDataFrame(list(labels.items()), "page_id long, bad boolean")
    got = judge(spark.createDataFrame(rows, "page_id long, url string"), rules=RULES if rules is None else rules, labels=known).collect()
    want = plain_urls(rows, labels, rules)
    assert len(got) == len(rows)
    for r in got:
        rule, verdict, template, share = want[r.page_id]
        assert (r.rule, r.template) == (rule, template) and abs(r.bad_share - share) < 1e-9
        assert r.verdict == verdict or abs(share - 0.5) < 1e-9


def test_url_trees_level_by_level(spark):
    rng = np.random.default_rng(11)
    segs = ["a", "b", "*", "**", "x1", "x22", "item-7", "c", "news", "spam"]
    rows = []
    for i in range(600):
        depth = int(rng.integers(0, 13))
        start = ["long", "way", "to", "go"] if i % 5 == 0 else []
        rows.append((i, f"http://{['h.test', 'k.org'][i % 2]}/" + "/".join(start + [segs[int(x)] for x in rng.integers(0, len(segs), depth) ** 2 // len(segs)])))
    rows += [(1000 + i, f"http://many.test/v{chr(97 + i % 26)}{chr(97 + i // 26)}/p{i}") for i in range(120)] + [(2000, "http://deep.test" + "/s" * 300), (2001, None)]
    check_urls(spark, rows, {i: bool("spam" in u or rng.random() < 0.2) for i, u in rows[:500]}, ())
    check_urls(spark, rows, None, None)


def test_url_plans_do_not_grow_with_the_depth(spark):
    from tidemark.llm.urlfilter import judge

    def nodes(depth):
        rows = [(i, "http://h.test/" + "/".join(f"{'ab'[i >> d & 1]}" for d in range(depth))) for i in range(1 << min(depth, 6))]
        return judge(spark.createDataFrame(rows, "page_id long, url string"))._jdf.queryExecution().executedPlan().toString().count("HashAggregate")

    assert nodes(6) - nodes(4) <= 2 * 4


def test_urls_on_tables(spark, sf):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    want = plain_urls(rows, None, None)
    got = Q.op7_url_filter(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.rule, r.template) == (want[r.page_id][0], want[r.page_id][2]) and (r.verdict == want[r.page_id][1] or abs(r.bad_share - 0.5) < 1e-9)


# 8 token ids


def check_tokens(got, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    want, at = Counter(), 0
    for d, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want[d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
        at += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_tokens(spark, sf):
    check_tokens(Q.op8_token_ids(spark, sf).collect(), docs_of(spark, sf))


def test_tokens_odd(spark, tmp_path):
    import public_tokenizers

    from tidemark.llm.tokens import read_tokens, write_tokens

    for name, df in (("odd", H.odd_docs(spark)), ("empty", H.empty_docs(spark))):
        path = f"file://{tmp_path}/{name}"
        write_tokens(df, path, public_tokenizers.path("word_bpe_49k.json"), segment_tokens=100)
        check_tokens(read_tokens(spark, path, with_ids=False).collect(), [(r.doc_id, r.text) for r in df.collect()])
    row = read_tokens(spark, f"file://{tmp_path}/odd").where("doc_id = 0").first()
    assert len(row.ids) == row.n_tokens and zlib.crc32(np.array(row.ids, dtype="<u4").tobytes()) == row.ids_crc32


def test_codes_give_any_id():
    from tidemark.llm.dac import Segment, encode

    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        s = Segment(encode(ids, [7, None], np.array([n // 2, n])))
        assert np.array_equal(s.all(), ids) and [s[i] for i in range(n)] == ids.tolist()
        assert s.doc_ids.tolist() == [7, 0] and s.null.tolist() == [0, 1] and s.ends.tolist() == [n // 2, n]
    with pytest.raises(IndexError):
        s[n]
    with pytest.raises(ValueError):
        Segment(b"nope")


# 9 decontamination


def leak_cases(spark):
    item = H.passage(50, 40)
    w = item.split()
    swapped = " ".join("zzz" if i % 6 == 5 else x for i, x in enumerate(w))
    half = " ".join("zzz" if i % 3 == 2 else x for i, x in enumerate(w))
    docs = [
        (1, f"{H.passage(1, 50)} {item} {H.passage(2, 50)}", True), (2, f"{H.passage(3, 20)} {swapped.upper()}", True), (3, half, False), (4, H.passage(9, 300), True), (12, H.passage(14, 300), False), (5, None, False), (6, "", False),
        (7, " ".join(w[10:22]), True), (8, " ".join(w[:6]), False), (9, f"say hi there {H.passage(12, 9)}", True), (10, "hi there", False), (11, ", ".join(w) + ".", True),
    ]
    bench = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "Say, hi there"), (0, item), (None, H.passage(9, 300))], "item_id long, text string")
    return docs, bench


@pytest.mark.parametrize("slice_words", [2_000_000, 20])
def test_leaks(spark, slice_words):
    from tidemark.llm.decontaminate import contamination, without_leaks

    docs, bench = leak_cases(spark)
    df = spark.createDataFrame([(d, t, "clash") for d, t, _ in docs], "doc_id long, text string, item_id string")
    got = {r.doc_id: r for r in contamination(df, bench, slice_words=slice_words).collect()}
    assert {d: r.contaminated for d, r in got.items()} == {d: bad for d, _, bad in docs}
    assert got[1].item_id == 0 and got[1].n_equal == 40 and got[1].first_word == 50 and got[9].item_id == 3
    assert got[4].item_id is None and got[4].n_equal == 300
    clash = df.withColumn("leak", F.lit("mine")).withColumn("_leak0", F.lit("too"))
    rows = without_leaks(clash, bench, slice_words=slice_words)
    assert rows.columns == clash.columns and {(r.leak, r._leak0) for r in rows.collect()} == {("mine", "too")}
    kept = without_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _, bad in docs if not bad}
    assert contamination(df.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in contamination(df, bench.limit(0)).collect())


def test_leaks_with_substitutions():
    """Whatever words are substituted: found exactly where enough of a stretch is equal, and with its most equal words."""
    from itertools import combinations

    from tidemark.llm.decontaminate import MASKS, build_index, find_leaks
    from tidemark.llm.wordhash import WordHashes

    hashes = WordHashes()

    def most(same, percent=80):
        cut = [same[a:b] for a in range(len(same)) for b in range(a + 1, len(same) + 1)]
        return max((sum(c) for c in cut if 100 * sum(c) >= percent * len(c)), default=0)

    for n in (5, 6, 7, 8, 9, 10, 12, 15, 20):
        item = [f"i{k}" for k in range(n)]
        index = build_index([(7, " ".join(item))])
        gone = [set(c) for m in range(min(n // 5 + 2, 4)) for c in combinations(range(n), m)]
        gone += [set(range(k, n, 5)) for k in range(5)]
        docs = [hashes.of([b"a", b"b", *(b"x" if i in g else w.encode() for i, w in enumerate(item)), b"c"]) for g in gone]
        for g, got in zip(gone, find_leaks(docs, index, 80, 8), strict=True):
            equal = most([i not in g for i in range(n)])
            assert (got and got[1]) == (equal if equal >= min(8, -(-4 * n // 5)) else None), (n, g)
    for n in range(8, 20):
        for g in (g for m in range(n // 5 + 1) for g in combinations(range(n), m) if n - m >= 8):
            ones = {i for i in range(n) if i not in g}
            assert any({i + k for i, c in enumerate(mask) if c == "1"} <= ones for mask in MASKS for k in range(n - len(mask) + 1))


def best_overlap(item, doc, percent=80):
    """The most equal words of a stretch of any diagonal with at least percent of 100 words equal, by looking at every diagonal."""
    best = 0
    for d in range(-len(item) + 1, len(doc)):
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        same = item[lo:hi] == doc[lo + d : hi + d]
        if same.sum() <= best:
            continue
        s = np.concatenate([[0], np.cumsum(np.where(same, 100 - percent, -percent))])
        ones = np.concatenate([[0], np.cumsum(same)])
        good = s[:, None] <= s[None, :]
        gain = np.where(np.triu(good), ones[None, :] - ones[:, None], 0)
        best = max(best, int(gain.max()))
    return best


def test_leaks_on_tables(spark, sf):
    """Contaminated documents are those whose best overlap on any diagonal is large enough, and no others."""
    import string

    number = {}
    code = lambda t: np.array([number.setdefault(w.strip(string.punctuation.encode()) or w, len(number)) for w in (t or "").encode().lower().split()])
    items = [code(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in Q.op9_decontamination(spark, sf).collect()}
    some = 0
    for d, t in docs_of(spark, sf):
        doc, found = code(t), got[d]
        if len(doc) > 400 and not found.contaminated:
            continue  # every clean document of ordinary length is looked at, and all others
        most = max((n for i in items if len(i) and len(doc) for n in [best_overlap(i, doc)] if n >= min(8, -(-4 * len(i) // 5))), default=0)
        assert found.contaminated == (most > 0) and found.n_equal == most
        some += found.contaminated
    assert some > 0


# 10 sharding


def check_shards(got, docs, near):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    slots, load = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if near:
        assert max(load.values()) <= near * min(load.values())
    return load


def test_shards(spark, sf):
    docs = docs_of(spark, sf)
    got = Q.op10_sharding(spark, sf).collect()
    check_shards(got, docs, 1.35)
    place = defaultdict(set)
    texts = dict(docs)
    for r in got:
        place[texts[r.doc_id]].add(r.shard)
    assert all(len(v) == 1 for v in place.values())


def test_shards_odd(spark):
    from tidemark.llm.sharding import kd_shards

    check_shards(kd_shards(H.odd_docs(spark)).collect(), [(r[0], r[1]) for r in H.odd_rows()], None)
    assert kd_shards(H.empty_docs(spark)).count() == 0
    hot = [(i, "same text" if i % 3 == 0 else f"text number {i} " + "x" * (i % 50)) for i in range(6000)]
    check_shards(kd_shards(spark.createDataFrame(hot, "doc_id long, text string")).collect(), hot, 1.05)


def test_repeated_rows_of_one_id_are_dealt(spark):
    from tidemark.llm.sharding import kd_shards

    rows = [(5, "the same row again and again " * 2)] * 2000 + [(i + 10, f"text number {i} " + "x" * (i % 50)) for i in range(1000)] + [(None, f"no id {i}") for i in range(500)]
    check_shards(kd_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), rows, 1.1)


def test_sharding_is_native(spark, sf):
    plan = Q.op10_sharding(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
