"""The pipeline's stages, each against brute force on its own input."""

import zlib
from collections import Counter

import corpus_pipeline as P
from tests.llm import helpers as H


def test_stages_are_the_five():
    assert [f.__name__ for _, f in P.STAGES] == ["identify_language", "drop_near_duplicates", "decontaminate", "mix_sources", "shard"]


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = (before, docs)
        assert docs.columns == columns or i == 4
    before, after = seen["language ID"]
    assert after.count() >= 0.98 * before.count()
    before, after = seen["MinHash near-dedup"]
    groups = H.near_groups([(r.doc_id, r.text) for r in before.collect()], 5)
    assert Counter(r.doc_id for r in after.collect()) == Counter(set(groups.values()))
    before, after = seen["benchmark decontamination"]
    items = [b" ".join(H.words(r.text)).lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    low = {r.doc_id: b" ".join(H.words(r.text)).lower() for r in before.collect()}
    assert {r.doc_id for r in after.collect()} == {d for d, t in low.items() if not any(i in t for i in items)}
    before, after = seen["mixing sources to target weights"]
    n = sum(len(H.words(r.text)) for r in before.collect())
    assert abs(sum(len(H.words(r.text)) for r in after.collect()) - n) <= 20
    before, after = seen["sharding"]
    assert before.count() == after.count()


def test_pipeline_on_odd_rows(spark, sf, tmp_path):
    docs = H.odd_docs(spark)
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        seen.append((before.collect(), docs.collect()))
        assert docs.columns == columns or i == 4
    for before, after in seen[:3]:  # rows go or stay as they are, each once
        assert not Counter(after) - Counter(before)
    before, after = seen[1]
    sets = {r.rid: H.shingles(r.text, 5) for r in before}
    linked = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    kept = [r.rid for r in after]
    assert not any(linked(a, b) for a in kept for b in kept if a < b)
    reach = set(kept)
    while True:  # whatever went hangs together with a row that stayed
        more = {r.rid for r in before if any(linked(r.rid, x) for x in reach)} | reach
        if more == reach:
            break
        reach = more
    assert reach == {r.rid for r in before}
    items = [b" ".join(H.words(r.text)).lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(i in b" ".join(H.words(r.text)).lower() for r in seen[2][1] for i in items)
    before, after = seen[3]
    source = {r.rid: Counter(H.words(r.text)) for r in before}
    assert {r.rid for r in after} <= set(source) and all(not Counter(H.words(r.text)) - source[r.rid] for r in after)
    assert abs(sum(len(H.words(r.text)) for r in after) - sum(sum(c.values()) for c in source.values())) <= len({r.source for r in before})
    before, after = seen[4]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in after) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in before)
    docs = H.empty_docs(spark)
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/e{i}")
        docs = spark.read.parquet(f"{tmp_path}/e{i}")
    assert docs.count() == 0


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 100
