"""The registered queries over the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fingerprints import fingerprints

    return fingerprints(read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licenses import document_paths, scan

    return scan(document_paths(read(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix_counts

    return mix_counts(read(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), n_words=2)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import predict_language

    return predict_language(read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.passages import without_passages

    out = without_passages(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.urlfilter import judge

    return judge(read(spark, sf_dir, "pages"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from tidemark.llm.common import keep_until_exit, shared_dir
    from tidemark.llm.tokens import read_tokens, write_tokens

    path = f"{shared_dir(spark)}/tidemark-tokens-{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    keep_until_exit(spark, path)
    return read_tokens(spark, path, with_ids=False)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import contamination

    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import kd_shards

    return kd_shards(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_fingerprints": op1_fingerprints, "op2_license_scan": op2_license_scan, "op3_mixing": op3_mixing, "op4_near_duplicates": op4_near_duplicates, "op5_language_id": op5_language_id, "op6_substring_dedup": op6_substring_dedup, "op7_url_filter": op7_url_filter, "op8_token_ids": op8_token_ids, "op9_decontamination": op9_decontamination, "op10_sharding": op10_sharding}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the whole contract. The other queries are tested against brute force."""
    return {"op4_near_duplicates": NEAR_DUPLICATES_SQL, "op6_substring_dedup": SUBSTRINGS_SQL}


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1)
    UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
least_ AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id <= coalesce(m, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_ USING (doc_id)
"""

SUBSTRINGS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
r AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM s JOIN r USING (k)),
one AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
