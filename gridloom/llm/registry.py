"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .common import table


def op1_exact_top_k(spark, sf_dir):
    from .topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op2_html_text(spark, sf_dir):
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_nearest_neighbours(spark, sf_dir):
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_substring_dedup(spark, sf_dir):
    from .substrings import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"), ("n_bytes", "n_removed", "n_spans", "kept_sha256"))


def op5_secret_scan(spark, sf_dir):
    from .secrets import report

    return report(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark, sf_dir):
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe_encode_decode(spark, sf_dir):
    import public_tokenizers

    from .bpe import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_mix_sources(spark, sf_dir):
    from pyspark.sql import functions as F

    from .mixing import mix

    rows = mix(table(spark, sf_dir, "documents"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("long").alias("taken"))


def op10_line_dedup(spark, sf_dir):
    from .lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"), ("n_lines", "n_removed", "kept_sha256"), short=True)


def pipeline(spark, sf_dir):
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_exact_top_k, op2_html_text, op3_nearest_neighbours, op4_substring_dedup, op5_secret_scan, op6_ngram_jaccard_join, op7_toxicity, op8_bpe_encode_decode, op9_mix_sources, op10_line_dedup, pipeline)}


#: The inner products of whole numbers are exact in doubles.
_TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
_JACCARD = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
    SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)
), r AS (
    SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT r.d, e.v FROM r JOIN e ON e.u = r.m
)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, low AS component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN (SELECT d, min(m) AS low FROM r GROUP BY d) t ON t.d = documents.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """The other operators are beyond SQL, or too slow in it on whole tables; tests/llm holds them against brute force."""
    return {"op1_exact_top_k": _TOP_K, "op6_ngram_jaccard_join": _JACCARD}
