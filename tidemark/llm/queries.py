"""The operators of this subpackage as registered queries, over their whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import bounded_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a vocabulary file that the queries use; operators take it as a parameter."""
    if (folder := os.environ.get("TOKENIZERS_DIR")) is not None:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def word_bpe() -> str:
    return vocabulary("word_bpe_49k.json")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.vectors import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substring import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.bpe import token_digests

    return token_digests(_table(spark, sf_dir, "documents"), word_bpe())


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secrets import find_secrets

    return find_secrets(_table(spark, sf_dir, "documents"))


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), word_bpe())


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.minhash import near_duplicate_documents

    return near_duplicate_documents(_table(spark, sf_dir, "documents"))


def pii_key(spark: SparkSession) -> str:
    """The secret that surrogates are drawn by: ``spark.tidemark.piiKey``; where a session sets none, as in tests, one that
    keeps nothing secret."""
    return spark.conf.get("spark.tidemark.piiKey", "for tests only")


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import counted, pseudonymised

    return counted(pseudonymised(_table(spark, sf_dir, "documents"), pii_key(spark)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.langid import identify, train

    docs = _table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    return identify(docs, train(docs, fold != 0)).withColumn("held_out", fold == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import score, train

    docs = _table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = train(docs, _table(spark, sf_dir, "labels"), fold != 2)
    return score(docs, model).withColumn("held_out", fold == 2)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.alignment import alignment_digests

    return alignment_digests(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.whitening import whitened

    return whitened(_table(spark, sf_dir, "embeddings"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ann import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)


_ALL = (
    op1_embedding_near_dedup, op2_substring_dedup, op3_bpe_round_trip, op4_secret_scan, op5_pack_sequences, op6_exact_top_k, op7_minhash_near_dedup,
    op8_pii_surrogates, op9_language_id, op10_toxicity, op11_token_alignment, op12_embedding_whitening, op13_nearest_neighbours,
)
QUERIES = {f.__name__: f for f in _ALL}

_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least_id AS (SELECT a, min(b) AS m FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id))::BIGINT AS component_id,
  least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN least_id ON vec_id = least_id.a LEFT JOIN degree ON vec_id = degree.a
"""

_OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
"""

_OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w
), one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a),
least_id AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id))::BIGINT AS component_id,
  least(doc_id, coalesce(m, doc_id)) = doc_id AS kept FROM sets LEFT JOIN least_id ON doc_id = a
"""

ORACLES: dict[str, str] = {"op1_embedding_near_dedup": _OP1, "op6_exact_top_k": _OP6, "op7_minhash_near_dedup": _OP7}
