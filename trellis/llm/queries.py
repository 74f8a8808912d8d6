"""The queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dedup, html, mixing, packing, quality, tokens, toxicity, vectors, warc
from .shared import crc_mod, table


def tokenizer() -> str:
    """The path of the queries' tokenizer; the vocabulary files are looked for only when a query needs one."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.finite(table(spark, sf_dir, "embeddings"))
    # floor() gives a 64-bit integer; a double beyond 2**53 is whole already
    whole = rows.select("vec_id", F.transform("v", lambda x: F.when(F.abs(x * 256) < 2.0**53, F.floor(x * 256).cast("double")).otherwise(x * 256)).alias("embedding"))
    return vectors.top_k_inner_product(whole, whole.where("vec_id % 50 = 0"), k=5)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, x AS y FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(x, y), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM q, v WHERE vec_id <> query_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer(), capacity=4096, end_id=1)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
c AS (SELECT min(doc_id) AS node, list(doc_id) AS docs, list_sort(s) AS k, len(s) AS n FROM t GROUP BY list_sort(s), len(s)),
x AS MATERIALIZED (SELECT node, n, unnest(k) AS g FROM c WHERE n > 0),
l AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.g = b.g AND a.node <> b.node
      GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT node, node AS root FROM c WHERE n > 0 UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT t.doc_id, len(t.s)::BIGINT AS n_shingles, coalesce(m.root, t.doc_id) AS component_id,
       coalesce(m.root, t.doc_id) = t.doc_id AS kept
FROM t LEFT JOIN (SELECT unnest(docs) AS doc_id, node FROM c WHERE n > 0) d USING (doc_id) LEFT JOIN m USING (node)
"""


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """Fitted on the label rows outside the held-out quarter."""
    return quality.fit(docs, table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 4) != 2))


def op4_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, manifest = tokens.write_token_files(table(spark, sf_dir, "documents"), tokenizer(), end_id=2)
    return tokens.read_token_files(spark, out, manifest)


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs).select("doc_id", "source", F.col("mix_block").alias("block"), F.col("mix_place").alias("place"), F.col("mix_slot").alias("slot"))
    return mixed


def op8_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest_by_codes(rows, rows.where("vec_id % 50 = 0"), k=5)


def op9_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second replica gets a wrong byte in every record whose page_id leaves 13 by 97: the audit has to find just these."""
    return warc.audit_pages(table(spark, sf_dir, "pages"), damage="page_id % 97 = 13")


OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(page_id::VARCHAR, '') AS id, coalesce(html, '') AS html,
  array_to_string(list_transform(string_split(nullif(url, ''), ''),
    lambda c: CASE WHEN unicode(c) <= 32 OR unicode(c) = 127 THEN format('%{:02X}', unicode(c)) ELSE c END), '') AS url FROM pages),
r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) ||
  'WARC-Record-ID: <urn:page:' || id || '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) ||
  'WARC-Target-URI: ' || coalesce(url, 'urn:page:' || id) || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) ||
  'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS r FROM p)
SELECT page_id, strlen(r)::BIGINT AS record_bytes, sha256(r) AS record_sha256,
       coalesce(page_id % 97 = 13, FALSE) AS damaged, FALSE AS lost FROM r
"""


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Fitted on the label rows outside the held-out fifth."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0))


def op10_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_top_k, op2_best_fit_packing, op3_minhash_near_dedup, op4_attention_quality, op5_token_id_files, op6_html_main_text, op7_pfair_mixing, op8_one_bit_codes, op9_warc_merkle_audit, op10_boosted_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": OP1_SQL, "op3_minhash_near_dedup": OP3_SQL, "op9_warc_merkle_audit": OP9_SQL}
