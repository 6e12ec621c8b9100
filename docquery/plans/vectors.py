"""Queries on vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquery.operators import embedder, ivf
from docquery.operators import vectors as v
from docquery.plans.registry import query, table
from docquery.storage import stored

#: Queries that are sent to the tasks at once.
QUERIES_AT_ONCE = 4000

@query("""
SELECT e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
ORDER BY round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) DESC, e.vec_id LIMIT 5""")
def dense_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return v.dense_top_k(q, e, 5).select("vec_id", F.round("score", 6).alias("score"))


@query("""
WITH q AS (SELECT label, min(vec_id) AS qid, arg_min(embedding, vec_id) AS vector FROM embeddings GROUP BY label),
s AS (SELECT qid, vec_id, list_inner_product(embedding::DOUBLE[], vector::DOUBLE[]) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s)
SELECT qid, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def dense_topk_batch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.groupBy("label").agg(F.min("vec_id").alias("qid"), F.min_by("embedding", "vec_id").alias("vector"))
    return v.dense_top_k(q, e, 5).select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


_SCALES = """
WITH m AS (SELECT label, max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))) AS top FROM embeddings GROUP BY label),
s AS (SELECT label, CASE WHEN top > 0 THEN top / 127 ELSE 1.0 END AS scale FROM m),
q AS (SELECT e.vec_id, e.label, s.scale, list_transform(e.embedding, lambda x: CAST(greatest(-127, least(127, round_even(x::DOUBLE / s.scale, 0))) AS TINYINT)) AS codes
  FROM embeddings e JOIN s USING (label))"""


def _coded(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.join(v.group_scales(e, "label", "embedding"), "label").withColumn("codes", v.quantize(F.col("embedding"), F.col("scale")))


@query(_SCALES + " SELECT label, scale FROM s")
def quantize_int8_scale(spark, sf_dir):
    return v.group_scales(table(spark, sf_dir, "embeddings"), "label", "embedding")


@query(_SCALES + " SELECT vec_id, codes[1] AS first, codes[-1] AS last, CAST(list_sum(codes) AS BIGINT) AS total, CAST(len(codes) AS INTEGER) AS dim FROM q")
def quantize_int8_values(spark, sf_dir):
    total = F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x)
    return _coded(spark, sf_dir).select("vec_id", F.element_at("codes", 1).alias("first"), F.element_at("codes", -1).alias("last"), total.alias("total"), F.size("codes").alias("dim"))


@query(_SCALES + """
, d AS (SELECT vec_id, list_transform(codes, lambda x: x * scale) AS raw FROM q)
SELECT vec_id, round(raw[1] / sqrt(list_sum(list_transform(raw, lambda x: x * x))), 6) AS first,
  round(sqrt(list_sum(list_transform(list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y)))), lambda x: x * x))), 6) AS length FROM d""")
def dequantize_norm(spark, sf_dir):
    d = _coded(spark, sf_dir).withColumn("unit", v.dequantize(F.col("codes"), F.col("scale")))
    return d.select("vec_id", F.round(F.element_at("unit", 1), 6).alias("first"), F.round(v.norm(F.col("unit")), 6).alias("length"))


@query(_SCALES + """
SELECT vec_id, to_base64(unhex(list_aggregate(list_transform(codes, lambda x: printf('%02X', (x::INTEGER + 256) % 256)), 'string_agg', ''))) AS text, true AS same, CAST(len(codes) AS INTEGER) AS dim FROM q""")
def base64_codec(spark, sf_dir):
    """The text itself is compared, and that it leads back to the codes."""
    d = _coded(spark, sf_dir).withColumn("text", v.to_base64(F.col("codes")))
    back = v.from_base64(F.col("text"))
    return d.select("vec_id", "text", (back == F.col("codes")).alias("same"), F.size(back).alias("dim"))


@query()
def hash_embedding_topk(spark, sf_dir):
    """The stated queries are the documents whose ids 20 divides, in blocks, against all."""
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", v.hash_embedding(F.col("text"), 32).alias("vector")))
    q = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vector")
    return v.dense_top_k_blocks(q, docs, 3, key="doc_id", vector="vector", at_once=QUERIES_AT_ONCE).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


def _asked(e):
    """The stated queries: the rows whose ids 20 divides."""
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


@query()
def ivf_topk(spark, sf_dir):
    """Through the index, reading as many lists as a recall of 0.95 took on its
    sample: an approximation, measured in the tests against all rows."""
    e = table(spark, sf_dir, "embeddings")
    found = ivf.search(ivf.build(e), _asked(e), e, 5)
    return found.select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("""
WITH s AS (SELECT q.vec_id AS qid, e.vec_id, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s)
SELECT qid, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def ivf_topk_exact(spark, sf_dir):
    """Through all lists of the index: codes exclude, exact scores decide."""
    e = table(spark, sf_dir, "embeddings")
    index = ivf.build(e, n_probe=1)
    found = ivf.search(index, _asked(e), e, 5, n_probe=len(index.centroids))
    return found.select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


@query()
def semantic_topk(spark, sf_dir):
    """The stated queries are the documents whose ids 20 divides: their nearest
    by a model fitted to all documents, through the index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = stored(embedder.embed(docs, embedder.fit(docs)))
    q = found.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vector")
    near = ivf.search(ivf.build(found, "doc_id", "vector"), q, found, 3, vector="vector")
    return near.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("""
SELECT doc_id, text, CASE WHEN length(trim(source)) > 0 THEN source || E'\n\n' || text ELSE text END AS embed_text, coalesce(length(trim(source)) > 0, false) AS enhanced FROM documents""")
def enhanced_texts(spark, sf_dir):
    """What is embedded beside what is stored; the source stands for a model's description."""
    docs = table(spark, sf_dir, "documents")
    enhanced = F.coalesce(F.length(F.trim("source")) > 0, F.lit(False))
    return docs.select("doc_id", "text", embedder.embed_text(F.col("source"), F.col("text")).alias("embed_text"), enhanced.alias("enhanced"))
