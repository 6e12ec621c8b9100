"""Queries on tables of documents: manifests, deltas, merges, status."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docquery.operators import calls, store
from docquery.operators import stats as st
from docquery.operators import summaries as sm
from docquery.plans.registry import query, table
from docquery.sources import artifacts, files
from docquery.storage import shared_dir
from docquery.streaming import versions as changes


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents")
def document_manifest(spark, sf_dir):
    return store.manifest(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("""
SELECT source, count(*) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
  bit_xor(CAST('0x' || substr(sha256(text), 1, 15) AS BIGINT)) AS mark
FROM documents GROUP BY source""")
def sha_manifest(spark, sf_dir):
    files_ = table(spark, sf_dir, "documents").select("source", F.octet_length("text").alias("bytes"), F.conv(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 15), 16, 10).cast("long").alias("mark"))
    return files_.groupBy("source").agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"), F.bit_xor("mark").alias("mark"))


_CACHED = """
WITH wants AS (SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 7 <> 0),
had AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(text) END AS sha256 FROM documents WHERE doc_id % 3 <> 1 OR doc_id % 7 = 0),
plan AS (SELECT coalesce(w.doc_id, h.doc_id) AS doc_id,
  CASE WHEN w.doc_id IS NULL THEN 'delete' WHEN h.doc_id IS NULL OR h.sha256 IS DISTINCT FROM w.sha256 THEN 'fetch' ELSE 'keep' END AS action
  FROM wants w FULL JOIN had h ON w.doc_id = h.doc_id)"""


def _cached(spark, sf_dir):
    """Two states of the cache that hold every document between them: some have
    gone, some are new, some have changed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    had = d.where("doc_id % 3 <> 1 OR doc_id % 7 = 0").withColumn("sha256", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("sha256")))
    return had, d.where("doc_id % 7 <> 0")


@query(_CACHED + " SELECT doc_id, action FROM plan")
def delta_plan(spark, sf_dir):
    return store.delta_plan(*_cached(spark, sf_dir), "doc_id")


@query(_CACHED + " SELECT doc_id, sha256 FROM wants")
def delta_apply(spark, sf_dir):
    had, wants = _cached(spark, sf_dir)
    return store.apply_delta(had, store.delta_plan(had, wants, "doc_id"), wants, "doc_id")


@query("""
WITH d AS (SELECT doc_id, text, sha256(text) AS sha256, sha256(source || lang || text) AS other FROM documents)
SELECT doc_id, sha256, CASE WHEN doc_id % 5 = 0 THEN 'differs' ELSE 'same' END AS state FROM d""")
def verified_fetch(spark, sf_dir):
    """All documents against a manifest in which every fifth has another digest."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("own"))
    wanted = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("source", "lang", "text").cast("binary"), 256)).otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"))
    good, bad = store.split_verified(d, wanted, "doc_id", F.col("text"))
    state = lambda df, x: df.select("doc_id", F.col("own").alias("sha256"), F.lit(x).alias("state"))
    return state(good, "same").unionByName(state(bad, "differs"))


@query("""
SELECT doc_id, source, n_chars FROM (
  SELECT doc_id, 'new' AS source, n_chars FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 3 <> 0)""")
def upsert_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return store.upsert(d, d.where("doc_id % 3 = 0").withColumn("source", F.lit("new")), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, sf_dir):
    return store.remaining(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
SELECT doc_id, summary FROM (SELECT doc_id, 'quality ' || min(quality) AS summary FROM labels GROUP BY doc_id
  UNION ALL SELECT doc_id, substr(text, 1, 40) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))""")
def merge_summaries(spark, sf_dir):
    have = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.concat(F.lit("quality "), F.min("quality").cast("string")).alias("summary"))
    return sm.fill_missing(have, table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 40).alias("summary")), "doc_id")


@query(r"""
SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
  regexp_extract(url, '^https?://[^/]*/([a-z]{2})/', 1) AS lang, regexp_extract(url, '/([0-9]+)(\.html|/)?([?#].*)?$', 1) AS number FROM pages""")
def url_metadata(spark, sf_dir):
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", part("^(https?)://").alias("scheme"), part("^https?://([^/?#]*)").alias("host"), part("^https?://[^/]*/([a-z]{2})/").alias("lang"), part(r"/([0-9]+)(\.html|/)?([?#].*)?$").alias("number")
    )


@query(r"""
WITH f AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'notes_' || source ELSE 'uu-' || doc_id || '-' || (1950 + doc_id % 70) || '_' || source || '-' || lang END AS stem FROM documents)
SELECT doc_id, regexp_extract(stem, '(?i)^uu-(\d+[A-Za-z]?)-(\d{4})_(.+)$', 1) AS number, regexp_extract(stem, '(?i)^uu-(\d+[A-Za-z]?)-(\d{4})_(.+)$', 2) AS year,
  CASE WHEN regexp_matches(stem, '(?i)^uu-(\d+[A-Za-z]?)-(\d{4})_(.+)$') THEN translate(regexp_extract(stem, '(?i)^uu-(\d+[A-Za-z]?)-(\d{4})_(.+)$', 3), '-_', '  ') ELSE stem END AS title FROM f""")
def file_name_metadata(spark, sf_dir):
    stem = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("notes_"), "source")).otherwise(
        F.concat(F.lit("uu-"), F.col("doc_id").cast("string"), F.lit("-"), (1950 + F.col("doc_id") % 70).cast("string"), F.lit("_"), F.col("source"), F.lit("-"), F.col("lang"))
    )
    d = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("/data/pdf/"), stem, F.lit(".pdf")))
    return d.select("doc_id", *files.file_metadata(F.col("path")))


@query("""
SELECT conv_id, count(*) AS n_chunks, arg_min(role, turn) AS first_role, arg_max(turn, turn) AS last_turn FROM conversations GROUP BY conv_id""")
def export_per_document(spark, sf_dir):
    e = store.export_documents(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", ["role", "text"])
    return e.select("conv_id", "n_chunks", F.col("chunks")[0]["role"].alias("first_role"), F.element_at("chunks", -1)["turn"].alias("last_turn"))


@query("SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS chunks, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT conv_id, count(*) AS n, sum(strlen(text)) AS b FROM conversations GROUP BY conv_id)")
def export_totals(spark, sf_dir):
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    return per.agg(F.count("*").alias("documents"), F.sum("n").alias("chunks"), F.sum("b").alias("bytes"))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k = 1")
def first_chunk_per_node(spark, sf_dir):
    return store.first_per(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT CAST(count(*) AS BIGINT) AS total_chunks, count(DISTINCT source) AS total_documents FROM documents")
def corpus_stats(spark, sf_dir):
    return st.corpus_stats(table(spark, sf_dir, "documents"), "source")


@query("SELECT source, count(*) AS n_chunks, min(doc_id) AS first_seen FROM documents GROUP BY source ORDER BY n_chunks DESC, first_seen LIMIT 10")
def top_documents(spark, sf_dir):
    return st.top_documents(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("SELECT 'ok' AS status, 'none' AS llm_backend, count(*) AS chunks FROM documents")
def health(spark, sf_dir):
    return st.health(table(spark, sf_dir, "documents"))


@query("""
SELECT count(l.doc_id) AS done, count(*) AS planned, round(100.0 * count(l.doc_id) / count(*), 4) AS percent
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def job_progress(spark, sf_dir):
    return st.progress(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
SELECT count(*) FILTER (WHERE NOT failed) AS succeeded, count(*) FILTER (WHERE failed) AS failed, CAST(sum(n) AS BIGINT) AS chunks
FROM (SELECT conv_id, bool_or(strlen(text) > 2000) AS failed, count(*) FILTER (WHERE strlen(text) <= 2000) AS n FROM conversations GROUP BY conv_id)""")
def ingest_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("error", F.when(F.octet_length("text") > 2000, "too long"))
    return st.ingest_summary(rows, "conv_id", "error")


@query("""
SELECT shard, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % 4 AS shard FROM documents) GROUP BY shard""")
def shard_assignment(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", store.shard(F.col("doc_id"), 4).alias("shard"))
    return d.groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("SELECT doc_id, source || '-' || lang || '-pasal-' || doc_id || '-' || (doc_id % 9) AS id FROM documents")
def chunk_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", store.chunk_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string"), F.col("doc_id") % 9).alias("id"))


_CHUNKS = """
WITH c AS (SELECT replace(source, 'src', '') AS nomor_uu, '2001' AS tahun_uu, source AS tentang, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, doc_id, text, embedding
  FROM documents JOIN embeddings ON doc_id = vec_id),
s AS (SELECT nomor_uu, max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))) / 127 AS vec_scale FROM c GROUP BY nomor_uu)"""


def _chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    i = F.col("doc_id")
    chunks = d.select(
        F.replace("source", F.lit("src"), F.lit("")).alias("nomor_uu"), F.lit("2001").alias("tahun_uu"), F.col("source").alias("tentang"), i.alias("position"),
        F.concat(F.lit("id-"), i.cast("string")).alias("id"), (i % 40).cast("string").alias("pasal"), F.when(i % 2 == 0, i % 6).cast("int").alias("ayat"),
        F.when(i % 11 == 0, "PENJELASAN").alias("bab"), "text", "embedding",
    )
    return store.checked_export(chunks, "embedding", 64)


def _payloads(spark, sf_dir):
    return store.export_payloads(_chunks(spark, sf_dir))


@query(_CHUNKS + """
SELECT c.nomor_uu, tahun_uu, tentang, CAST(position AS INTEGER) AS position, 'id-' || doc_id AS id, CAST(doc_id % 40 AS VARCHAR) AS pasal,
  CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 6 AS INTEGER) END AS ayat, CASE WHEN doc_id % 11 = 0 THEN 'PENJELASAN' END AS bab, text, round(vec_scale, 9) AS vec_scale,
  list_transform(embedding, lambda x: CAST(greatest(-127, least(127, round_even(x::DOUBLE / vec_scale, 0))) AS TINYINT))[1] AS first
FROM c JOIN s USING (nomor_uu)""")
def export_round_trip(spark, sf_dir):
    """Chunks and vectors, written as exported files and read again."""
    path = f"{shared_dir(spark)}/docquery-{spark.sparkContext.applicationId}/exports-{uuid.uuid4().hex}"
    files.write_exports(_payloads(spark, sf_dir), path)
    back = files.read_exports(spark, path, lines=True, dim=64)
    first = F.element_at("codes", 1)
    return back.select("nomor_uu", "tahun_uu", "tentang", "position", "id", "pasal", "ayat", "bab", "text", F.round("vec_scale", 9).alias("vec_scale"), first.alias("first"))


@query(_CHUNKS + """
SELECT 'v1' AS version, 64 AS dim, 'hash' AS model, 'uu-' || nomor_uu || '-2001' AS key, 'uu-' || nomor_uu || '-2001.json' AS file, CAST(count(*) AS INTEGER) AS chunks FROM c GROUP BY nomor_uu""")
def export_manifest(spark, sf_dir):
    m = store.export_manifest(_payloads(spark, sf_dir), "v1", 64, "hash")
    return m.select("version", "dim", "model", "key", "file", "chunks")


@query(r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, length(text) // 2) ELSE text END AS text FROM documents WHERE doc_id % 3 <> 1 OR doc_id % 7 <> 0),
s AS (SELECT doc_id, string_split(text, E'\n') AS lines FROM d)
SELECT doc_id, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS position, unnest(lines) AS text FROM s""")
def versioned_documents(spark, sf_dir):
    """Lines of all documents after three batches of changes: a third of the
    documents comes again at half its length, some go, a third comes late."""
    path = f"{shared_dir(spark)}/docquery-{spark.sparkContext.applicationId}/versions-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    third = F.col("doc_id") % 3
    lines = lambda df: df.select("doc", F.posexplode(F.split("text", "\n")).alias("position", "text"))
    half = docs.where(third == 0).select("doc_id", F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("text"), F.lit(False).alias("gone"))
    gone = docs.where((third == 1) & (F.col("doc_id") % 7 == 0)).withColumn("gone", F.lit(True))
    changes.apply_changes(docs.where(third != 2), path, 1, lines)
    changes.apply_changes(half.unionByName(gone), path, 3, lines, gone="gone")
    changes.apply_changes(docs.where(third == 2), path, 5, lines)
    return changes.current(spark, path).withColumnRenamed("doc", "doc_id")


_FILES = """
WITH c AS (SELECT replace(source, 'src', '') AS nomor_uu, CAST(1900 + doc_id % 97 AS VARCHAR) AS tahun_uu, source AS tentang, doc_id, text, embedding FROM documents JOIN embeddings ON doc_id = vec_id),
s AS (SELECT nomor_uu, tahun_uu, max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))) / 127 AS vec_scale FROM c GROUP BY nomor_uu, tahun_uu),
p AS (SELECT nomor_uu, tahun_uu, tentang, vec_scale, doc_id,
    list_aggregate(list_transform(embedding, lambda x: printf('%02X', (CAST(greatest(-127, least(127, round_even(x::DOUBLE / vec_scale, 0))) AS INTEGER) + 256) % 256)), 'string_agg', '') AS codes,
    '{"id": "id-' || doc_id || '", "pasal": "' || (doc_id % 40) || '", "ayat": ' || CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 6 AS VARCHAR) ELSE 'null' END
      || ', "bab": ' || CASE WHEN doc_id % 11 = 0 THEN '"PENJELASAN"' ELSE 'null' END || ', "text": ' || CAST(to_json(text) AS VARCHAR) || '}' AS chunk
  FROM c JOIN s USING (nomor_uu, tahun_uu)),
f AS (SELECT nomor_uu, tahun_uu, CAST(count(*) AS INTEGER) AS chunks, '{"nomor_uu": "' || nomor_uu || '", "tahun_uu": "' || tahun_uu || '", "tentang": "' || min(tentang) || '", "vec_scale": ' || CAST(min(vec_scale) AS VARCHAR)
    || ', "vec_b64": "' || to_base64(unhex(string_agg(codes, '' ORDER BY doc_id))) || '", "chunks": [' || string_agg(chunk, ', ' ORDER BY doc_id) || ']}' AS payload FROM p GROUP BY nomor_uu, tahun_uu)
SELECT 'v1' AS version, 64 AS dim, 'hash' AS model, 'uu-' || nomor_uu || '-' || tahun_uu AS key, 'uu-' || nomor_uu || '-' || tahun_uu || '.json' AS file, chunks, CAST(strlen(payload) AS BIGINT) AS bytes, sha256(payload) AS sha256, sha256(payload) AS sha256_of_file FROM f"""


def _written_files(spark, sf_dir):
    """A file for every source and remainder of the ids."""
    path = f"{shared_dir(spark)}/docquery-{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex}"
    chunks = _chunks(spark, sf_dir).withColumn("tahun_uu", (1900 + F.col("position") % 97).cast("string"))
    artifacts.write_export_files(chunks, path, "v1", 64, "hash")
    return path


@query(_FILES)
def export_files(spark, sf_dir):
    """Chunks and vectors in files: what the manifest says of each, and the
    digest of the file as it lies there."""
    path = _written_files(spark, sf_dir)
    there = files.binary_files(spark, path, "uu-*.json").select(F.substring_index("path", "/", -1).alias("file"), F.sha2("content", 256).alias("sha256_of_file"))
    return files.read_manifest(spark, f"{path}/manifest.json").join(there, "file")


@query("""
SELECT 'uu-' || replace(source, 'src', '') || '-' || (1900 + doc_id % 97) AS key, CAST(row_number() OVER (PARTITION BY source, doc_id % 97 ORDER BY doc_id) - 1 AS INTEGER) AS position,
  'id-' || doc_id AS id, text FROM documents JOIN embeddings ON doc_id = vec_id""")
def export_files_read(spark, sf_dir):
    """The chunks of all files, as they are read again."""
    return files.read_exports(spark, _written_files(spark, sf_dir)).select(F.concat_ws("-", F.lit("uu"), "nomor_uu", "tahun_uu").alias("key"), "position", "id", "text")


@query("""
SELECT doc_id, CAST(CASE WHEN length(text) > 2000 THEN 2 ELSE 1 END AS INTEGER) AS batch, CAST(1 AS INTEGER) AS tries,
  length(text) || ' huruf, sidik ' || md5(text) AS answer FROM documents""")
def resumed_answers(spark, sf_dir):
    """Every text put to a model that refuses long ones, then what failed to
    another; the answers' label goes."""
    import hashlib

    def long(text: str) -> str:
        return f" Penjelasan: {len(text)} huruf, sidik {hashlib.md5(text.encode()).hexdigest()}\n"

    def short(text: str) -> str:
        if len(text) > 2000:
            raise ValueError("too long")
        return long(text)

    path = f"{shared_dir(spark)}/docquery-{spark.sparkContext.applicationId}/answers-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for model in (short, long):
        calls.add_answers(docs, path, "doc_id", "text", model, sm.tidy_model_summary, tries=1)
    return calls.last_answers(spark, path, "doc_id").select("doc_id", "batch", "tries", "answer")
