"""Tables of chunks: upsert, export, manifest, delta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.operators.vectors import quantize, to_base64

#: Positions of a document that go into one part of its export.
SPAN = 1024


def chunk_id(number: Column, year: Column, label: Column, position: Column) -> Column:
    return F.format_string("%s-%s-pasal-%s-%d", number, year, label, position.cast("long"))


def upsert(stored: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of new replace those of stored with the same key; nothing is
    deleted. Of rows in new that share a key, the last by order stays (and by
    all columns where order says nothing), so that reruns agree."""
    rest = [c for c in new.columns if c not in (key, order)]
    last = Window.partitionBy(key).orderBy(*([F.col(order).desc_nulls_last()] if order else []), F.xxhash64(*rest) if rest else F.lit(0))
    fresh = new.withColumn("nth_", F.row_number().over(last)).where("nth_ = 1").drop("nth_")
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def export_documents(chunks: DataFrame, doc: list[str], order: str, fields: list[str]) -> DataFrame:
    """One row per document with its chunks in order, as an array of structs."""
    rows = F.sort_array(F.collect_list(F.struct(order, *fields)))
    return chunks.groupBy(*doc).agg(rows.alias("chunks"), F.count("*").alias("n_chunks"))


def export_payloads(chunks: DataFrame, vector: str = "embedding", span: int = SPAN) -> DataFrame:
    """(key, nomor_uu, tahun_uu, start, n_chunks, payload): each document as JSON
    texts, its parts. chunks: nomor_uu, tahun_uu, tentang, position, id, pasal,
    ayat, bab, text and the vector. A document has one scale (its largest
    absolute component / 127, 1 where that is 0). A part has the chunks of span
    successive positions, the number of those before it (start) and one base64
    text of their 8-bit vectors, so that no row holds more than that of a
    document. A null number or year is an empty text."""
    doc, part = ["nomor_uu", "tahun_uu"], ["nomor_uu", "tahun_uu", "part"]
    rows = chunks.withColumns({c: F.coalesce(c, F.lit("")) for c in doc}).withColumn("part", F.coalesce(F.floor(F.col("position") / span), F.lit(-1)))
    top = F.max(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double")))))
    heads = rows.groupBy(*part).agg(F.count("*").alias("n"), top.alias("top"), F.min_by("tentang", "position").alias("tentang"))
    all_, before = Window.partitionBy(*doc), Window.partitionBy(*doc).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(
        *part, F.col("n").cast("int").alias("n_chunks"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.max("top").over(all_).alias("top"), F.min_by("tentang", "part").over(all_).alias("tentang")
    )
    fields = [F.col(c) for c in ("id", "pasal", "ayat", "bab", "text")]
    bodies = rows.groupBy(*part).agg(F.sort_array(F.collect_list(F.struct("position", F.struct(*fields).alias("chunk"), F.col(vector).alias("v")))).alias("rows"))
    docs = bodies.join(heads, part).withColumn("vec_scale", F.when(F.col("top") > 0, F.col("top") / 127).otherwise(1.0))
    flat = F.flatten(F.transform("rows", lambda r: r["v"]))
    out = docs.select(
        *doc, "tentang", "start", "n_chunks", "vec_scale", to_base64(quantize(flat, F.col("vec_scale"))).alias("vec_b64"), F.transform("rows", lambda r: r["chunk"]).alias("chunks")
    )
    payload = F.to_json(F.struct(*doc, "tentang", "vec_scale", "start", "vec_b64", "chunks"), {"ignoreNullFields": "false"})
    return out.select(F.concat_ws("-", F.lit("uu"), *doc).alias("key"), *doc, "start", "n_chunks", payload.alias("payload"))


def export_manifest(payloads: DataFrame, version: str, dim: int, model: str) -> DataFrame:
    """(version, dim, model, key, file, chunks, bytes, sha256), a row per
    document. The digest of a document of several parts is that of their
    digests, one after the other."""
    digests = F.transform(F.sort_array(F.collect_list(F.struct("start", F.sha2(F.col("payload").cast("binary"), 256).alias("sha256")))), lambda p: p["sha256"])
    bytes_ = F.sum(F.octet_length("payload").cast("long"))
    rows = payloads.groupBy("key").agg(F.sum("n_chunks").cast("int").alias("chunks"), bytes_.alias("bytes"), digests.alias("digests"))
    sha256 = F.when(F.size("digests") == 1, F.element_at("digests", 1)).otherwise(F.sha2(F.array_join("digests", "").cast("binary"), 256))
    return rows.select(
        F.lit(version).alias("version"), F.lit(dim).alias("dim"), F.lit(model).alias("model"), "key", F.concat("key", F.lit(".json")).alias("file"), "chunks", "bytes", sha256.alias("sha256")
    )


def checked_export(chunks: DataFrame, vector: str, dim: int) -> DataFrame:
    """Refuses chunks without a vector of dim components, when they are read."""
    good = F.coalesce(F.size(vector) == dim, F.lit(False))
    return chunks.where(F.when(good, True).otherwise(F.raise_error(F.lit(f"a chunk has no vector of {dim} components")).cast("boolean")))


def manifest(files: DataFrame, key: str, content: Column, count: Column | None = None) -> DataFrame:
    """(key, bytes, sha256[, chunks]) of each file's content."""
    cols = [F.col(key), F.octet_length(content).cast("long").alias("bytes"), F.sha2(content.cast("binary"), 256).alias("sha256")]
    return files.select(*cols, *([count.cast("long").alias("chunks")] if count is not None else []))


def verified(files: DataFrame, expected: DataFrame, key: str, content: Column) -> DataFrame:
    """files whose bytes have the digest that the manifest says; any other stops
    the job."""
    same = F.sha2(content.cast("binary"), 256) == F.col("sha256")
    checked = F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), F.col(key).cast("string"))).cast("boolean"))
    return files.join(expected.select(key, "sha256"), key).where(checked).drop("sha256")


def split_verified(files: DataFrame, expected: DataFrame, key: str, content: Column) -> tuple[DataFrame, DataFrame]:
    """(files whose bytes have the digest that the manifest says, files whose
    bytes have another); for callers who go on with the good ones."""
    both = files.join(expected.select(key, F.col("sha256").alias("wanted_")), key).withColumn("same_", F.sha2(content.cast("binary"), 256).eqNullSafe(F.col("wanted_")))
    return both.where("same_").drop("wanted_", "same_"), both.where("not same_").drop("wanted_", "same_")


def delta_plan(cached: DataFrame, expected: DataFrame, key: str, digest: str = "sha256") -> DataFrame:
    """(key, action): delete what the manifest lacks, fetch what is missing or
    differs, keep the rest."""
    both = cached.select(key, F.col(digest).alias("had"), F.lit(True).alias("cached")).join(expected.select(key, F.col(digest).alias("wants"), F.lit(True).alias("expected")), key, "full_outer")
    action = F.when(F.col("expected").isNull(), "delete").when(F.col("cached").isNull() | ~F.col("had").eqNullSafe(F.col("wants")), "fetch").otherwise("keep")
    return both.select(key, action.alias("action"))


def apply_delta(cached: DataFrame, plan: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """What the cache holds after the plan."""
    keep = cached.join(plan.where("action = 'keep'").select(key), key, "left_semi")
    return keep.unionByName(fetched.join(plan.where("action = 'fetch'").select(key), key, "left_semi"))


def remaining(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed job has still to do."""
    return planned.join(done.select(key), key, "left_anti")


def shard(key: Column, n: int) -> Column:
    """The same shard in every process, by the first 60 bits of MD5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long") % n


def first_per(rows: DataFrame, node: str, order: str) -> DataFrame:
    """The first row of each node."""
    return rows.withColumn("nth_", F.row_number().over(Window.partitionBy(node).orderBy(order))).where("nth_ = 1").drop("nth_")
