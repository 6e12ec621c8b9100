"""Status of a corpus and of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_stats(chunks: DataFrame, doc: str) -> DataFrame:
    per = chunks.groupBy(doc).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_chunks"), F.count("*").alias("total_documents"))


def top_documents(chunks: DataFrame, doc: str, order: str, n: int = 10) -> DataFrame:
    """The documents with the most chunks; of equal ones the first seen."""
    per = chunks.groupBy(doc).agg(F.count("*").alias("n_chunks"), F.min(order).alias("first_seen"))
    return per.orderBy(F.col("n_chunks").desc(), "first_seen").limit(n)


def health(chunks: DataFrame, backend: str = "none") -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks")).select(F.lit("ok").alias("status"), F.lit(backend).alias("llm_backend"), "chunks")


def progress(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    have = planned.select(key).distinct().join(done.select(key).distinct().withColumn("done", F.lit(1)), key, "left")
    return have.agg(F.count("done").alias("done"), F.count("*").alias("planned")).withColumn("percent", F.round(100 * F.col("done") / F.col("planned"), 4))


def ingest_summary(rows: DataFrame, doc: str, error: str) -> DataFrame:
    """Documents that went through, documents with an error, chunks."""
    per = rows.groupBy(doc).agg(F.max(F.col(error).isNotNull()).alias("failed"), F.count(F.when(F.col(error).isNull(), 1)).alias("n"))
    return per.agg(F.count(F.when(~F.col("failed"), 1)).alias("succeeded"), F.count(F.when(F.col("failed"), 1)).alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("chunks"))
