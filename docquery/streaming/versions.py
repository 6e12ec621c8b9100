"""A table of chunks that follows a changing set of documents.

Each batch of changes is a version: the chunks of the documents that are new or
differ, and a tombstone for each document that is gone. A version counts once
its commit is written, after its rows. The newest version of a document is all
there is of it, so a document that comes again with fewer chunks, or with none,
leaves none of its old ones. Older versions can be read until they are vacuumed.

    <path>/rows/version=N      doc, sha256, gone and the chunker's columns
    <path>/commits/version=N   base: true where the rows are a whole snapshot
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Chunker = Callable[[DataFrame], DataFrame]
_OWN = ("doc", "sha256", "gone", "version")


def _commits(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """(version, base) of what has been committed, in order; a row a version."""
    try:
        found = spark.read.schema("base boolean, version long").parquet(f"{path}/commits").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((r.version, r.base) for r in found)


def _live(spark: SparkSession, path: str, at: int | None) -> DataFrame | None:
    """Rows of the newest version of every document, tombstones among them."""
    known = [(v, base) for v, base in _commits(spark, path) if at is None or v <= at]
    if not known:
        return None
    first = max((v for v, base in known if base), default=known[0][0])
    rows = spark.read.parquet(f"{path}/rows").where(F.col("version").isin([v for v, _ in known if v >= first]))
    newest = rows.groupBy(F.col("doc").alias("its_doc")).agg(F.max("version").alias("newest"))
    return rows.join(newest, F.col("doc").eqNullSafe(F.col("its_doc")) & (F.col("version") == F.col("newest")), "left_semi")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that can be read."""
    return [v for v, _ in _commits(spark, path)]


def current(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """(doc and the chunker's columns) of the table as it is, or as it was at a
    version. An error where nothing has been committed."""
    live = _live(spark, path, at)
    if live is None:
        raise ValueError(f"{path} has no version" + ("" if at is None else f" up to {at}"))
    return live.where("not gone").select("doc", *(c for c in live.columns if c not in _OWN))


def _write(rows: DataFrame, path: str, version: int, base: bool) -> None:
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/rows/version={version}")
    spark.range(1).select(F.lit(base).alias("base")).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/version={version}")


def apply_changes(docs: DataFrame, path: str, version: int, chunker: Chunker, doc: str = "doc_id", text: str = "text", gone: str | None = None) -> bool:
    """Makes version `version` of a batch of documents; says whether it did.

    docs: a row per document with its whole text; where the column `gone` is
    true the document is deleted. chunker gets (doc, text) and returns doc and
    other columns, a row per chunk. Documents whose text is the one they had are
    left as they are. A version that has been committed isn't made again, and
    one that wasn't is made anew, so a batch may be repeated after any failure.

    Of rows with one id the last by text counts, a deletion before all others; a
    null id is a document of its own; a null text is an empty one; an empty batch
    makes an empty version. Versions must grow.
    """
    spark = docs.sparkSession
    known = _commits(spark, path)
    if version in [v for v, _ in known]:
        return False
    if known and version < known[-1][0]:
        raise ValueError(f"version {version} is older than {known[-1][0]}")
    flag = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    given = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), flag.alias("gone"))
    given = given.groupBy("doc").agg(F.max(F.struct("gone", "text")).alias("last")).select("doc", "last.text", "last.gone")
    given = given.withColumn("sha256", F.when(~F.col("gone"), F.sha2(F.col("text").cast("binary"), 256)))
    live = _live(spark, path, None)
    if live is None:
        changed = given.where("not gone")
    else:
        had = live.groupBy("doc").agg(F.first("sha256").alias("had"), F.first("gone").alias("had_gone")).withColumnRenamed("doc", "had_doc")
        both = given.join(had, F.col("doc").eqNullSafe(F.col("had_doc")), "left")
        there = ~F.coalesce(F.col("had_gone"), F.lit(True))
        changed = both.where(F.when(F.col("gone"), there).otherwise(~there | ~F.col("had").eqNullSafe(F.col("sha256")))).select("doc", "text", "gone", "sha256")
    chunks = chunker(changed.where("not gone").select("doc", "text"))
    if taken := {c.lower() for c in chunks.columns} & set(_OWN[1:]):
        raise ValueError(f"columns of the table itself: {sorted(taken)}")
    every = changed.select(F.col("doc").alias("its_doc"), "sha256")
    rows = every.join(chunks.withColumn("chunked", F.lit(True)), F.col("doc").eqNullSafe(F.col("its_doc")), "left")
    rows = rows.withColumn("gone", F.col("chunked").isNull()).withColumn("doc", F.col("its_doc")).drop("its_doc", "chunked")
    _write(rows, path, version, not known)
    return True


def replace_all(docs: DataFrame, path: str, version: int, chunker: Chunker, doc: str = "doc_id", text: str = "text") -> bool:
    """apply_changes for a batch that is all there is: documents of the table
    that docs lacks are deleted."""
    spark = docs.sparkSession
    given = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), F.lit(False).alias("gone"))
    live = _live(spark, path, None)
    if live is not None:
        own = given.select(F.col("doc").alias("own_doc")).distinct()
        lost = live.where("not gone").select("doc").distinct().join(own, F.col("doc").eqNullSafe(F.col("own_doc")), "left_anti")
        given = given.unionByName(lost.select("doc", F.lit(None).cast("string").alias("text"), F.lit(True).alias("gone")))
    return apply_changes(given, path, version, chunker, "doc", "text", "gone")


def compact(spark: SparkSession, path: str) -> int:
    """Writes the table as it is as a version of its own, from which reading
    starts then; returns its number. Earlier versions stay readable."""
    version = _commits(spark, path)[-1][0] + 1
    _write(_live(spark, path, None).where("not gone").drop("version"), path, version, True)
    return version


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes what only versions before the last whole one need: first their
    commits, then their rows."""
    known = _commits(spark, path)
    last = max((v for v, base in known if base), default=None)
    folder = spark._jvm.org.apache.hadoop.fs.Path
    for kind in ("commits", "rows"):
        for v in [v for v, _ in known if last is not None and v < last]:
            gone = folder(f"{path}/{kind}/version={v}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def follow(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, chunker: Chunker, doc: str = "doc_id", text: str = "text", gone: str | None = None) -> StreamingQuery:
    """A stream of changes from Parquet files: each micro-batch is a version.
    Batches have odd numbers, which leaves room for compaction between them."""
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        apply_changes(batch, path, 2 * number + 1, chunker, doc, text, gone)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
