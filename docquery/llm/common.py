"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A word of the query contracts: a run without space, tab and line breaks.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD_PATTERN)
ASCII_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the setting is absent, a
    temporary one on a single machine; on a cluster that is an error, since the
    executors couldn't read it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
        found = tempfile.mkdtemp(prefix="docquery-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/docquery-{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the application's own folder
    within the shared one and reads it back, so that a lost executor costs no
    recomputation of what came before. The table stays until erased or clear."""
    path = f"{_own_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def erase(df: DataFrame) -> None:
    """Deletes a table of written that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that written has left for this application; for when
    its results have been stored elsewhere."""
    _delete(spark, _own_dir(spark))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Batches in smaller ones, so that few texts are Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def text_blocks(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about `limit` bytes of text; a text that is longer
    than that comes with what precedes it, at most `limit` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, made from name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
