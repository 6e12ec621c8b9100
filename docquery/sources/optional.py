"""Side inputs that a job can do without."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession


class SideInput(NamedTuple):
    rows: DataFrame | None
    state: str  # fresh, kept or absent
    error: str | None  # what kept the input from being read


def _snapshots(spark: SparkSession, kept: str) -> list[str]:
    """Whole snapshots, oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(kept).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at(kept)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at(kept))]
    return [f"{kept}/{n}" for n in sorted(n for n in names if n.startswith("snapshot-")) if fs.exists(at(f"{kept}/{n}/_SUCCESS"))]


def side_input(spark: SparkSession, read: Callable[[], DataFrame], kept: str, absent_is_none: bool = True) -> SideInput:
    """Reads an optional input and keeps what it read under `kept`.

    fresh: it could be read, to its last row (that is what writing the snapshot
    proves), and rows are that snapshot. kept: it is broken, and rows are the
    last snapshot that is whole. absent: no such path, or broken and never read
    before; rows are None. With absent_is_none=False a missing path counts as
    broken, so that the last snapshot serves. Broken is what Spark says when it
    reads: let the reader fail on malformed rows (mode FAILFAST). Any other
    exception of `read` is the caller's own and isn't caught."""
    known = _snapshots(spark, kept)
    target = f"{kept}/snapshot-{len(known):09d}-{uuid.uuid4().hex}"
    try:
        read().write.parquet(target)
        return SideInput(spark.read.parquet(target), "fresh", None)
    except (PySparkException, Py4JJavaError) as e:  # a job that stopped comes as either
        missing = isinstance(e, AnalysisException) and e.getCondition() == "PATH_NOT_FOUND"
        error = str(e)[:1000]
    if known and not (missing and absent_is_none):
        return SideInput(spark.read.parquet(known[-1]), "kept", error)
    return SideInput(None, "absent", error)
