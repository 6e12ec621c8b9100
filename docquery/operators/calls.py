"""Calls of a model for every row: some at a time, failures kept apart, resumed
by key."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def answers(rows: DataFrame, key: str, prompt: str, call: Callable[[str], str], workers: int = 4, tries: int = 2, budget: int = 100, pause: float = 0.0) -> DataFrame:
    """(key, answer, error, tries) for every row. A task has `workers` calls
    under way at a time. A call that raises is made again after pause seconds,
    up to `tries` times a row; a task repeats at most `budget` calls, so that a
    service that is down isn't waited for row by row. A row whose last call
    raises has its message (at most 120 characters) in error and no answer; the
    others go on. A null prompt isn't asked: no answer, error `no prompt`, 0 tries.
    Repeated rows and null keys are asked one by one."""
    schema = T.StructType([rows.schema[key], T.StructField("answer", T.StringType()), T.StructField("error", T.StringType()), T.StructField("tries", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, lock = budget, Lock()

        def again() -> bool:
            nonlocal left
            with lock:
                left -= 1
                return left >= 0

        def ask(text: str | None) -> tuple[str | None, str | None, int]:
            if text is None:
                return None, "no prompt", 0
            for n in range(1, max(1, tries) + 1):
                try:
                    return call(text), None, n
                except Exception as e:  # noqa: BLE001  a model may raise anything
                    error = f"{type(e).__name__}: {e}"[:120]
                if n == max(1, tries) or not again():
                    return None, error, n
                time.sleep(pause)
            raise AssertionError

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, 16 * workers):  # so few answers wait at once
                    part = batch.slice(at, 16 * workers)
                    said = list(pool.map(ask, part.column(1).to_pylist()))
                    new = [pa.array([x[i] for x in said], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays([part.column(0), *new], names=[key, "answer", "error", "tries"])

    return rows.select(key, F.col(prompt).cast("string")).mapInArrow(run, schema)


def add_answers(planned: DataFrame, path: str, key: str, prompt: str, call: Callable[[str], str], tidy: Callable[[Column], Column] | None = None, **how: int | float) -> int:
    """Asks for the rows of planned that have no answer in the table at path and
    appends what comes of them as one batch, whole or not at all; returns the
    batch's number. Rows that failed before are asked again. tidy makes the
    answer that is kept; where it gives null, the row has failed (`unusable
    answer`). A null key never counts as answered."""
    spark, batch = planned.sparkSession, 1
    try:
        had = spark.read.parquet(path)
        batch = (had.agg(F.max("batch")).first()[0] or 0) + 1
        planned = planned.join(had.where("error is null").select(key), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    new = answers(planned, key, prompt, call, **how)
    if tidy:
        new = new.withColumn("answer", tidy(F.col("answer"))).withColumn("error", F.coalesce("error", F.when(F.col("answer").isNull(), "unusable answer")))
    new.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path)
    return batch


def last_answers(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, answer, error, tries, batch), one row per key: its last answer, or
    where it has none its last failure."""
    last = Window.partitionBy(key).orderBy(F.col("error").isNotNull(), F.col("batch").desc(), "answer", "error", "tries")
    return spark.read.parquet(path).withColumn("nth_", F.row_number().over(last)).where("nth_ = 1").drop("nth_")
