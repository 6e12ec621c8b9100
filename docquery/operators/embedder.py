"""Embeddings fitted to a corpus: tf-idf over hashed words, projected by a
randomised truncated SVD.

The matrix of documents and word buckets is never built. Each round passes over
the documents once: tasks multiply blocks of them with the current directions
and sum what comes back; the driver makes directions orthogonal, which are as
many numbers as buckets times dimensions, whatever the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.storage import stored

#: Documents multiplied at once, and buckets in a row of partial sums.
ROWS, STRIP = 200, 8


class Model(NamedTuple):
    name: str  # says the parameters and a digest of the numbers
    idf: np.ndarray  # by bucket
    projection: np.ndarray  # buckets x dimensions

    @property
    def dim(self) -> int:
        return self.projection.shape[1]


def embed_text(context: Column, text: Column) -> Column:
    """What is embedded where a model has described a chunk: its description, an
    empty line, the text; the text alone without one. The text that is stored
    stays as it is."""
    described = F.length(F.trim(F.coalesce(context, F.lit("")))) > 0
    return F.when(described, F.concat(context, F.lit("\n\n"), F.coalesce(text, F.lit("")))).otherwise(F.coalesce(text, F.lit("")))


def _counts(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, times) of the words of lower-cased texts, in this order."""
    words = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"[^\pL\pN]+", " "))
    flat = words.flatten().dictionary_encode()
    hashed = np.array([xxhash.xxh32_intdigest(w) % buckets if w else -1 for w in flat.dictionary.cast(pa.binary()).to_pylist()], np.int64)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    bucket = hashed[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
    found, times = np.unique((row * buckets + bucket)[bucket >= 0], return_counts=True)
    return found // buckets, found % buckets, times


def word_counts(docs: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """(at, times): the buckets of each text's words, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                texts = batch.column(0).slice(i, 1000)
                row, at, times = _counts(texts, buckets)
                ends = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (at, times)], ["at", "times"])

    return docs.select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low")).mapInArrow(run, "at array<int>, times array<int>")


def _weighted(row: np.ndarray, at: np.ndarray, times: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """n documents as rows of length one: (1 + ln times) * idf by bucket."""
    dense = np.zeros((n, len(idf)), np.float32)
    dense[row, at] = (1 + np.log(times)) * idf[at]
    length = np.linalg.norm(dense, axis=1, keepdims=True)
    return dense / np.where(length == 0, 1, length)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            sizes = pc.list_value_length(part.column(0)).to_numpy(zero_copy_only=False)
            flat = [part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (0, 1)]
            yield np.repeat(np.arange(part.num_rows), sizes), *flat, part.num_rows


def _summed(strips: DataFrame, buckets: int, width: int) -> np.ndarray:
    """The sum of partial matrices that come in strips of rows. Strips of one
    place are brought together and added as they stream by; a batch leaves one
    row for each place it holds."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            strip = batch.column(0).to_numpy()
            first = np.flatnonzero(np.diff(strip, prepend=-1))
            total = np.add.reduceat(np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(batch.num_rows, -1), first, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(strip[first]), pa.array([x.tobytes() for x in total], pa.binary())], ["strip", "sums"])

    out = np.zeros((buckets // STRIP, STRIP * width))
    for strip, sums in strips.repartition("strip").sortWithinPartitions("strip").mapInArrow(add, "strip int, sums binary").toLocalIterator():
        out[strip] += np.frombuffer(sums)
    return out.reshape(buckets, width)


def _pass(counts: DataFrame, idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A' A times directions, where A has a row for each document."""
    sent = counts.sparkSession.sparkContext.broadcast((idf, directions.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, q = sent.value
        total = np.zeros(q.shape)
        for block in _blocks(batches):
            dense = _weighted(*block, idf)
            total += dense.T @ (dense @ q)
        strips = total.reshape(len(total) // STRIP, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(strips)), pa.int32()), pa.array([x.tobytes() for x in strips], pa.binary())], ["strip", "sums"])

    return _summed(counts.mapInArrow(run, "strip int, sums binary"), *directions.shape)


def fit(docs: DataFrame, text: str = "text", dim: int = 64, buckets: int = 1 << 13, rounds: int = 2, seed: int = 11) -> Model:
    """A model of all texts of docs. Words (runs of letters and digits, lower
    case) share `buckets`, a power of two; rounds passes follow the one that
    counts words. The driver holds 2 * buckets * (dim + 8) numbers.

    A null text is an empty one and moves nothing; repeated rows count each. A
    corpus with fewer than dim directions has zeros in the rest; an empty table
    gives a model that embeds everything as zeros. Reruns agree to about 1e-6,
    but for directions of equal weight, of which only the plane is determined.
    """
    counts = stored(word_counts(docs, buckets, text))
    n = counts.count()
    seen = counts.select(F.explode("at").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("df")).collect()  # at most a row per bucket
    df = np.zeros(buckets)
    for at, k in seen:
        df[at] = k
    idf = np.log((1 + n) / (1 + df)) + 1
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, min(buckets, dim + 8))))[0]
    for k in range(rounds):
        y = _pass(counts, idf, q)
        if k < rounds - 1:
            q = np.linalg.qr(y)[0]
    values, vectors = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    best = np.argsort(-values)[:dim]
    projection = q @ vectors[:, best] * (values[best] > 1e-9)
    projection = (projection * np.where((projection**3).sum(axis=0) < 0, -1, 1)).astype(np.float32)
    digest = hashlib.sha256(np.round(projection, 4).tobytes() + np.round(idf, 6).tobytes()).hexdigest()[:12]
    return Model(f"tfidf-svd-{buckets}-{len(best)}-{digest}", idf, projection)


def save(spark: SparkSession, model: Model, path: str) -> None:
    """Writes a model as a table with a row per bucket."""
    rows = pa.table({"name": [model.name] * len(model.idf), "bucket": np.arange(len(model.idf)), "idf": model.idf, "row": list(model.projection)})
    spark.createDataFrame(rows).coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str, name: str | None = None) -> Model:
    """Reads a model; another than the one named is refused, since vectors of
    two models can't be compared."""
    rows = spark.read.parquet(path).toArrow().sort_by("bucket")
    found = rows["name"][0].as_py()
    if name is not None and found != name:
        raise ValueError(f"{path} holds {found}, not {name}")
    return Model(found, rows["idf"].to_numpy(), np.array(rows["row"].to_pylist(), np.float32))


def embed(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", into: str = "vector") -> DataFrame:
    """(key, into) with the vector of each text, of length one; zeros for a text
    without words of weight. Null keys stay, repeated rows are embedded each,
    other columns don't matter, an empty table gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast((model.idf, model.projection))
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, projection = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                vectors = _weighted(*_counts(part.column(1), len(idf)), part.num_rows, idf) @ projection
                length = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = (vectors / np.where(length < 1e-9, np.inf, length)).astype(np.float32)
                ends = pa.array(np.arange(part.num_rows + 1) * vectors.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))], [key, into])

    return docs.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low_")).mapInArrow(run, f"`{key}` {kind}, `{into}` array<float>")
