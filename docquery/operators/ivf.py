"""An inverted-file index over vectors: searches read a few lists, not all rows.

Centroids are fitted on a bounded sample. Every row goes to the list of its
nearest centroid, as the 8-bit codes of what it differs from it; the table is
partitioned by list. A search reads the lists whose centroids lie nearest to its
queries, multiplies blocks of queries with blocks of rows, and computes exact
scores for the rows that the codes can't exclude. Each row carries how far its
codes are off, so within the lists that are read the result is that of a full
scan; with all lists read it is the full scan's.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquery.operators.vectors import dot
from docquery.storage import shared_dir

#: Rows of the index, and queries, that are multiplied at once.
ROWS, QUERIES = 4096, 512


class Index(NamedTuple):
    path: str  # Parquet, partitioned by list
    centroids: np.ndarray
    n_probe: int  # lists a search reads for each query
    key: str
    kind: str  # of the key
    most_k: int


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a vector, their vectors in single precision)."""
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(at)).flatten()
    return at, flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(at), -1) if len(at) else np.zeros((0, 0), np.float32)


def _nearness(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Greater for nearer centroids."""
    return vectors @ centroids.T - (centroids * centroids).sum(axis=1) / 2


def k_means(sample: np.ndarray, n: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centroids of a sample; one that loses all its rows stays where it was."""
    centroids = sample[np.sort(np.random.default_rng(seed).choice(len(sample), min(n, len(sample)), replace=False))].copy()
    for _ in range(rounds):
        own = _nearness(sample, centroids).argmax(axis=1)
        sums, sizes = np.zeros_like(centroids), np.bincount(own, minlength=len(centroids))
        np.add.at(sums, own, sample)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, recall: float, k: int = 5, asked: int = 256) -> int:
    """The least number of lists that hold the share `recall` of the k nearest
    rows, over `asked` rows of the sample against all of it. A table is denser
    than its sample and its nearest rows nearer, so this rather is too many."""
    queries = sample[:: max(1, len(sample) // asked)][:asked]
    own = _nearness(sample, centroids).argmax(axis=1)
    near = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, : k + 1]
    order = np.argsort(-_nearness(queries, centroids), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def _smallest_keys(same: np.ndarray, keys: pa.Array, most: int) -> np.ndarray:
    """Places of the `most` smallest keys among rows with equal bytes."""
    order = np.asarray(pc.sort_indices(keys)) if len(keys) else np.zeros(0, int)
    group = np.unique(same, return_inverse=True)[1].ravel()[order]
    by_group = np.argsort(group, kind="stable")
    sorted_groups = group[by_group]
    nth = np.arange(len(group)) - np.searchsorted(sorted_groups, sorted_groups)
    return np.sort(order[by_group[nth < most]])


def build(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    path: str | None = None,
    n_lists: int | None = None,
    most_fit: int = 20_000,
    recall: float = 0.95,
    most_k: int = 16,
    n_probe: int | None = None,
) -> Index:
    """Writes the index of all rows of vectors and returns its head.

    About most_fit rows, chosen by the hash of their keys, fit the centroids on
    the driver (most_fit * dimensions * 4 bytes there), and the number of lists
    to read, so that `recall` is met on the sample, unless n_probe says it.
    n_lists: by default about the square root of the rows, at most a sixteenth
    of the sample. Of rows with equal vectors that come in one Arrow batch, only
    the most_k smallest keys are written: no search for most_k or fewer rows can
    return others. Rows without a vector aren't indexed; all vectors must have
    one length; repeated keys are indexed each. An empty table has no index: it
    is an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector")).where("vector IS NOT NULL")
    n = rows.count()
    if not n:
        raise ValueError("no vectors to index")
    share = min(1 << 20, max(1, (most_fit << 20) // n))
    picked = rows.where(F.pmod(F.xxhash64("key", "vector"), F.lit(1 << 20)) < share).limit(2 * most_fit).toArrow()
    picked = picked.sort_by("key") if picked.num_rows else rows.limit(most_fit).toArrow()
    sample = _matrix(picked["vector"].combine_chunks())[1]
    lists = n_lists or max(1, min(int(2 ** round(np.log2(max(1.0, n**0.5)))), len(sample) // 16))
    centroids = k_means(sample, lists)
    kind = dict(vectors.dtypes)[key]
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, own = _matrix(batch.column(1))
            if not len(at):
                continue
            keys = batch.column(0).take(pa.array(at))
            keep = _smallest_keys(np.ascontiguousarray(own).view(f"V{4 * own.shape[1]}").ravel(), keys, most_k)
            own, keys = own[keep], keys.take(pa.array(keep))
            nearest = _nearness(own, sent.value).argmax(axis=1)
            rest = own - sent.value[nearest]
            scale = np.maximum(np.abs(rest).max(axis=1) / 127, np.finfo(np.float32).tiny).astype(np.float32)
            codes = np.rint(rest / scale[:, None]).clip(-127, 127).astype(np.int8)
            decoded = sent.value[nearest] + codes * scale[:, None]
            off = np.linalg.norm((own - decoded).astype(np.float64), axis=1) + 1e-5
            bytes_of = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(nearest, pa.int32()), keys, bytes_of, pa.array(scale, pa.float32()), pa.array(off, pa.float32())], ["list", "key", "codes", "scale", "off"])

    path = path or f"{shared_dir(spark)}/docquery-{spark.sparkContext.applicationId}/ivf-{uuid.uuid4().hex}"
    coded = rows.mapInArrow(assign, f"list int, key {kind}, codes binary, scale float, off float")
    coded.hint("rebalance", F.col("list")).write.partitionBy("list").parquet(path)
    return Index(path, centroids, n_probe or probes_for(sample, centroids, recall), key, kind, most_k)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of batches of one list each (column 0), of at most `most` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(0).to_numpy()
        ends = [*(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
        a = 0
        for b in ends:
            for i in range(a, b, most):
                yield int(lists[a]), batch.slice(i, min(most, b - i))
            a = b


def _bytes(column: pa.Array) -> bytes:
    return b"".join(column.to_pylist())


def _one_list(column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def search(index: Index, queries: DataFrame, vectors: DataFrame, k: int = 5, qid: str = "qid", qvec: str = "vector", vector: str = "embedding", n_probe: int | None = None) -> DataFrame:
    """(qid, key, score, rank): for each query the k rows with the largest dot
    product among the lists it reads, ties by key. vectors: the indexed table,
    from which exact scores are computed.

    Any number of queries, with ids of their own; one without a vector gets no
    rows; with fewer than k rows in its lists it gets these. Only the lists that
    some query reads are scanned (partition filters); their numbers, no more
    than there are centroids, are all that comes to the driver.
    """
    if k > index.most_k:
        raise ValueError(f"the index was built for at most {index.most_k} rows a query")
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast(index.centroids)
    reach = min(n_probe or index.n_probe, len(index.centroids))
    qkind = dict(queries.dtypes)[qid]
    asked = queries.select(F.col(qid).alias("qid"), F.col(qvec).cast("array<float>").alias("vector")).where("vector IS NOT NULL")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, own = _matrix(batch.column(1))
            if not len(at):
                continue
            near = np.argpartition(-_nearness(own, sent.value), reach - 1, axis=1)[:, :reach]
            who = np.repeat(np.arange(len(at)), reach)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * own.shape[1]), len(own), [None, pa.py_buffer(np.ascontiguousarray(own))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), batch.column(0).take(pa.array(at[who])), raw.take(pa.array(who))], ["list", "qid", "raw"])

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for which, part in _blocks(batches, QUERIES):
            yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), _one_list(part.column(1)), pa.array([_bytes(part.column(2))], pa.binary())], ["list", "qids", "queries"])

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for which, part in _blocks(batches, ROWS):
            numbers = [pa.array([part.column(c).to_numpy().astype(np.float32).tobytes()], pa.binary()) for c in (3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), _one_list(part.column(1)), pa.array([_bytes(part.column(2))], pa.binary()), *numbers], ["list", "keys", "codes", "scales", "offs"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = sent.value.shape[1]
        for batch in batches:
            for i in range(batch.num_rows):
                which, qids, raw, keys, codes, scales, offs = (batch.column(c)[i] for c in range(7))
                keys, qids = keys.values, qids.values
                q = np.frombuffer(raw.as_py(), np.float32).reshape(-1, dim)
                scale = np.frombuffer(scales.as_py(), np.float32)
                rows = sent.value[which.as_py()] + np.frombuffer(codes.as_py(), np.int8).reshape(-1, dim) * scale[:, None]
                near = q @ rows.T
                slack = np.linalg.norm(q, axis=1)[:, None] * np.frombuffer(offs.as_py(), np.float32)[None, :]
                low, high = near - slack, near + slack
                least = np.partition(low, max(0, low.shape[1] - k), axis=1)[:, max(0, low.shape[1] - k)]
                who, row = np.nonzero(high >= least[:, None])
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(who)), keys.take(pa.array(row)), pa.array(low[who, row]), pa.array(high[who, row])], ["qid", "key", "low", "high"])

    probed = asked.mapInArrow(probe, f"list int, qid {qkind}, raw binary")
    lists = sorted(r[0] for r in probed.select("list").distinct().collect())
    packed = probed.hint("rebalance", F.col("list")).sortWithinPartitions("list").mapInArrow(pack_queries, f"list int, qids array<{qkind}>, queries binary")
    coded = spark.read.parquet(index.path).where(F.col("list").isin(lists)).select("list", "key", "codes", "scale", "off")
    blocks = coded.mapInArrow(pack_rows, f"list int, keys array<{index.kind}>, codes binary, scales binary, offs binary")
    pairs = packed.join(blocks, "list").select("list", "qids", "queries", "keys", "codes", "scales", "offs")
    near = pairs.mapInArrow(score, f"qid {qkind}, key {index.kind}, low float, high float")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("low").desc()))
    least = F.max(F.when(F.col("place") == k, F.col("low"))).over(Window.partitionBy("qid"))
    open_ = near.withColumn("place", place).withColumn("least", least).where(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select("qid", "key").distinct()
    exact = (
        open_.join(vectors.select(F.col(index.key).alias("key"), F.col(vector).alias("row")), "key")
        .join(queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("asked")), "qid")
        .select("qid", "key", dot(F.col("row"), F.col("asked")).alias("score"))
    )
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "key"))
    found = exact.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select(F.col("qid").alias(qid), F.col("key").alias(index.key), "score", "rank")
