"""Vectors: embedding, 8-bit quantisation, exact top-k."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def unit(v: Column) -> Column:
    """To length one; a zero vector stays. The length is an argument of
    zip_with and so computed once, not once per component."""
    return F.zip_with(v, F.array_repeat(norm(v), F.size(v)), lambda x, n: x / F.when(n == 0, 1.0).otherwise(n))


def dot(a: Column, b: Column) -> Column:
    """Summed in double precision, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def group_scales(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, scale): the largest absolute component / 127; 1 where it is 0."""
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    top = vectors.groupBy(group).agg(F.max(largest).alias("top"))
    return top.select(group, F.when(F.col("top") > 0, F.col("top") / 127).otherwise(1.0).alias("scale"))


def quantize(vector: Column, scale: Column) -> Column:
    """Components / scale, rounded half to even, within -127 to 127."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x.cast("double") / scale))).cast("tinyint"))


def dequantize(codes: Column, scale: Column) -> Column:
    """Components * scale, to length one; a zero vector stays."""
    return unit(F.transform(codes, lambda x: x * scale))


def to_base64(codes: Column) -> Column:
    """Signed bytes as base64 text in one line (Spark's own breaks lines)."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(codes, lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(256))), 2, "0")), ""))), "\r\n", "")


def signed_bytes(raw: Column) -> Column:
    """The bytes as signed numbers. The value is named once, so that it is made
    once and not once per byte."""
    byte = lambda x, i: F.conv(F.hex(F.substring(x, i, F.lit(1))), 16, 10).cast("int")
    signed = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: ((byte(x, i) + 128) % 256 - 128).cast("tinyint"))
    return F.transform(F.array(raw), lambda x: F.when(F.length(x) > 0, signed(x)).otherwise(F.array().cast("array<tinyint>")))[0]


def from_base64(text: Column) -> Column:
    return signed_bytes(F.unbase64(text))


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for a model: words hashed to signed components,
    to length one. Queries and documents must use the same one."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # From 1, with its sign.
    codes = F.transform(words, lambda w: ((F.pmod(F.xxhash64(w), F.lit(dim)) + 1) * F.when(F.crc32(w.cast("binary")) % 2 == 0, 1).otherwise(-1)).cast("int"))

    def counted(codes: pa.Array) -> pa.Array:
        """Times of each component, less those of its negative, to length one."""
        flat = codes.flatten().to_numpy()
        at = np.repeat(np.arange(len(codes)), codes.value_lengths().to_numpy()) * dim + np.abs(flat) - 1
        counts = np.bincount(at, np.sign(flat), len(codes) * dim).reshape(-1, dim)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = (counts / np.where(length == 0, 1, length)).astype(np.float32)
        return pa.ListArray.from_arrays(np.arange(len(codes) + 1, dtype=np.int32) * dim, pa.array(unit.ravel()))

    return F.arrow_udf(counted, "array<float>")(codes)


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, qid: str = "qid", qvec: str = "vector", key: str = "vec_id", vector: str = "embedding", max_queries: int = 4096) -> DataFrame:
    """(qid, key, score, rank): the k rows with the largest dot product for each
    query, ties by key. queries: a stated set of at most max_queries (for more,
    see dense_top_k_blocks); vectors are multiplied with all of them, a batch at
    a time. A task keeps its k best, and looks closer only at scores that reach
    the least of these: what is shuffled is k rows per query and task."""
    stated = queries.select(qid, qvec).orderBy(qid).limit(max_queries + 1).collect()
    if len(stated) > max_queries:
        raise ValueError(f"more than {max_queries} queries; call for parts of them")
    ids = [r[0] for r in stated]
    sent = vectors.sparkSession.sparkContext.broadcast(np.array([r[1] for r in stated], float))
    kinds = dict(queries.dtypes)[qid], dict(vectors.dtypes)[key]

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}  # per block of queries: (query, key, rounded score, score) of its k best so far, and the least of them
        for part in batches:
            part = part.dropna()
            if not len(part) or not len(ids):
                continue
            rows = np.stack(part[vector].to_numpy()).astype(float).T
            keys = part[key].to_numpy()
            for at in range(0, len(ids), 256):
                some = sent.value[at : at + 256] @ rows
                if at in held:
                    *old, least = held[at]
                else:
                    old, place = None, max(0, some.shape[1] - k)
                    least = np.partition(np.round(some, 12), place, axis=1)[:, place]
                j, row = np.nonzero(some >= least[:, None] - 1e-11)  # a little more than can be among the best
                score = some[j, row]
                new = j, keys[row], np.round(score, 12), score
                j, own, near, score = new if old is None else map(np.concatenate, zip(old, new))
                order = np.lexsort((own, -near, j))
                j = j[order]
                top = np.arange(len(j)) - np.searchsorted(j, j) < k
                j, order = j[top], order[top]
                full = np.flatnonzero(np.bincount(j, minlength=len(some)) == k)
                least = np.full(len(some), -np.inf)
                least[full] = near[order][np.searchsorted(j, full, "right") - 1]
                held[at] = j, own[order], near[order], score[order], least
        for at, (j, own, _, score, _) in held.items():
            yield pd.DataFrame({qid: [ids[at + x] for x in j], key: own, "score": score})

    found = vectors.select(key, vector).mapInPandas(best, f"{qid} {kinds[0]}, {key} {kinds[1]}, score double")
    rank = F.row_number().over(Window.partitionBy(qid).orderBy(F.round("score", 12).desc(), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def dense_top_k_blocks(queries: DataFrame, vectors: DataFrame, k: int, qid: str = "qid", qvec: str = "vector", key: str = "vec_id", vector: str = "embedding", at_once: int = 4000) -> DataFrame:
    """dense_top_k of any number of queries with ids of their own, at_once at a
    time. Only the first id of each block comes to the driver."""
    nth = F.row_number().over(Window.orderBy(qid)) - 1
    heads = [r[0] for r in queries.select(qid).withColumn("nth_", nth).where(F.col("nth_") % at_once == 0).orderBy(qid).select(qid).collect()]
    within = [(F.col(qid) >= a) & (F.col(qid) < b if b is not None else F.lit(True)) for a, b in zip(heads, [*heads[1:], None])]
    found = [dense_top_k(queries.where(w), vectors, k, qid, qvec, key, vector, at_once) for w in within or [F.lit(True)]]
    return reduce(DataFrame.unionByName, found)
